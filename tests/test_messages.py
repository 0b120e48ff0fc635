"""Messages of several parts, charsets and nestings."""

import base64
import quopri

import pytest

from lettermill.operators import participants
from lettermill.sources import files, messages


def part(kind, body, *more):
    return b"--b\n" + "\n".join([f"Content-Type: {kind}", *more]).encode() + b"\n\n" + body + b"\n"


HEAD = b"Subject: =?iso-8859-1?Q?Gr=FC=DFe?=\n two\nFrom: Ann <A@x.io>\nReply-To: r@x.io\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n"


@pytest.mark.parametrize(
    ("parts", "names", "body"),
    [
        ([part("text/plain; charset=koi8-r", "Привет".encode("koi8_r"))], [], "Привет"),
        ([part("text/plain; charset=iso-8859-1", base64.b64encode("für".encode("latin_1")), "Content-Transfer-Encoding: base64")], [], "für"),
        ([part("text/html; charset=cp1251", quopri.encodestring("<p>да</p>".encode("cp1251")), "Content-Transfer-Encoding: quoted-printable")], [], "да"),
        ([part("text/plain", b" "), part("text/html", b"<p>never")], [], ""),
        ([part("text/plain", b"one"), part("text/plain; name=n.txt", b"two", "Content-Disposition: attachment"), part("text/plain", b"three")], ["n.txt"], "one\n\nthree"),
        ([part("application/pdf", b"x", "Content-Disposition: inline; filename*=utf-8''%C3%BC%20a.pdf")], ["ü a.pdf"], ""),
        ([part("message/rfc822", b"Subject: inner\nContent-Type: text/plain\n\ninner text")], [], "inner text"),
        ([part("multipart/alternative; boundary=c", b"--c\nContent-Type: text/html\n\n<b>rich</b>\n--c\nContent-Type: text/plain\n\nplain\n--c--")], [], "plain"),
    ],
)
def test_parts(parts, names, body):
    got = messages.parse_message(HEAD + b"".join(parts) + b"--b--\n")
    assert (got["attachments"], got["body"]) == (names, body)
    assert got["subject"] == "Grüße two" and got["participants"] == ["a@x.io", "r@x.io"] and got["cc"] == ""


def test_content_rows(spark):
    raw = [(1, HEAD + part("text/plain; charset=none-such", b"\xff") + b"--b--"), (2, b""), (3, None)]
    got = {r.key: r for r in messages.parse_content(spark.createDataFrame(raw, "key bigint, content binary")).collect()}
    assert (got[1].status, got[1].parse_error, got[2].status, got[3].status) == ("error", "LookupError", "ok", "ok")
    assert messages.parse_content(spark.createDataFrame([], "key bigint, content binary")).count() == 0


def test_files_by_uri(tmp_path):
    (tmp_path / "a b.eml").write_bytes(b"x")
    assert files.read_bytes(f"file://{tmp_path}/a b.eml") == files.read_bytes(str(tmp_path / "a b.eml")) == b"x"


def test_a_filter_too_long_for_a_task_is_joined(spark, monkeypatch):
    monkeypatch.setattr(participants, "FILTER_IN_TASK", 2)
    people = spark.createDataFrame([(1, ["a@x", "z@x"]), (2, ["q@x"]), (3, []), (4, None), (5, ["a@x", "z@x"])], "seq int, people array<string>").repartition(3)
    wanted = spark.createDataFrame([(f"{c}@x",) for c in "abc"], "address string")
    assert sorted(map(tuple, participants.matching(people, "people", wanted).select("seq", "matched").collect())) == [(1, True), (2, False), (3, False), (4, False), (5, True)]
