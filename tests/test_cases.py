"""Whole cases in temporary folders: conversion, resuming, filters, repair, validation, export, intake."""

import csv
import os
import zipfile
from email.message import EmailMessage

import pytest

from lettermill import cli
from lettermill.operators import manifest as M
from lettermill.operators import ordering, participants
from lettermill.plans import cases
from lettermill.schema import MANIFEST_FIELDS
from lettermill.sinks import pdf, zips
from lettermill.sources import files, manifests, messages
from lettermill.streaming import intake


def write_message(path, sender="Ann <ann@x.io>", to="bob@x.io", body="Hello", html=None, attachment=None, raw=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if raw is None:
        m = EmailMessage()
        m["Subject"], m["From"], m["To"], m["Message-ID"] = "Grüße 1", sender, to, f"<{os.path.basename(path)}@x.io>"
        m.set_content(body)
        if html:
            m.add_alternative(html, subtype="html")
        if attachment:
            m.add_attachment(b"data", maintype="application", subtype="pdf", filename=attachment)
        raw = m.as_bytes()
    with open(path, "wb") as f:
        f.write(raw)


@pytest.fixture
def case(tmp_path):
    root = str(tmp_path / "case")
    os.makedirs(f"{root}/input")
    with open(f"{root}/input/ann@x.io.pst", "wb") as f:
        f.write(b"archive")
    eml = f"{root}/output/ann/eml"
    write_message(f"{eml}/Inbox/1.eml", attachment="plan; v2.pdf")
    write_message(f"{eml}/Inbox/_hidden/2.EML", sender="Eve <EVE@x.io>", to="carl@x.io")
    write_message(f"{eml}/Inbox-x/3.eml", raw=b"Content-Type: text/plain; charset=no-such\n\n\xff")
    return root


def rows(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.DictReader(f))


def test_run_resume_repair_zip(spark, case, capsys):
    (job,) = cases.archive_jobs(spark, case)
    assert job.slug == "ann"
    counts = cases.convert(spark, job, case)
    assert counts == {"convert": 3, "status_ok": 2, "status_error": 1}
    made = rows(job.manifest)
    assert [r["status"] for r in made] == ["ok", "ok", "error"] and list(made[0]) == list(MANIFEST_FIELDS)
    assert made[0]["subject"] == "Grüße 1" and made[0]["attachment_filenames"] == "plan; v2.pdf" and made[2]["error"] == "LookupError"
    assert all(open(r["pdf_path"], "rb").read().startswith(b"%PDF-1.4") for r in made[:2])
    assert "00000001_1_" in made[0]["pdf_path"] and "00000002_2_" in made[1]["pdf_path"]
    # what is done is skipped, what failed is tried again, an existing PDF is taken over
    assert cases.convert(spark, job, case) == {"skip_ok": 2, "convert": 1, "status_error": 1}
    manifests.write_csv(manifests.read_csv(spark, job.manifest).where("status = 'error'"), job.manifest)
    assert cases.convert(spark, job, case) == {"recover": 2, "convert": 1, "status_ok": 2, "status_error": 1}
    with pytest.raises(FileExistsError):
        cases.convert(spark, job, case, resume=False)
    # a repeated row is a consistency error, and repair removes it
    with open(job.manifest, "a", newline="", encoding="utf-8") as f:
        csv.DictWriter(f, MANIFEST_FIELDS).writerow(rows(job.manifest)[0])
    assert cli.main(["validate", case]) == 1
    assert cases.repair(spark, case)[0]["removed"] == 1 and len(rows(job.manifest)) == 4
    (done,) = cases.repair(spark, case, apply=True)
    assert done["removed"] == 1 and os.path.exists(done["backup"]) and len(rows(job.manifest)) == 3
    assert cases.run_case(spark, case, validate_only=True) == 0
    assert "PASS" in capsys.readouterr().out
    results = zips.zip_case(spark, case)
    assert [(r.slug, r.pdf_count, r.status) for r in results.collect()] == [("ann", 2, "ok")]
    with zipfile.ZipFile(f"{case}/zipped/ann.zip") as z:
        assert sorted(z.namelist()) == sorted(os.listdir(job.pdf_dir))
    assert cli.main(["zip", f"{case}/none"]) == 2


def test_filter(spark, case):
    (job,) = cases.archive_jobs(spark, case)
    eve = spark.createDataFrame([("eve@x.io",)], "address string")
    assert cases.convert(spark, job, case, filters=eve) == {"convert": 1, "filter": 2, "status_ok": 1, "status_filtered": 2}
    left = [r for r in rows(job.manifest) if r["status"] == "filtered"]
    assert {r["error"] for r in left} == {"filtered by email participant"} and {r["pdf_path"] for r in left} == {""}
    assert cases.convert(spark, job, case, filters=eve) == {"skip_ok": 1, "skip_filtered": 2}
    # without the filter the rows left out are replaced, not doubled
    cases.convert(spark, job, case)
    assert sorted(r["status"] for r in rows(job.manifest)) == ["error", "ok", "ok"]
    participants.guard_case_filter(case, ["B@x", "a@x", "b@x "])
    participants.guard_case_filter(case, ["a@x", "b@x"])
    with pytest.raises(participants.FilterChanged):
        participants.guard_case_filter(case, ["a@x"])
    participants.guard_case_filter(case, ["a@x"], force=True)
    assert open(f"{case}/config/filter_emails.txt").read() == "a@x\n"


def test_listing_and_messages(spark, case):
    assert files.count_files(spark, f"{case}/output", ".eml") == 3
    assert files.count_files(spark, f"{case}/nowhere", ".eml") == 0 and not files.has_files(spark, f"{case}/nowhere", ".eml")
    listed = files.list_files(spark, f"{case}/output/ann/eml", ".eml").withColumnRenamed("path", "eml_path")
    order = ordering.dense_positions(listed.selectExpr("eml_path", "1 AS g"), "g", [ordering.path_order()]).orderBy("position")
    assert [os.path.basename(r.eml_path) for r in order.collect()] == ["1.eml", "2.EML", "3.eml"]
    got = {os.path.basename(r.eml_path): r for r in messages.read_messages(listed).collect()}
    assert got["1.eml"].body == "Hello" and got["3.eml"].status == "error"
    write_message(f"{case}/m/a.eml", body="  ", html="<p>rich</p>")
    write_message(f"{case}/m/b.eml", raw=b"Content-Type: text/html\n\n<p>only</p><p>html</p>")
    more = {os.path.basename(r.eml_path): r.body for r in messages.read_messages(spark.createDataFrame([(f"{case}/m/a.eml",), (f"{case}/m/b.eml",), (f"{case}/m/none.eml",)], "eml_path string")).collect()}
    assert more == {"a.eml": "", "b.eml": "only\n\nhtml", "none.eml": None}
    heads = messages.read_headers(listed).where("eml_path like '%2.EML'").first()
    assert sorted(heads.participants) == ["carl@x.io", "eve@x.io"]


def test_time_limit():
    with pytest.raises(messages.TooSlow), messages.time_limit(0.1):
        while True:
            pass


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    texts = ['a "q" ,b', " lead", "two\nlines", "back\\slash", "", "ünï"]
    made = spark.createDataFrame([(k, *[t] * len(MANIFEST_FIELDS)) for k, t in enumerate(texts)], "seq bigint, " + ", ".join(f"`{f}` string" for f in MANIFEST_FIELDS))
    assert manifests.write_csv(made, path) == len(texts)
    assert [r.subject for r in manifests.read_csv(spark, path).orderBy("seq").collect()] == texts
    with open(path, "w") as f:
        f.write("eml_path,unknown\nx,1\n")
    (one,) = manifests.read_csv(spark, path).collect()
    assert one.eml_path == "x" and one.status == ""


def test_both_policies_of_deduplication(spark):
    columns = "seq bigint, eml_path string, status string, pdf_path string, error string"
    data = [(1, "a", "error", "", "e"), (2, "a", "ok", "p", ""), (3, "a", "ok", "gone", ""), (4, "b", "error", "", "y"), (5, "b", "timeout", "", "z"), (6, "", "ok", "", ""), (7, None, "ok", "", ""), (8, "c", "filtered", "", ""), (9, "c", "error", "", "")]
    df = spark.createDataFrame(data, columns)
    assert sorted(r.seq for r in M.deduplicate_for_resume(df).collect()) == [2, 5, 9]
    there = spark.createDataFrame([("p",)], "pdf_path string")
    better = M.deduplicate_for_repair(df, there).orderBy("without_path", "repair_order")
    assert [r.seq for r in better.collect()] == [2, 5, 9, 6, 7]


def test_intake(spark, case, tmp_path):
    table, failing = str(tmp_path / "table"), 1
    intake.take_in(spark, f"{case}/output", table, quiet=3600)
    assert not os.path.exists(table)  # nothing has been quiet for an hour
    write_message(f"{case}/output/ann/eml/bad.eml")
    os.chmod(f"{case}/output/ann/eml/bad.eml", 0)
    failing = int(os.geteuid() != 0)
    for n in (4, 5):
        intake.take_in(spark, f"{case}/output", table)
        got = spark.read.parquet(table)
        assert got.select("eml_path").distinct().count() == n and got.count() == got.select("seq").distinct().count() == n + failing * (n - 4)
        write_message(f"{case}/output/ann/eml/new/9.eml")
    assert any("_hidden" in r.eml_path for r in got.collect())
    assert intake.new_only(got.select("eml_path"), got).count() == failing


def test_pdf_of_odd_text(tmp_path):
    path = str(tmp_path / "x.pdf")
    pdf.render("fast", path, {"To": "a@x, " * 500, "Subject": "(\\) 日本\r\n\tx"}, "line\n" * 400 + "w" * 5000)
    raw = open(path, "rb").read()
    assert raw.startswith(b"%PDF-1.4") and raw.rstrip().endswith(b"%%EOF") and raw.count(b"/Type /Page ") > 5


def test_convert_command(spark, case, tmp_path, monkeypatch):
    root = f"{case}/output/ann"
    argv = ["convert", "--source-pst", f"{case}/input/ann@x.io.pst", "--eml-dir", f"{root}/eml", "--pdf-dir", f"{root}/pdf", "--manifest", f"{root}/manifest/ann.csv", "--log-file", str(tmp_path / "logs" / "c.log"), "--eml-stability-seconds", "0"]
    assert cli.main([*argv, "--filter-email", "eve@x.io"]) == 0
    assert sorted(r["status"] for r in rows(f"{root}/manifest/ann.csv")) == ["filtered", "filtered", "ok"]
    assert cli.main([*argv, "--resume"]) == 1  # the message of an unknown charset fails
    log = open(tmp_path / "logs" / "c.log").read()
    assert "start archive=" in log and "not converted: 1" in log and "Hello" not in log
    with pytest.raises(FileExistsError):
        cli.main(argv)
    for bad in (["--filter-email", "@"], ["--workers", "0"]):
        with pytest.raises(SystemExit):
            cli.main([*argv, *bad])
    with pytest.raises(ValueError):
        cases.wait_until_stable(spark, root, quiet=5, most=1)
    monkeypatch.setattr(cli, "_convert", lambda _: (_ for _ in ()).throw(KeyboardInterrupt))
    assert cli.main(argv) == 130
