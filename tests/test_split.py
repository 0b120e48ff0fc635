import pytest
from hypothesis import given
from hypothesis import strategies as st

from lettermill.functions import split
from lettermill.functions.split import split_items


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("Kestthault, Octavia", ["Kestthault, Octavia"]),
        ("Octavia Kesthault,Ulrich Talvhault", ["Octavia Kesthault", "Ulrich Talvhault"]),
        ('"Thadhault, Beatriz" <b@x.io>, c@y.io', ['"Thadhault, Beatriz" <b@x.io>', "c@y.io"]),
        ('"A B";C D', ["A B", "C D"]),
        ("Rychibrook, Francisco;Robert Norkibrook <r@x.io>;;<k@y.io>", ["Rychibrook, Francisco", "Robert Norkibrook <r@x.io>", "<k@y.io>"]),
        ("Floxygate, Katherine, Pirtavares, Octavia <s@x.io>", ["Floxygate, Katherine", "Pirtavares, Octavia <s@x.io>"]),
        ("Umbrark Logistics, AG <c@x.io>; d@x.io", ["Umbrark Logistics, AG <c@x.io>", "d@x.io"]),
        ("Zabrindela Cavropoulis, Francisco - Legal\nX Y", ["Zabrindela Cavropoulis, Francisco - Legal", "X Y"]),
        ("a@x.io,\n\tb@x.io\r\nc@x.io", ["a@x.io", "b@x.io", "c@x.io"]),
        ("Team: a@x.io, b@x.io; c@x.io", ["a@x.io", "b@x.io", "c@x.io"]),
        ("A B </O=X,Y/CN=Z>, C D (x, y)", ["A B </O=X,Y/CN=Z>", "C D (x, y)"]),
        ("undisclosed-recipients:;", []),
        (" ; , \r\n", []),
        ('"never closed, a@x.io', ['"never closed', "a@x.io"]),
        (None, []),
        ("", []),
    ],
)
def test_mailboxes(text, items):
    assert split_items(text) == items


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("draft contract, v1.p7m", ["draft contract, v1.p7m"]),
        ("a.pdf,b.doc, c, v2.txt", ["a.pdf", "b.doc", "c, v2.txt"]),
        ('"a; b.pdf" | c.doc', ["a; b.pdf", "c.doc"]),
        ('"the ""Minutes"" copy.jpg"|x.pdf', ['the "Minutes" copy.jpg', "x.pdf"]),
        (" café.pdf|factura.png  ", ["café.pdf", "factura.png"]),
        ("a (2).pdf;b.pdf;", ["a (2).pdf", "b.pdf"]),
        ("a.pdf\r\nb.pdf", ["a.pdf", "b.pdf"]),
    ],
)
def test_files(text, items):
    assert split_items(text, files=True) == items


@given(st.lists(st.text(st.characters(exclude_characters='\x00\\"', exclude_categories=("Cs",)), min_size=1, max_size=12).map(lambda s: s.strip(" \t\r\n")).filter(bool), min_size=1, max_size=6), st.sampled_from([";", " ; ", "|", "\n"]))
def test_quoted_items_come_back(items, mark):
    assert split_items(mark.join(f'"{i}"' for i in items)) == items


def test_long_fields_stay_linear():
    for text in ('"' * 200_001, "<" * 200_000, ":" * 200_000, "a,b" * 100_000, "(" * 100_000 + ")" * 100_000, "\n " * 100_000):
        split_items(text)
        split_items(text, files=True)
    assert len(split_items(";".join(["x@y.io"] * 50_000))) == 50_000


def test_rows(spark):
    schema = "seq bigint, to string, cc string, bcc string, attachment_filenames string, field string, item int"
    rows = [(1, "a@x.io; b@x.io", None, "", "one.pdf", "clash", 7), (2, None, None, None, None, None, None), (1, "a@x.io; b@x.io", None, "", "one.pdf", "clash", 7), (None, "a;b", None, None, "x.pdf|y, v2.pdf", None, None)]
    got = sorted(map(tuple, split.found(spark.createDataFrame(rows, schema)).collect()), key=repr)
    one = [(1, "to", 1, "a@x.io"), (1, "to", 2, "b@x.io")]
    none = [(None, "to", 1, "a"), (None, "to", 2, "b"), (None, "attachment_filenames", 1, "x.pdf"), (None, "attachment_filenames", 2, "y, v2.pdf")]
    assert got == sorted(one * 2 + none, key=repr)
    assert split.found(spark.createDataFrame([], schema)).count() == 0


def test_depth_has_no_limit():
    deep = "(" * 9 + "x" + ")" * 8 + " ; y)"
    assert split_items(deep + "; b") == [deep, "b"]
    assert len(split_items("(" * 100_000 + ")")) == 1


def test_file_names_with_far_commas():
    assert split_items("a.pdf" + " " * 100 + ", b.pdf", True) == ["a.pdf", "b.pdf"]
