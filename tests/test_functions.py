import hashlib
import html

import pytest
from pyspark.sql import functions as F

from lettermill.functions import html as H
from lettermill.functions import text as TX
from lettermill.operators import participants as P


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


def test_addresses(spark):
    assert column(spark, TX.normalize_email, ["  bob@x.io  ", "@example.com", "user@", "", "   ", "A@B@C", None, "\tQ@X\r"]) == ["bob@x.io", None, None, None, None, "a@b@c", None, "q@x"]
    assert column(spark, TX.email_list, ["a@x.com, A@X.COM, b@y.com, a@x.com", "a@x.com\nb@y.com,@", None]) == [["a@x.com", "b@y.com"], ["a@x.com", "b@y.com"], []]
    assert P.parse_list("a@x.com, A@X.COM, b@y.com\n@,a@x.com") == ["a@x.com", "b@y.com"]
    digest = lambda *a: hashlib.sha256("\n".join(sorted(a)).encode()).hexdigest()
    assert column(spark, TX.fingerprint, [[], ["b@x", "A@X ", "a@x"], ["  @  ", "a@x", "b@x"]], "array<string>") == [digest(), digest("a@x", "b@x"), digest("a@x", "b@x")]
    assert column(spark, P.exact_participants, ['"X, Y" <A@x.io>, b@x.io', None, "@x"]) == [["a@x.io", "b@x.io"], [], ["@x"]]


def test_paths(spark):
    assert column(spark, TX.file_stem, ["/a/b.eml", "x.tar.gz", ".eml", "noext"]) == ["b", "x.tar", ".eml", "noext"]
    assert column(spark, lambda c: TX.has_suffix(c, ".eml"), ["a.eml", "a.EML", ".eml", "a.eml.txt", "b/.eml"]) == [True, True, False, False, False]
    names = column(spark, lambda c: TX.output_pdf_name(F.lit(7), c, F.lit("/r/eml/")), ["/r/eml/a b/ç é.eml"])
    assert names == ["00000007___" + hashlib.sha256("a b/ç é.eml".encode()).hexdigest()[:16] + ".pdf"]
    assert column(spark, lambda c: TX.display_path(c, F.lit("/mnt/cases/one")), ["/mnt/cases/one/x.eml", "/mnt/cases/two/y", "/other/z"]) == ["one/x.eml", "two/y", "/other/z"]
    slugs = ["/in/Octavia.K@x.example_06.pst", "/in/Archive 2023 Ü.pst", "/in/backup_e (84).pst", "/in/---.pst", "/in/a@b.pst"]
    assert column(spark, TX.archive_slug, slugs) == ["octavia-k-06", "archive-2023", "backup-e-84", "pst", "a"]


def test_headers_and_numbers(spark):
    assert column(spark, TX.sanitize_header, ["a\r\n\tb ", None]) == ["a b", ""]
    assert column(spark, TX.header_value, [" a\r\nb", None]) == ["a  b", ""]
    assert column(spark, TX.body_markup, ["<a href='x'>&\"\n"]) == [html.escape("<a href='x'>&\"") + "<br/>"]
    assert column(spark, TX.bytes_text, [512, 1024, 2 * 1024**2, 0, 3 * 1024**5], "bigint") == ["512.0 B", "1.0 KB", "2.0 MB", "0.0 B", "3.0 PB"]
    assert column(spark, TX.elapsed_text, [45, 90, 3661, 0, 360_000], "bigint") == ["00:00:45", "00:01:30", "01:01:01", "00:00:00", "100:00:00"]
    assert column(spark, TX.slug_list, ["a, b,,a ", None]) == [["a", "b", "a"], []]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<td>a</td><td>b</td>", "ab"),
        ("a<br>b<br/>c", "a\nb\n\nc"),
        ("<p>x</p><p>y</p>", "x\n\ny"),
        ("<style>p{}</style>t<script>'</p>'</script><!-- c -->", "t"),
        ("<head><title>t</title></head>body &amp; &copy &unknown;", "body & © &unknown;"),
        ("<head>never closed <p>x", ""),
        ("</style>kept", "kept"),
        ("<noscript>n</noscript>  a \t b\r\n\n\n\nc ", "a b\n\nc"),
        ("", ""),
    ],
)
def test_html(page, text):
    assert H.html_text(page) == text


def test_html_column(spark):
    assert column(spark, H.html_to_text, ["<p>x", None, ""]) == ["x", None, ""]
    page = H.message_page({"Subject": "<&>", "From": "'q'"}, "")
    made = spark.range(1).select(H.message_page_column({"Subject": F.lit("<&>"), "From": F.lit("'q'")}, F.lit(None).cast("string"))).first()[0]
    assert made == page and H.NO_BODY in page and "&lt;&amp;&gt;" in page


def test_html_scan_is_linear_and_hides_what_is_left_open():
    import time

    began = time.perf_counter()
    for page in ("<a " * 50_000, "</" * 50_000, "<!--" * 50_000, '<a b="' * 50_000, "<script>" * 50_000, "<a b='" * 50_000 + ">"):
        H.html_text(page)
    assert time.perf_counter() - began < 5
    assert H.html_text("a<script>b</p>c") == "a" and H.html_text("a<!-- b <p>c") == "a"
    assert H.html_text('<p title="a>b">x</p><div class=\'</p>\'>y') == "x\n\ny"
