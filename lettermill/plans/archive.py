"""Queries over a case's manifest and file listings, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import html as H
from lettermill.functions import text as TX
from lettermill.operators import decide as D
from lettermill.operators import manifest as M
from lettermill.operators import ordering, participants, reconcile
from lettermill.plans import cases
from lettermill.schema import HEADER_LABELS, MANIFEST_FIELDS, SUMMARY_FIELDS
from lettermill.session import table
from lettermill.sources import files, messages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# white space as Python and (?U)\s know it, for trim() in SQL
_WS = "||".join(f"chr({n})" for n in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
_SLUG = r"regexp_extract(coalesce({0}, ''), '/output/([^/]+)/', 1)"
_STEM = r"regexp_replace(split_part({0}, '/', -1), '([^.])\.[^.]*$', '\1')"
_ARCHIVE_SLUG = rf"""coalesce(nullif(trim(regexp_replace(CASE WHEN instr(stem, '@') = 0 THEN stem
  WHEN regexp_extract(substr(stem, instr(stem, '@') + 1), '(?:^|[._-])(\d+)$', 1) <> ''
    THEN split_part(stem, '@', 1) || '-' || regexp_extract(substr(stem, instr(stem, '@') + 1), '(?:^|[._-])(\d+)$', 1)
  ELSE split_part(stem, '@', 1) END, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'pst')"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "manifest")


@query("SELECT coalesce(status, '') AS status, count(*) AS n_rows FROM manifest GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.status_counts(_manifest(spark, sf_dir))


@query("SELECT source_pst_path, coalesce(status, '') AS status, count(*) AS n_rows FROM manifest GROUP BY 1, 2")
def status_counts_by_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.status_counts(_manifest(spark, sf_dir), ["source_pst_path"])


@query("SELECT eml_path, count(*) AS n_rows FROM manifest WHERE coalesce(eml_path, '') <> '' GROUP BY 1")
def rows_per_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.key_counts(_manifest(spark, sf_dir))


@query("SELECT cast(count(*) - count(DISTINCT eml_path) AS bigint) AS duplicate_rows FROM manifest WHERE coalesce(eml_path, '') <> ''")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.duplicate_count(_manifest(spark, sf_dir))


_RESUME = """SELECT seq, eml_path, status, min(seq) OVER (PARTITION BY eml_path) AS first_seq,
  row_number() OVER (PARTITION BY eml_path ORDER BY (CASE WHEN status = 'ok' THEN 0 ELSE 1 END), (CASE WHEN status = 'ok' THEN seq ELSE -seq END)) AS rn
  FROM manifest WHERE coalesce(eml_path, '') <> ''"""


@query(f"SELECT seq, eml_path, status, first_seq FROM ({_RESUME}) WHERE rn = 1")
def dedup_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.deduplicate_for_resume(_manifest(spark, sf_dir).select("seq", "eml_path", "status"))


@query(f"SELECT seq, eml_path, status FROM ({_RESUME}) WHERE rn = 1 AND status IN ('ok', 'filtered')")
def resume_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.kept_on_resume(dedup_resume(spark, sf_dir)).select("seq", "eml_path", "status")


@query("""WITH r AS (SELECT seq, coalesce(eml_path, '') AS eml_path, coalesce(pdf_path, '') AS pdf_path, coalesce(status, '') AS status, coalesce(error, '') AS error FROM manifest),
x AS (SELECT r.*, CASE WHEN status = 'ok' AND pdf_path IN (SELECT pdf_path FROM pdf_files WHERE pdf_path IS NOT NULL) THEN 0 WHEN status = 'ok' THEN 1 WHEN status = 'timeout' THEN 2 WHEN status = 'error' THEN 3 ELSE 4 END AS rank FROM r),
y AS (SELECT *, row_number() OVER (PARTITION BY eml_path ORDER BY rank, pdf_path, error, seq) AS rn, min(seq) OVER (PARTITION BY eml_path) AS first_seq FROM x WHERE eml_path <> '')
SELECT seq, first_seq AS repair_order, false AS without_path FROM y WHERE rn = 1
UNION ALL SELECT seq, seq, true FROM x WHERE eml_path = ''""")
def dedup_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _manifest(spark, sf_dir).select("seq", "eml_path", "pdf_path", "status", "error")
    return M.deduplicate_for_repair(rows, table(spark, sf_dir, "pdf_files")).select("seq", "repair_order", "without_path")


@query("SELECT DISTINCT eml_path FROM eml_files WHERE coalesce(eml_path, '') <> '' AND eml_path NOT IN (SELECT eml_path FROM manifest WHERE eml_path IS NOT NULL)")
def missing_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.missing_from(table(spark, sf_dir, "eml_files"), _manifest(spark, sf_dir), "eml_path")


@query("SELECT DISTINCT eml_path FROM manifest WHERE coalesce(eml_path, '') <> '' AND eml_path NOT IN (SELECT eml_path FROM eml_files WHERE eml_path IS NOT NULL)")
def missing_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.missing_from(_manifest(spark, sf_dir), table(spark, sf_dir, "eml_files"), "eml_path")


@query("SELECT DISTINCT pdf_path FROM pdf_files WHERE coalesce(pdf_path, '') <> '' AND pdf_path NOT IN (SELECT pdf_path FROM manifest WHERE pdf_path IS NOT NULL)")
def extra_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.missing_from(table(spark, sf_dir, "pdf_files"), _manifest(spark, sf_dir), "pdf_path")


@query("SELECT DISTINCT eml_path FROM eml_files WHERE coalesce(eml_path, '') <> '' AND eml_path NOT IN (SELECT eml_path FROM manifest WHERE status = 'ok' AND eml_path IS NOT NULL)")
def without_ok_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.missing_from(table(spark, sf_dir, "eml_files"), _manifest(spark, sf_dir).where("status = 'ok'"), "eml_path")


@query("SELECT seq, pdf_path FROM manifest WHERE status = 'ok' AND (coalesce(pdf_path, '') = '' OR pdf_path NOT IN (SELECT pdf_path FROM pdf_files WHERE pdf_path IS NOT NULL))")
def ok_missing_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.ok_without_pdf(_manifest(spark, sf_dir).select("seq", "pdf_path", "status"), table(spark, sf_dir, "pdf_files")).select("seq", "pdf_path")


_SUMMARY_SQL = f"""WITH m AS (SELECT *, CASE WHEN {_SLUG.format("eml_path")} <> '' THEN {_SLUG.format("eml_path")} ELSE {_ARCHIVE_SLUG} END AS slug_e,
    CASE WHEN {_SLUG.format("pdf_path")} <> '' THEN {_SLUG.format("pdf_path")} ELSE {_ARCHIVE_SLUG} END AS slug_p
  FROM (SELECT coalesce(eml_path, '') AS eml_path, coalesce(pdf_path, '') AS pdf_path, coalesce(status, '') AS status, lower({_STEM.format("source_pst_path")}) AS stem FROM manifest)),
e AS (SELECT DISTINCT eml_path, {_SLUG.format("eml_path")} AS slug FROM eml_files WHERE regexp_matches(lower(eml_path), '[^/.]\\.eml$')),
p AS (SELECT DISTINCT pdf_path, {_SLUG.format("pdf_path")} AS slug FROM pdf_files WHERE regexp_matches(lower(pdf_path), '[^/.]\\.pdf$')),
k AS (SELECT slug_e AS slug, eml_path, count(*) AS n FROM m WHERE eml_path <> '' GROUP BY 1, 2),
parts AS (
  SELECT slug, 'total_eml_files' AS f, count(*) AS v FROM e GROUP BY 1
  UNION ALL SELECT slug, 'total_pdf_files', count(*) FROM p GROUP BY 1
  UNION ALL SELECT slug_e, 'total_manifest_rows', count(*) FROM m GROUP BY 1
  UNION ALL SELECT slug_e, 'successful_rows', count(*) FROM m WHERE status = 'ok' GROUP BY 1
  UNION ALL SELECT slug_e, 'failed_rows', count(*) FROM m WHERE status = 'error' GROUP BY 1
  UNION ALL SELECT slug_e, 'timeout_rows', count(*) FROM m WHERE status = 'timeout' GROUP BY 1
  UNION ALL SELECT slug_e, 'filtered_rows', count(*) FROM m WHERE status = 'filtered' GROUP BY 1
  UNION ALL SELECT slug, 'duplicate_eml_rows', sum(n - 1) FROM k GROUP BY 1
  UNION ALL SELECT slug_p, 'missing_pdfs_for_successful_rows', count(*) FROM m WHERE status = 'ok' AND pdf_path NOT IN (SELECT pdf_path FROM p) GROUP BY 1
  UNION ALL SELECT slug, 'eml_files_missing_manifest_rows', count(*) FROM e WHERE eml_path NOT IN (SELECT eml_path FROM k) GROUP BY 1
  UNION ALL SELECT slug, 'manifest_eml_paths_missing_on_disk', count(*) FROM k WHERE eml_path NOT IN (SELECT eml_path FROM e) GROUP BY 1
  UNION ALL SELECT slug, 'extra_pdf_files_not_referenced_by_manifest', count(*) FROM p WHERE pdf_path NOT IN (SELECT pdf_path FROM m) GROUP BY 1),
s AS (SELECT slug, {", ".join(f"cast(coalesce(sum(v) FILTER (f = '{f}'), 0) AS bigint) AS {f}" for f in SUMMARY_FIELDS)} FROM parts GROUP BY ROLLUP (slug))
SELECT *, (duplicate_eml_rows > 0 OR missing_pdfs_for_successful_rows > 0 OR eml_files_missing_manifest_rows > 0 OR manifest_eml_paths_missing_on_disk > 0) AS has_errors,
  cast((duplicate_eml_rows > 0)::int + (missing_pdfs_for_successful_rows > 0)::int + (eml_files_missing_manifest_rows > 0)::int + (manifest_eml_paths_missing_on_disk > 0)::int AS int) AS n_issues FROM s"""


@query(_SUMMARY_SQL)
def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_slug = reconcile.summaries(_manifest(spark, sf_dir), table(spark, sf_dir, "eml_files"), table(spark, sf_dir, "pdf_files"))
    return reconcile.with_total(by_slug).withColumn("has_errors", reconcile.has_consistency_errors()).withColumn("n_issues", F.size(reconcile.issues()))


@query("SELECT source_pst_path, count(*) AS n_files, cast(coalesce(sum(size_bytes), 0) AS bigint) AS total_bytes, epoch_us(max(modified_at)) AS newest_us FROM eml_files GROUP BY 1")
def tree_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.tree_snapshot(table(spark, sf_dir, "eml_files"), ["source_pst_path"]).withColumn("newest_us", F.unix_micros("newest")).drop("newest")


@query("SELECT cast(sum(size_bytes) AS bigint) AS total_bytes, count(*) AS n_archives FROM pst_sources")
def source_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pst_sources").agg(F.sum("size_bytes").alias("total_bytes"), F.count("*").alias("n_archives"))


_FILTER = f"""SELECT address, min(line_no) AS line_no FROM (SELECT line_no, lower(trim(line, {_WS})) AS address FROM filter_lines WHERE trim(line, {_WS}) <> '' AND NOT starts_with(trim(line, {_WS}), '#'))
  WHERE instr(address, '@') > 1 AND instr(address, '@') < length(address) GROUP BY 1"""


@query(_FILTER)
def filter_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return participants.filter_addresses(table(spark, sf_dir, "filter_lines"))


@query(f"""SELECT address, min_by(source, source * 1000000000000 + line_no) AS source, min_by(line_no, source * 1000000000000 + line_no) AS line_no FROM (
  SELECT address, 0::int AS source, line_no FROM ({_FILTER})
  UNION ALL SELECT lower(mail_address), 1, entity_id FROM address_book WHERE mail_address IS NOT NULL) GROUP BY 1""")
def merged_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = table(spark, sf_dir, "address_book").select(TX.normalize_email(F.col("mail_address")).alias("address"), F.col("entity_id").alias("line_no")).where("address is not null")
    return participants.merged_filters(filter_addresses(spark, sf_dir), book)


@query(f"SELECT sha256(string_agg(address, chr(10) ORDER BY address)) AS fingerprint FROM ({_FILTER})")
def filter_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return participants.filter_fingerprint(filter_addresses(spark, sf_dir))


_ADDRESS = r"""[^\s<>,;:"()\[\]]+@[^\s<>,;:"()\[\]]+"""
_PEOPLE = "list_sort(list_distinct(" + "||".join(f"regexp_extract_all(lower(coalesce({c}, '')), '({_ADDRESS})', 1)" for c in ('"from"', '"to"', "cc", "bcc")) + "))"


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = [F.col(f"`{c}`") for c in ("from", "to", "cc", "bcc")]
    return _manifest(spark, sf_dir).select("seq", participants.participants(heads).alias("people"))


@query(f"SELECT seq, array_to_string(people, ',') AS people, cast(len(people) AS int) AS n_people FROM (SELECT seq, {_PEOPLE} AS people FROM manifest)")
def message_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).select("seq", F.array_join(F.array_sort("people"), ",").alias("people"), F.size("people").alias("n_people"))


@query(f"SELECT seq, coalesce(list_has_any(people, (SELECT list(address) FROM ({_FILTER}))), false) AS matched FROM (SELECT seq, {_PEOPLE} AS people FROM manifest)")
def filter_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return participants.matching(_people(spark, sf_dir), "people", filter_addresses(spark, sf_dir)).select("seq", "matched")


_LIST = rf"""list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce("to", ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E,]'), lambda x: lower(trim(x, {_WS}))), lambda x: instr(x, '@') > 1 AND instr(x, '@') < length(x))))"""


@query(f"SELECT seq, array_to_string(l, ',') AS addresses, sha256(array_to_string(l, chr(10))) AS fingerprint FROM (SELECT seq, {_LIST} AS l FROM manifest)")
def email_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _manifest(spark, sf_dir).select("seq", TX.email_list(F.col("`to`")).alias("l"))
    return made.select("seq", F.array_join(F.array_sort("l"), ",").alias("addresses"), TX.fingerprint(F.col("l")).alias("fingerprint"))


_TASKS = """t AS (SELECT e.eml_path, max(m.pdf_path) AS pdf_path FROM (SELECT DISTINCT eml_path FROM eml_files WHERE coalesce(eml_path, '') <> '') e
  LEFT JOIN (SELECT eml_path, pdf_path FROM manifest WHERE pdf_path <> '') m ON e.eml_path = m.eml_path GROUP BY 1),
h AS (SELECT eml_path, bool_or(list_has_any(people, (SELECT list(address) FROM f))) AS matched FROM q GROUP BY 1)"""


@query(f"""WITH f AS ({_FILTER}), q AS (SELECT eml_path, {_PEOPLE} AS people FROM manifest WHERE coalesce(eml_path, '') <> ''), {_TASKS},
d AS (SELECT eml_path, status FROM ({_RESUME}) WHERE rn = 1 AND status IN ('ok', 'filtered'))
SELECT t.eml_path, CASE WHEN d.status = 'ok' THEN 'skip_ok' WHEN d.status = 'filtered' THEN 'skip_filtered'
  WHEN t.pdf_path IN (SELECT pdf_path FROM pdf_files WHERE pdf_path IS NOT NULL) THEN 'recover'
  WHEN NOT coalesce(h.matched, false) THEN 'filter' ELSE 'convert' END AS decision
FROM t LEFT JOIN d ON t.eml_path = d.eml_path LEFT JOIN h ON t.eml_path = h.eml_path""")
def decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _manifest(spark, sf_dir)
    known = m.where("pdf_path <> ''").groupBy("eml_path").agg(F.max("pdf_path").alias("pdf_path"))
    heads = [F.col(f"`{c}`") for c in ("from", "to", "cc", "bcc")]
    seen = participants.matching(m.where("eml_path <> ''").select("eml_path", participants.participants(heads).alias("people")), "people", filter_addresses(spark, sf_dir))
    matched = seen.groupBy("eml_path").agg(F.bool_or("matched").alias("matched"))
    tasks = table(spark, sf_dir, "eml_files").select("eml_path").where("eml_path <> ''").distinct().join(known, "eml_path", "left").join(matched, "eml_path", "left")
    return D.decide(tasks, m, table(spark, sf_dir, "pdf_files"), filter_active=True).select("eml_path", "decision")


@query("SELECT decision, count(*) AS n_messages FROM (" + SQL["decision"] + ") GROUP BY 1")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.run_counters(decision(spark, sf_dir))


@query(f"SELECT pst_id, {_ARCHIVE_SLUG} AS slug FROM (SELECT pst_id, lower({_STEM.format('source_pst_path')}) AS stem FROM pst_sources)")
def archive_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pst_sources").select("pst_id", TX.archive_slug(F.col("source_pst_path")).alias("slug"))


@query(f"""WITH x AS (SELECT DISTINCT regexp_replace(source_pst_path, '[0-9]+', '') AS path FROM manifest WHERE source_pst_path IS NOT NULL), y AS (SELECT path, lower({_STEM.format("path")}) AS stem FROM x),
z AS (SELECT path, {_ARCHIVE_SLUG} AS s FROM y)
SELECT path, CASE WHEN path = min(path) OVER (PARTITION BY s) THEN s ELSE s || '-' || substr(sha256(split_part(path, '/', -1)), 1, 8) END AS slug FROM z""")
def unique_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _manifest(spark, sf_dir).where("source_pst_path is not null").select(F.regexp_replace("source_pst_path", "^([^0-9]*)[0-9]+", "$1").alias("path")).distinct()
    return cases.unique_slugs(paths, "path", "path").select("path", "slug")


_INDEXED = """SELECT eml_path, source_pst_path, row_number() OVER (PARTITION BY source_pst_path ORDER BY string_split(eml_path, '/')) AS msg_index
  FROM (SELECT DISTINCT eml_path, source_pst_path FROM eml_files WHERE regexp_matches(lower(eml_path), '[^/.]\\.eml$'))"""


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "eml_files").where(TX.has_suffix(F.col("eml_path"), ".eml")).select("eml_path", "source_pst_path").distinct()
    return ordering.dense_positions(listed, "source_pst_path", [ordering.path_order()], "msg_index")


@query(_INDEXED)
def message_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).select("eml_path", "source_pst_path", "msg_index")


@query(rf"""SELECT eml_path, printf('%08d_', msg_index) || coalesce(nullif(substr(regexp_replace({_STEM.format("eml_path")}, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80), ''), 'email') || '_' || substr(sha256(
  substr(eml_path, length(regexp_extract(eml_path, '^(.*/eml)/', 1)) + 2)), 1, 16) || '.pdf' AS pdf_name FROM ({_INDEXED})""")
def pdf_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.regexp_extract("eml_path", "^(.*/eml)/", 1)
    return _indexed(spark, sf_dir).select("eml_path", TX.output_pdf_name(F.col("msg_index"), F.col("eml_path"), root).alias("pdf_name"))


@query("""SELECT seq, CASE WHEN starts_with(eml_path, '/mnt/cases/') THEN substr(eml_path, 12) ELSE eml_path END AS shown, split_part(eml_path, '/', -1) AS file_name FROM manifest""")
def display_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir).select("seq", TX.display_path(F.col("eml_path"), F.lit("/mnt/cases/one/")).alias("shown"), TX.file_name(F.col("eml_path")).alias("file_name"))


@query(rf"""SELECT seq, trim(regexp_replace(coalesce("to", ''), '[\r\n\t]+', ' ', 'g'), {_WS}) AS sanitized, trim(regexp_replace(coalesce("to", ''), '[\r\n]', ' ', 'g'), {_WS}) AS header_value,
  trim(regexp_replace(coalesce(subject, ''), '[\r\n]', ' ', 'g'), {_WS}) AS subject FROM manifest""")
def header_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir).select("seq", TX.sanitize_header(F.col("`to`")).alias("sanitized"), TX.header_value(F.col("`to`")).alias("header_value"), TX.header_value(F.col("subject")).alias("subject"))


_ESCAPED = "replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"SELECT doc_id, replace({_ESCAPED}, chr(10), '<br/>') AS markup FROM documents")
def escape_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", TX.body_markup(F.col("text")).alias("markup"))


@query(rf"""WITH l AS (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'), {_WS})) AS lines FROM documents)
SELECT doc_id, trim(regexp_replace(array_to_string(lines, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), {_WS}) AS body FROM l""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.regexp_replace(TX.escape_html(TX.blank_if_null(F.col("text"))), "(\\r\\n|[\\n\\r])", "<br>")
    page = F.concat(F.lit("<html><head><title>t &amp; u</title><style>p {color: red}</style></head><body><noscript>none</noscript>"), escaped, F.lit("<!-- gone --></body></html>"))
    return table(spark, sf_dir, "documents").select("doc_id", H.html_to_text(page).alias("body"))


def _cell(label: str, column: str | None) -> str:
    value = "''" if column is None else _escape_sql(f"coalesce({column}, '')")
    return f"'{H.ENTRY[0]}{label}{H.ENTRY[1]}' || {value} || '{H.ENTRY[2]}'"


def _escape_sql(value: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        value = f"replace({value}, '{raw}', '{safe}')"
    return value


_CELLS = dict(zip(HEADER_LABELS, ("subject", '"from"', '"to"', "cc", "bcc", "date", "message_id", None, None), strict=True))


@query(f"SELECT seq, '{H.PAGE_START}' || " + " || ".join(_cell(k, c) for k, c in _CELLS.items()) + f" || '{H.PAGE_MIDDLE}{H.NO_BODY}{H.PAGE_END}' AS page FROM manifest")
def message_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = {"Subject": F.col("subject"), "From": F.col("`from`"), "To": F.col("`to`"), "Cc": F.col("cc"), "Bcc": F.col("bcc"), "Date": F.col("date"), "Message-ID": F.col("message_id")}
    return _manifest(spark, sf_dir).select("seq", H.message_page_column(heads, F.lit("")).alias("page"))


@query("""WITH p AS (SELECT eml_path, doc_id, content_type, text FROM documents WHERE eml_path IS NOT NULL), k AS (SELECT eml_path, bool_or(content_type = 'text/plain') AS plain FROM p GROUP BY 1)
SELECT p.eml_path, CASE WHEN plain THEN 'text/plain' ELSE 'text/html' END AS kind, count(*) AS n_parts, cast(coalesce(sum(length(text)), 0) AS bigint) AS n_chars
FROM p JOIN k ON p.eml_path = k.eml_path WHERE p.content_type = CASE WHEN plain THEN 'text/plain' ELSE 'text/html' END GROUP BY 1, 2""")
def body_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("content_type")
    per = table(spark, sf_dir, "documents").where("eml_path is not null").groupBy("eml_path", "content_type").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("c"))
    one = per.groupBy("eml_path").agg(*[F.max(F.when(kind == k, F.struct("n", "c"))).alias(a) for k, a in (("text/plain", "plain"), ("text/html", "html"))])
    chosen = F.coalesce("plain", "html")
    return one.where(chosen.isNotNull()).select("eml_path", F.when(F.col("plain").isNotNull(), "text/plain").otherwise("text/html").alias("kind"), chosen["n"].alias("n_parts"), chosen["c"].alias("n_chars"))


_UNITS = "CASE " + " ".join(f"WHEN size_bytes / {1024.0**k} < 1024 THEN format('{{:,.1f}} {u}', size_bytes / {1024.0**k})" for k, u in enumerate(("B", "KB", "MB", "GB", "TB"))) + f" ELSE format('{{:,.1f}} PB', size_bytes / {1024.0**5}) END"


@query(f"""SELECT pst_id, format('{{:,}}', size_bytes) AS number, {_UNITS} AS size, printf('%02d:%02d:%02d', size_bytes // 3600, (size_bytes % 3600) // 60, size_bytes % 60) AS elapsed,
  CASE WHEN date_order = 'dmy' THEN 'yes' ELSE 'no' END AS day_first, cast(len(list_filter(list_transform(string_split(locale || ', ,' || slug, ','), lambda x: trim(x)), lambda x: x <> '')) AS int) AS n_items FROM pst_sources""")
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("size_bytes")
    return table(spark, sf_dir, "pst_sources").select(
        "pst_id", TX.number_text(n).alias("number"), TX.bytes_text(n).alias("size"), TX.elapsed_text(n).alias("elapsed"), TX.yes_no(F.col("date_order") == "dmy").alias("day_first"),
        F.size(TX.slug_list(F.concat("locale", F.lit(", ,"), "slug"))).alias("n_items"),
    )


@query("""SELECT source_pst_path, coalesce(source_pst_sha256, '') AS source_pst_sha256, coalesce(eml_path, '') AS eml_path, CASE WHEN status = 'filtered' THEN '' ELSE coalesce(pdf_path, '') END AS pdf_path,
"""
       + ", ".join(f"CASE WHEN status IN ('error', 'timeout') THEN '' ELSE coalesce(\"{c}\", '') END AS \"{c}\"" for c in ("subject", "from", "to", "cc", "bcc", "date", "message_id"))
       + """, CASE WHEN status = 'ok' THEN coalesce(attachment_filenames, '') ELSE '' END AS attachment_filenames, status, CASE status WHEN 'ok' THEN '' WHEN 'filtered' THEN 'filtered by email participant' ELSE coalesce(error, '') END AS error FROM manifest""")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all four kinds, built anew from their parts."""
    m = _manifest(spark, sf_dir).select(*[f"`{c}`" for c in MANIFEST_FIELDS])
    heads = {c: F.col(f"`{c}`") for c in ("subject", "from", "to", "cc", "bcc", "date", "message_id", "attachment_filenames")}
    place = (F.col("source_pst_path"), F.col("source_pst_sha256"), F.col("eml_path"))
    ok, left_out = F.struct(*M.base_row(heads, *place, F.col("pdf_path"))), F.struct(*M.filtered_row(heads, *place))
    failed = [F.struct(*M.status_row(*place, F.col("pdf_path"), s, F.col("error"))) for s in ("error", "timeout")]
    row = F.when(F.col("status") == "ok", ok).when(F.col("status") == "filtered", left_out).when(F.col("status") == "error", failed[0]).otherwise(failed[1])
    return m.select(row.alias("r")).select("r.*")


@query(r"""SELECT 'eml' AS kind, count(*) AS n_files, count(DISTINCT eml_path) AS n_paths FROM eml_files WHERE regexp_matches(lower(eml_path), '[^/.]\.eml$')
UNION ALL SELECT 'pdf', count(*), count(DISTINCT pdf_path) FROM pdf_files WHERE regexp_matches(lower(pdf_path), '[^/.]\.pdf$')""")
def listing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind in ("eml", "pdf"):
        path = f"{kind}_path"
        files = table(spark, sf_dir, f"{kind}_files").where(TX.has_suffix(F.col(path), f".{kind}"))
        one = files.agg(F.lit(kind).alias("kind"), F.count("*").alias("n_files"), F.countDistinct(path).alias("n_paths"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH s AS (SELECT coalesce(p.slug, a.slug) AS slug, coalesce(n, 0) AS n FROM pst_sources a FULL JOIN (SELECT {_SLUG.format("pdf_path")} AS slug, count(DISTINCT pdf_path) AS n FROM pdf_files WHERE pdf_path <> '' GROUP BY 1) p ON a.slug = p.slug)
SELECT count(*) FILTER (n > 0) AS n_ok, count(*) FILTER (n = 0) AS n_skipped, count(*) FILTER (false) AS n_errors, cast(coalesce(sum(n), 0) AS bigint) AS n_pdfs FROM s""")
def zip_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettermill.sinks import zips

    per = table(spark, sf_dir, "pdf_files").where("pdf_path <> ''").groupBy(reconcile.path_slug(F.col("pdf_path")).alias("slug")).agg(F.countDistinct("pdf_path").alias("pdf_count"))
    both = table(spark, sf_dir, "pst_sources").select("slug").join(per, "slug", "full").withColumn("pdf_count", F.coalesce("pdf_count", F.lit(0)))
    return zips.totals(both.withColumn("status", F.when(F.col("pdf_count") > 0, "ok").otherwise("skipped")))


@query(f"SELECT doc_id, 'ok' AS status, 'Message ' || doc_id AS subject, 'a.pdf;b; c.doc' AS attachments, trim(coalesce(text, ''), {_WS}) AS body FROM documents")
def parsed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw multipart messages made from the documents, parsed again."""
    part = "--cut\nContent-Type: {0}; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"
    file = "--cut\nContent-Type: application/pdf\nContent-Disposition: {1}; filename=\"{0}\"\n\nx\n"
    raw = F.concat(
        F.lit("Subject: Message "), F.col("doc_id").cast("string"), F.lit("\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=cut\n\n"),
        F.lit(part.format("text/html") + "<p>not shown</p>\n"), F.lit(part.format("text/plain")), TX.blank_if_null(F.col("text")),
        F.lit("\n" + file.format("dir/a.pdf", "attachment") + file.format("b; c.doc", "inline") + file.format("no.pdf", "none") + "--cut--\n"),
    )
    got = messages.parse_content(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.encode(raw, "UTF-8").alias("content")))
    return got.select(F.col("key").alias("doc_id"), "status", "subject", F.array_join("attachments", ";").alias("attachments"), "body")


@query()
def header_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact participants of raw headers made from the manifest."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), TX.sanitize_header(F.col(f"`{c}`")), F.lit("\n"))
    raw = F.concat(line("From", "from"), line("To", "to"), line("Cc", "cc"), line("Bcc", "bcc"), F.lit("\n"))
    got = messages.parse_content(_manifest(spark, sf_dir).select(F.col("seq").alias("key"), F.encode(raw, "UTF-8").alias("content")), headers_only=True)
    return got.select(F.col("key").alias("seq"), "status", F.array_join(F.array_sort("participants"), ",").alias("people"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.binary_digests(table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))).select(F.col("path").alias("doc_id"), F.col("sha256").alias("digest"))
