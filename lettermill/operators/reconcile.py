"""Reconciliation of files on disk, PDFs on disk and the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions import text as TX
from lettermill.schema import CONSISTENCY_FIELDS, SUMMARY_FIELDS


def path_slug(path: Column) -> Column:
    """The archive's folder in ``.../output/<slug>/...``; '' elsewhere."""
    return F.regexp_extract(TX.blank_if_null(path), r"/output/([^/]+)/", 1)


def missing_from(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct non-blank keys of ``left`` that ``right`` hasn't."""
    some = TX.blank_if_null(F.col(key)) != ""
    return left.select(key).where(some).distinct().join(right.select(key).where(some), key, "left_anti")


def ok_without_pdf(rows: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Manifest rows that claim success but whose PDF isn't there."""
    return rows.where(F.col("status") == "ok").join(pdfs.select("pdf_path").where("pdf_path <> ''").distinct(), "pdf_path", "left_anti")


def summaries(manifest: DataFrame, emls: DataFrame, pdfs: DataFrame) -> DataFrame:
    """The twelve counts per archive slug.

    The three relations meet in one aggregation by path, with partial sums before its shuffle; a second, small
    one adds up by slug. Nulls count as blanks; a file listed twice counts once.
    """
    m = manifest.select(*[TX.blank_if_null(F.col(c)).alias(c) for c in ("source_pst_path", "eml_path", "pdf_path", "status")])
    own = TX.archive_slug(F.col("source_pst_path"))
    slug = lambda path: F.when(path_slug(path) != "", path_slug(path)).otherwise(own)
    zero, one = F.lit(0), F.lit(1)

    def fact(key: Column, kind: str, path: Column, disk: Column, rows: Column, ok: Column) -> Column:
        return F.struct(key.alias("slug"), F.lit(kind).alias("kind"), path.alias("path"), disk.alias("disk"), rows.alias("rows"), ok.alias("ok"))

    eml_path, pdf_path, status = F.col("eml_path"), F.col("pdf_path"), F.col("status")
    is_ok = status == "ok"
    # one pass over the manifest gives what it says about its message, its PDF and its status
    said = F.array(
        F.when(eml_path != "", fact(slug(eml_path), "eml", eml_path, zero, one, zero)),
        F.when((pdf_path != "") | is_ok, fact(slug(pdf_path), "pdf", pdf_path, zero, one, is_ok.cast("int"))),
        fact(slug(eml_path), "row", status, zero, one, zero),
    )
    union = (
        m.select(F.explode(F.filter(said, lambda x: x.isNotNull())).alias("f"))
        .unionByName(emls.where(TX.has_suffix(eml_path, ".eml")).select(fact(path_slug(eml_path), "eml", eml_path, one, zero, zero).alias("f")))
        .unionByName(pdfs.where(TX.has_suffix(pdf_path, ".pdf")).select(fact(path_slug(pdf_path), "pdf", pdf_path, one, zero, zero).alias("f")))
        .select("f.*")
    )
    by_path = union.groupBy("slug", "kind", "path").agg(F.max("disk").alias("disk"), F.sum("rows").alias("rows"), F.sum("ok").alias("ok"))
    kind, path, disk, rows = F.col("kind"), F.col("path"), F.col("disk"), F.col("rows")
    total = lambda when, what: F.sum(F.when(when, what).otherwise(0)).cast("bigint")
    eml, pdf, row = kind == "eml", kind == "pdf", kind == "row"
    made = {
        "total_eml_files": total(eml, disk),
        "total_pdf_files": total(pdf, disk),
        "total_manifest_rows": total(row, rows),
        "successful_rows": total(row & (path == "ok"), rows),
        "failed_rows": total(row & (path == "error"), rows),
        "timeout_rows": total(row & (path == "timeout"), rows),
        "filtered_rows": total(row & (path == "filtered"), rows),
        "duplicate_eml_rows": total(eml & (rows > 1), rows - 1),
        "missing_pdfs_for_successful_rows": total(pdf & (disk == 0), F.col("ok")),
        "eml_files_missing_manifest_rows": total(eml & (rows == 0), disk),
        "manifest_eml_paths_missing_on_disk": total(eml & (disk == 0), one),
        "extra_pdf_files_not_referenced_by_manifest": total(pdf & (rows == 0), disk),
    }
    return by_path.groupBy("slug").agg(*[made[f].alias(f) for f in SUMMARY_FIELDS])


def with_total(by_slug: DataFrame) -> DataFrame:
    """Summaries by slug and, with a null slug, of the whole case."""
    return by_slug.rollup("slug").agg(*[F.sum(f).cast("bigint").alias(f) for f in SUMMARY_FIELDS])


def has_consistency_errors() -> Column:
    out = F.lit(False)
    for f in CONSISTENCY_FIELDS:
        out = out | (F.col(f) > 0)
    return out


def issues() -> Column:
    """Texts of what is inconsistent, in a fixed order."""
    # The sentences of the report.
    said = {
        "duplicate_eml_rows": "duplicate EML rows found.",
        "missing_pdfs_for_successful_rows": "successful manifest rows are missing PDFs.",
        "eml_files_missing_manifest_rows": "EML files are missing manifest rows.",
        "manifest_eml_paths_missing_on_disk": "manifest EML paths are missing on disk.",
    }
    lines = [F.when(F.col(f) > 0, F.concat(F.format_number(f, 0), F.lit(f" {text}"))) for f, text in said.items()]
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


def tree_snapshot(files: DataFrame, by: list[str], size: str = "size_bytes", at: str = "modified_at") -> DataFrame:
    """Count, bytes and latest change of file trees."""
    return files.groupBy(*by).agg(F.count("*").alias("n_files"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("total_bytes"), F.max(at).alias("newest"))
