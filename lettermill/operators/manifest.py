"""The manifest: its two de-duplication policies, counts and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions import text as TX
from lettermill.schema import FILTERED_ERROR, MANIFEST_FIELDS, STATUSES


def status_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or []), TX.blank_if_null(F.col("status")).alias("status")).agg(F.count("*").alias("n_rows"))


def key_counts(rows: DataFrame) -> DataFrame:
    """Rows per message path, blank paths left out."""
    return rows.where(TX.blank_if_null(F.col("eml_path")) != "").groupBy("eml_path").agg(F.count("*").alias("n_rows"))


def duplicate_count(rows: DataFrame) -> DataFrame:
    """One row: how many rows repeat a message path."""
    return key_counts(rows).agg(F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("duplicate_rows"))


def resume_winners(rows: DataFrame) -> DataFrame:
    """(eml_path, seq, first_seq): the first ok row of each path, else its last row. Blank paths are dropped."""
    ok = F.min(F.when(F.col("status") == "ok", F.col("seq")))
    keyed = rows.where(TX.blank_if_null(F.col("eml_path")) != "")
    return keyed.groupBy("eml_path").agg(F.coalesce(ok, F.max("seq")).alias("seq"), F.min("seq").alias("first_seq"))


def deduplicate_for_resume(rows: DataFrame) -> DataFrame:
    """Winning rows with all columns, and ``first_seq`` to order them by.

    Only ordinals and paths are aggregated, with partial sums before the shuffle; whole rows move once.
    """
    return rows.join(resume_winners(rows).select("seq", "first_seq"), "seq")


def repair_rank(status: Column, pdf_exists: Column) -> Column:
    """Best first: ok with its PDF, ok, timeout, error, anything else (filtered rows among these)."""
    return F.when((status == "ok") & pdf_exists, 0).when(status == "ok", 1).when(status == "timeout", 2).when(status == "error", 3).otherwise(4)


def deduplicate_for_repair(rows: DataFrame, pdfs: DataFrame) -> DataFrame:
    """The best row of each path, and all rows without a path, which come last in ``repair_order``.

    Ties go by PDF path, error and file order. ``pdfs`` lists the existing ``pdf_path`` values.
    """
    on_disk = pdfs.select(F.col("pdf_path").alias("__pdf")).where("__pdf is not null").distinct()
    slim = rows.select("seq", *[TX.blank_if_null(F.col(c)).alias(c) for c in ("eml_path", "pdf_path", "status", "error")])
    slim = slim.join(on_disk, F.col("pdf_path") == F.col("__pdf"), "left")
    rank = repair_rank(F.col("status"), F.col("__pdf").isNotNull())
    best = slim.where("eml_path <> ''").groupBy("eml_path").agg(F.min(F.struct(rank.alias("rank"), "pdf_path", "error", "seq")).alias("b"), F.min("seq").alias("first_seq"))
    kept = best.select("b.seq", F.col("first_seq").alias("repair_order"), F.lit(False).alias("without_path"))
    loose = slim.where("eml_path = ''").select("seq", F.col("seq").alias("repair_order"), F.lit(True).alias("without_path"))
    return rows.join(kept.unionByName(loose), "seq")


def kept_on_resume(deduplicated: DataFrame) -> DataFrame:
    """Rows that stay when a run is resumed: done or left out on purpose; failures are tried again."""
    return deduplicated.where(F.col("status").isin("ok", "filtered"))


def base_row(headers: dict[str, Column], source: Column, digest: Column, eml: Column, pdf: Column) -> list[Column]:
    """Columns of the row of a converted message."""
    made = {"source_pst_path": source, "source_pst_sha256": digest, "eml_path": eml, "pdf_path": pdf, "status": F.lit("ok"), "error": F.lit("")} | headers
    return [TX.blank_if_null(made.get(f, F.lit(""))).alias(f) for f in MANIFEST_FIELDS]


def status_row(source: Column, digest: Column, eml: Column, pdf: Column, status: str, error: Column) -> list[Column]:
    """Columns of the row of a message that failed: no headers."""
    if status not in STATUSES:
        raise ValueError(f"no such status: {status}")
    made = {"source_pst_path": source, "source_pst_sha256": digest, "eml_path": eml, "pdf_path": pdf, "status": F.lit(status), "error": error}
    return [TX.blank_if_null(made.get(f, F.lit(""))).alias(f) for f in MANIFEST_FIELDS]


def filtered_row(headers: dict[str, Column], source: Column, digest: Column, eml: Column) -> list[Column]:
    """Columns of the row of a message left out by the participant filter: headers, no PDF, no attachments."""
    made = {"source_pst_path": source, "source_pst_sha256": digest, "eml_path": eml, "status": F.lit("filtered"), "error": F.lit(FILTERED_ERROR)}
    made |= {k: v for k, v in headers.items() if k != "attachment_filenames"}
    return [TX.blank_if_null(made.get(f, F.lit(""))).alias(f) for f in MANIFEST_FIELDS]
