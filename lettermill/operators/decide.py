"""What to do with each message of a run: the incremental decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.operators import manifest as M


def decision(ok: Column, filtered: Column, pdf_exists: Column, matched: Column, parse_failed: Column, filter_active: bool, resume: bool) -> Column:
    """The first of: skip, skip a filtered one, recover, convert what can't be checked, filter, convert."""
    active = F.lit(filter_active)
    return (
        F.when(ok, "skip_ok")
        .when(active & filtered, "skip_filtered")
        .when(F.lit(resume) & pdf_exists, "recover")
        .when(active & parse_failed, "convert")
        .when(active & ~matched, "filter")
        .otherwise("convert")
    )


def done_before(stored: DataFrame) -> DataFrame:
    """(eml_path, ok, filtered) of the messages whose deduplicated row needn't be redone."""
    kept = M.kept_on_resume(M.deduplicate_for_resume(stored.select("seq", "eml_path", "status")))
    return kept.select("eml_path", (F.col("status") == "ok").alias("ok"), (F.col("status") == "filtered").alias("filtered"))


def decide(tasks: DataFrame, stored: DataFrame, pdfs: DataFrame, filter_active: bool, resume: bool = True) -> DataFrame:
    """Add ``decision`` to ``tasks`` (eml_path, pdf_path, and, if known, matched and parse_failed).

    Messages that are skipped or recovered are settled by paths alone, so their content is never read.
    """
    columns = tasks.columns
    matched = F.coalesce(F.col("matched"), F.lit(False)) if "matched" in columns else F.lit(True)
    failed = F.coalesce(F.col("parse_failed"), F.lit(False)) if "parse_failed" in columns else F.lit(False)
    there = pdfs.select(F.col("pdf_path").alias("__pdf")).where("__pdf <> ''").distinct()
    joined = tasks.join(done_before(stored), "eml_path", "left").join(there, F.col("pdf_path") == F.col("__pdf"), "left")
    truth = lambda c: F.coalesce(F.col(c), F.lit(False))
    what = decision(truth("ok"), truth("filtered"), F.col("__pdf").isNotNull(), matched, failed, filter_active, resume)
    return joined.withColumn("decision", what).select(*columns, "decision")


def run_counters(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision").agg(F.count("*").alias("n_messages"))
