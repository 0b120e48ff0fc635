"""A whole case: archives, their messages, conversion, validation, repair and export."""

from __future__ import annotations

import os
import shutil
import subprocess
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import text as TX
from lettermill.operators import decide as D
from lettermill.operators import manifest as M
from lettermill.operators import ordering, participants, reconcile
from lettermill.schema import FILTERED_ERROR, MANIFEST, SUMMARY_FIELDS
from lettermill.session import cut, ship, spread
from lettermill.sinks import pdf
from lettermill.sources import files, manifests, messages


MANIFEST_DDL = ", ".join(f"`{f}` string" for f in MANIFEST.fieldNames())


@dataclass(frozen=True)
class Job:
    """One archive of a case and where its results go."""

    archive: str
    slug: str
    eml_dir: str
    pdf_dir: str
    manifest: str


def archive_jobs(spark: SparkSession, case_dir: str) -> list[Job]:
    """Jobs of the archives in ``input``, sorted; slugs that collide get a digest from the second on."""
    found = files.discover_archives(os.path.join(case_dir, "input")) if os.path.isdir(os.path.join(case_dir, "input")) else []
    if not found:
        return []
    named = unique_slugs(spark.createDataFrame([(k, p) for k, p in enumerate(found)], "place bigint, path string"))
    out = os.path.join(case_dir, "output")
    return [Job(r.path, r.slug, os.path.join(out, r.slug, "eml"), os.path.join(out, r.slug, "pdf"), os.path.join(out, r.slug, "manifest", f"{r.slug}.csv")) for r in named.orderBy("place").collect()]


def unique_slugs(archives: DataFrame, path: str = "path", place: str = "place") -> DataFrame:
    """Add ``slug``: the archive's own, or with a digest where an earlier archive has the same.

    The earlier one is the first by ``place``, a minimum per slug, so no group meets in one task.
    """
    base = archives.withColumn("__slug", TX.archive_slug(F.col(path)))
    first = base.groupBy(F.col("__slug").alias("__s")).agg(F.min(place).alias("__first"))
    joined = base.join(first, F.col("__slug") == F.col("__s"))
    return joined.withColumn("slug", F.when(F.col(place) == F.col("__first"), F.col("__slug")).otherwise(TX.slug_with_digest(F.col("__slug"), F.col(path)))).drop("__slug", "__s", "__first")


def extract(job: Job, force: bool = False, dry_run: bool = False) -> bool:
    """Unpack an archive with ``readpst``; skipped where messages are already there."""
    if os.path.isdir(job.eml_dir) and next(iter(files._walk(job.eml_dir, ".eml", True)), None) and not force:
        return False
    if dry_run:
        return False
    if not shutil.which("readpst"):
        raise RuntimeError("readpst is not installed, and there are no extracted messages")
    os.makedirs(job.eml_dir, exist_ok=True)
    subprocess.run(["readpst", "-e", "-D", "-o", job.eml_dir, job.archive], check=True, capture_output=True)
    return True


def wait_until_stable(spark: SparkSession, root: str, quiet: float = 10, every: float = 2, most: float = 600) -> tuple[int, int, Any]:
    """Wait until a tree's count, bytes and latest change stay the same for ``quiet`` seconds; 0 doesn't wait."""
    if quiet < 0 or every <= 0 or most < 0:
        raise ValueError("waiting times must be positive")
    if 0 < most < quiet:
        raise ValueError("the longest wait must not be shorter than the quiet time")

    def snapshot() -> tuple[int, int, Any]:
        rows = list(files._walk(root, ".eml", True)) if os.path.isdir(root) else []
        return len(rows), sum(r[1] for r in rows), max((r[2] for r in rows), default=0.0)

    last, since, began = snapshot(), time.monotonic(), time.monotonic()
    while time.monotonic() - since < quiet:
        if time.monotonic() - began > most:
            raise TimeoutError(f"{root} kept changing for {most:g} seconds")
        time.sleep(min(every, quiet))
        now = snapshot()
        if now != last:
            last, since = now, time.monotonic()
    return last


def tasks(spark: SparkSession, job: Job) -> DataFrame:
    """(msg_index, eml_path, pdf_path) of an archive's messages, numbered in path order."""
    listed = files.list_files(spark, job.eml_dir, ".eml").select(F.col("path").alias("eml_path"), F.lit(job.slug).alias("slug"))
    placed = ordering.dense_positions(listed, "slug", [ordering.path_order()], "msg_index")
    name = TX.output_pdf_name(F.col("msg_index"), F.col("eml_path"), F.lit(job.eml_dir))
    return placed.select("msg_index", "eml_path", F.concat(F.lit(job.pdf_dir + "/"), name).alias("pdf_path"))


def _convert(job: Job, digest: str, mode: str, timeout: float, case_dir: str) -> Any:
    names = [*MANIFEST.fieldNames()]
    schema = messages.arrow_schema(MANIFEST_DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = {"source_pst_path": job.archive, "source_pst_sha256": digest}
        above = os.path.dirname(case_dir.rstrip("/"))

        def convert_one(eml: str, target: str, what: str) -> dict[str, Any]:
            got = messages.parse_message(files.read_bytes(eml), with_body=what == "convert")
            heads = {k: got[k] for k in ("subject", "from", "to", "cc", "bcc", "date", "message_id")}
            if what == "convert":
                shown = os.path.relpath(eml, above) if eml.startswith(above + "/") else eml
                labels = dict(zip(pdf.HEADER_LABELS, [*heads.values(), shown, "; ".join(got["attachments"])], strict=True))
                pdf.render(mode, target, labels, got["body"])
            return heads | {"attachment_filenames": "|".join(got["attachments"]), "status": "ok", "parse_error": ""}

        def made() -> Iterator[dict[str, Any]]:
            for batch in batches:
                for eml, target, what in zip(*(batch.column(c).to_pylist() for c in ("eml_path", "pdf_path", "decision")), strict=True):
                    row = messages.guarded(lambda eml=eml, target=target, what=what: convert_one(eml, target, what), timeout)
                    yield dict.fromkeys(names, "") | base | {"eml_path": eml, "pdf_path": target} | row | {"error": row["parse_error"]}

        yield from messages.in_batches(made(), schema)

    return run


def convert(spark: SparkSession, job: Job, case_dir: str, mode: str = "fast", timeout: float = 60, filters: DataFrame | None = None, resume: bool = True, force: bool = False) -> dict[str, int]:
    """Convert what is still to do of an archive and write its manifest; returns the counts per decision and status.

    Messages settled by the manifest are never opened; those a filter leaves out are read up to their headers.
    """
    ship(spark)
    if not resume and not force and (os.path.exists(job.manifest) or os.path.isdir(job.pdf_dir) and os.listdir(job.pdf_dir)):
        raise FileExistsError(f"{job.pdf_dir} or its manifest has contents; resume or force")
    stored = cut(manifests.read_csv(spark, job.manifest)) if resume else spark.createDataFrame([], manifests.read_csv(spark, "").schema)
    if resume:
        manifests.backup(job.manifest)
    existing = files.list_files(spark, job.pdf_dir, ".pdf").select(F.col("path").alias("pdf_path"))
    todo = cut(tasks(spark, job))
    active = filters is not None
    if active and filters.isEmpty():
        raise ValueError("a filter was asked for but has no address")
    planned = cut(D.decide(todo, stored, existing, filter_active=False, resume=resume)) if not active else None
    heads = None
    if active:
        first = cut(D.decide(todo.withColumn("matched", F.lit(False)), stored, existing, True, resume).drop("matched"))
        heads = messages.read_headers(first.where("decision = 'filter'").select("eml_path"), timeout)
        heads = cut(participants.matching(heads, "participants", filters).withColumn("parse_failed", F.col("parse_error") != ""))
        known = heads.select("eml_path", "matched", "parse_failed")
        again = first.join(known, "eml_path", "left").withColumn("decision", F.when((F.col("decision") == "filter") & (F.coalesce("matched", F.lit(False)) | F.coalesce("parse_failed", F.lit(False))), "convert").otherwise(F.col("decision")))
        planned = cut(again.select("msg_index", "eml_path", "pdf_path", "decision"))
    digest = files.sha256_file(job.archive) if os.path.exists(job.archive) else ""
    work = planned.where(F.col("decision").isin("convert", "recover")).select("eml_path", "pdf_path", "decision")
    done = cut(spread(work).mapInArrow(_convert(job, digest, mode, timeout, case_dir), MANIFEST_DDL))
    if active:
        out = planned.where("decision = 'filter'").select("eml_path").join(heads, "eml_path")
        columns = {c: F.col(f"`{c}`") for c in ("subject", "from", "to", "cc", "bcc", "date", "message_id")}
        done = done.unionByName(out.select(*M.filtered_row(columns, F.lit(job.archive), F.lit(digest), F.col("eml_path"))))
    # rows that stay, without those just made anew: a message has one row
    kept = M.kept_on_resume(M.deduplicate_for_resume(stored)).join(done.select("eml_path"), "eml_path", "left_anti")
    both = cut(kept.select("first_seq", *[f"`{c}`" for c in MANIFEST.fieldNames()]).unionByName(done.withColumn("first_seq", F.lit(1 << 62)), allowMissingColumns=True))
    manifests.write_csv(both.withColumn("at", F.struct("first_seq", F.split("eml_path", "/"))), job.manifest, "at")
    counts = {r[0]: r[1] for r in D.run_counters(planned).collect()}
    return counts | {f"status_{r[0]}": r[1] for r in done.groupBy("status").count().collect()}


def validate(spark: SparkSession, jobs: list[Job]) -> DataFrame:
    """The twelve counts per archive slug, read from the files."""
    out = None
    for job in jobs:
        m = manifests.read_csv(spark, job.manifest)
        e = files.list_files(spark, job.eml_dir, ".eml").select(F.col("path").alias("eml_path"))
        p = files.list_files(spark, job.pdf_dir, ".pdf").select(F.col("path").alias("pdf_path"))
        one = reconcile.summaries(m, e, p).agg(*[F.coalesce(F.sum(f), F.lit(0)).cast("bigint").alias(f) for f in SUMMARY_FIELDS]).withColumn("slug", F.lit(job.slug))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "slug string, " + ", ".join(f"{f} bigint" for f in SUMMARY_FIELDS))
    return out.select("slug", *SUMMARY_FIELDS)


def repair(spark: SparkSession, case_dir: str, slugs: list[str] | None = None, apply: bool = False) -> list[dict[str, Any]]:
    """Reduce manifests to the best row per message. Without ``apply`` nothing is written."""
    root, results = os.path.join(case_dir, "output"), []
    for slug in slugs or (sorted(os.listdir(root)) if os.path.isdir(root) else []):
        job = Job("", slug, os.path.join(root, slug, "eml"), os.path.join(root, slug, "pdf"), os.path.join(root, slug, "manifest", f"{slug}.csv"))
        rows = cut(manifests.read_csv(spark, job.manifest))
        there = files.list_files(spark, job.pdf_dir, ".pdf").select(F.col("path").alias("pdf_path"))
        better = cut(M.deduplicate_for_repair(rows, there))
        before, after = rows.count(), better.count()
        saved = None
        if apply and before:
            saved = manifests.backup(job.manifest)
            manifests.write_csv(better.withColumn("at", F.struct("without_path", "repair_order")), job.manifest, "at")
        results.append({"slug": slug, "rows_before": before, "rows_after": after, "removed": before - after, "backup": saved})
    return results


def run_case(spark: SparkSession, case_dir: str, mode: str = "fast", timeout: float = 60, force_extract: bool = False, validate_only: bool = False, dry_run: bool = False, quiet: float = 10, filter_emails: list[str] | None = None, force_filter: bool = False, every: float = 2, most: float = 600) -> int:
    """Extract, convert and validate a case; 0 if consistent, 1 if not."""
    case_dir = os.path.abspath(os.path.expanduser(case_dir))
    began = time.monotonic()
    filters = None
    if filter_emails is not None and not dry_run and not validate_only:
        clean = [a for a in map(participants.normalized, filter_emails) if a]
        if not clean:
            raise ValueError("a filter was asked for but has no address")
        participants.guard_case_filter(case_dir, clean, force_filter)
        filters = spark.createDataFrame([(a,) for a in dict.fromkeys(clean)], "address string")
    jobs = archive_jobs(spark, case_dir)
    if not dry_run and not validate_only:
        for job in jobs:
            extract(job, force_extract)
            wait_until_stable(spark, job.eml_dir, quiet, every, most)
            convert(spark, job, case_dir, mode, timeout, filters)
    total = validate(spark, jobs).agg(*[F.coalesce(F.sum(f), F.lit(0)).cast("bigint").alias(f) for f in SUMMARY_FIELDS]).withColumn("bad", reconcile.has_consistency_errors()).first()
    print(case_report(case_dir, len(jobs), total.asDict(), time.monotonic() - began))
    return int(total.bad)


def elapsed(seconds: float) -> str:
    s = int(seconds)
    return f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"


def case_report(case_dir: str, n_archives: int, total: dict[str, Any], seconds: float) -> str:
    """The case's counts as text; no message content."""
    lines = [f"Case {case_dir}, {datetime.now():%Y-%m-%d %H:%M}", f"{'archives':<46}{n_archives:,}"]
    lines += [f"{f.replace('_', ' '):<46}{total[f]:,}" for f in SUMMARY_FIELDS]
    lines += [f"{'elapsed':<46}{elapsed(seconds)}", f"Status: {'NEEDS ATTENTION' if total['bad'] else 'PASS'}"]
    return "\n".join(lines)


__all__ = ["FILTERED_ERROR", "Job", "archive_jobs", "case_report", "convert", "extract", "repair", "run_case", "tasks", "unique_slugs", "validate", "wait_until_stable"]
