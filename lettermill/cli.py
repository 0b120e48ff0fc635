"""Command line: run, validate, repair and zip a case."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time

from pyspark.sql import functions as F

from lettermill.operators import participants, reconcile
from lettermill.plans import cases
from lettermill.schema import SUMMARY_FIELDS
from lettermill.session import builder
from lettermill.sinks import zips
from lettermill.sources import copies, files


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lettermill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="extract, convert and validate a case")
    run.add_argument("case_dir")
    run.add_argument("--mode", choices=("fast", "weasyprint"), default="fast")
    run.add_argument("--workers", type=int, default=8)
    run.add_argument("--timeout-seconds", type=float, default=60)
    run.add_argument("--stable-seconds", "--eml-stability-seconds", dest="stable_seconds", type=float, default=10)
    run.add_argument("--filter-emails", help="addresses, by comma")
    run.add_argument("--filter-file")
    for flag in ("--force-extract", "--force-filter", "--validate-only", "--dry-run"):
        run.add_argument(flag, action="store_true")
    run.add_argument("--eml-stability-check-interval", type=float, default=2)
    run.add_argument("--eml-stability-max-wait", type=float, default=600)
    one = sub.add_parser("convert", help="convert the messages of one archive")
    for flag in ("--source-pst", "--eml-dir", "--pdf-dir", "--manifest", "--log-file"):
        one.add_argument(flag, required=True)
    one.add_argument("--case-dir")
    one.add_argument("--force", action="store_true", help="write into existing output")
    one.add_argument("--resume", action="store_true", help="leave what the manifest has settled")
    one.add_argument("--mode", choices=("fast", "weasyprint"), default="fast")
    one.add_argument("--workers", type=int, default=8)
    one.add_argument("--timeout-seconds", type=float, default=60, help="per message; 0 for none")
    one.add_argument("--eml-stability-seconds", type=float, default=10)
    one.add_argument("--eml-stability-check-interval", type=float, default=2)
    one.add_argument("--eml-stability-max-wait", type=float, default=600)
    one.add_argument("--filter-file")
    one.add_argument("--filter-email", action="append", default=[])
    copy = sub.add_parser("copy", help="copy archives into a case")
    copy.add_argument("case_dir")
    copy.add_argument("sources", help="a folder, or archives by comma")
    check = sub.add_parser("validate", help="compare files and manifests")
    check.add_argument("case_dir")
    fix = sub.add_parser("repair", help="reduce manifests to one row per message; shows what it would do unless --apply")
    fix.add_argument("case_dir")
    fix.add_argument("slugs", nargs="*")
    which = fix.add_mutually_exclusive_group()
    which.add_argument("--apply", action="store_true")
    which.add_argument("--dry-run", action="store_true")
    pack = sub.add_parser("zip", help="one ZIP archive per PDF folder")
    pack.add_argument("case_dir")
    pack.add_argument("--dry-run", action="store_true")
    return p


def _convert(a: argparse.Namespace) -> int:
    """0 if every message came through, 1 if any failed or timed out; other problems end the program."""
    for path, there in ((a.source_pst, os.path.isfile), (a.eml_dir, os.path.isdir), (a.filter_file, os.path.isfile)):
        if path is not None and not there(path):
            raise SystemExit(f"not found: {path}")
    if a.workers < 1 or min(a.timeout_seconds, a.eml_stability_seconds) < 0:
        raise SystemExit("there must be a worker, and times must not be negative")
    wanted = participants.parse_list(",".join(a.filter_email))
    if a.filter_file:
        with open(a.filter_file, encoding="utf-8") as f:
            lines = [participants.normalized(x) for x in f if not x.strip().startswith("#")]
        wanted = list(dict.fromkeys([*filter(None, lines), *wanted]))
    asked = a.filter_file or a.filter_email
    if asked and not wanted:
        raise SystemExit("a filter was asked for but has no address")
    os.makedirs(os.path.dirname(os.path.abspath(a.log_file)), exist_ok=True)
    log = logging.getLogger("lettermill.convert")
    log.setLevel(logging.INFO)
    handler = logging.FileHandler(a.log_file, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(handler)
    spark = builder(cores=str(a.workers)).getOrCreate()
    slug = os.path.splitext(os.path.basename(a.manifest))[0]
    job = cases.Job(a.source_pst, slug, os.path.abspath(a.eml_dir), os.path.abspath(a.pdf_dir), os.path.abspath(a.manifest))
    began = time.monotonic()
    try:
        log.info("start archive=%s mode=%s workers=%d", a.source_pst, a.mode, a.workers)
        stable = cases.wait_until_stable(spark, job.eml_dir, a.eml_stability_seconds, a.eml_stability_check_interval, a.eml_stability_max_wait)
        filters = spark.createDataFrame([(x,) for x in wanted], "address string") if asked else None
        counts = cases.convert(spark, job, a.case_dir or os.path.dirname(job.eml_dir), a.mode, a.timeout_seconds, filters, a.resume, a.force)
        seconds = time.monotonic() - began
        done = sum(n for k, n in counts.items() if not k.startswith("status_"))
        log.info("end messages=%d bytes=%d counts=%s %s", stable[0], stable[1], counts, copies.progress(done, done, seconds))
        print(*(f"{k}={v:,}" for k, v in sorted(counts.items())), f"elapsed={copies.clock(seconds)}")
        bad = counts.get("status_error", 0) + counts.get("status_timeout", 0)
        if bad:
            log.error("messages not converted: %d; the manifest names them", bad)
        return int(bad > 0)
    except KeyboardInterrupt:
        log.warning("interrupted after %s", copies.clock(time.monotonic() - began))
        raise
    finally:
        log.removeHandler(handler)
        handler.close()


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "zip" and (not os.path.isdir(a.case_dir) or not os.path.isdir(os.path.join(a.case_dir, "output"))):
        print(f"no case with an output folder: {a.case_dir}", file=sys.stderr)
        return 2
    if a.command == "copy":
        for c in copies.copy_archives(files.discover_archives(a.sources), os.path.join(a.case_dir, "input")):
            print("there" if c.done else "copied", c.source, c.target)
        return 0
    if a.command == "convert":
        try:
            return _convert(a)
        except KeyboardInterrupt:
            return 130
    spark = builder(cores=str(getattr(a, "workers", "*"))).getOrCreate()
    try:
        if a.command == "run":
            wanted = None
            if a.filter_emails or a.filter_file:
                wanted = participants.parse_list(a.filter_emails)
                if a.filter_file:
                    with open(a.filter_file, encoding="utf-8") as f:
                        wanted += [x for x in (participants.normalized(line) for line in f if not line.strip().startswith("#")) if x]
            return cases.run_case(spark, a.case_dir, a.mode, a.timeout_seconds, a.force_extract, a.validate_only, a.dry_run, a.stable_seconds, wanted, a.force_filter, a.eml_stability_check_interval, a.eml_stability_max_wait)
        if a.command == "validate":
            jobs = cases.archive_jobs(spark, os.path.abspath(a.case_dir))
            rows = reconcile.with_total(cases.validate(spark, jobs)).withColumn("bad", reconcile.has_consistency_errors()).withColumn("issues", reconcile.issues()).orderBy(F.col("slug").asc_nulls_last()).collect()
            for r in rows:
                print(r.slug or "case", *(f"{f}={r[f]}" for f in SUMMARY_FIELDS), *r.issues)
            return int(any(r.bad for r in rows))
        if a.command == "repair":
            slugs = [s for v in a.slugs for s in (x.strip() for x in v.split(",")) if s]
            for r in cases.repair(spark, os.path.abspath(a.case_dir), slugs, a.apply):
                print(*(f"{k}={v}" for k, v in r.items()))
            return 0
        results = zips.zip_case(spark, os.path.abspath(a.case_dir), a.dry_run).collect()
        for r in results:
            print(r.slug, r.pdf_count, r.status, r.error)
        return int(any(r.status == "error" for r in results))
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
