"""Queries of the general data-preparation problems over the manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lettermill.functions import dates, split
from lettermill.operators import redelivery
from lettermill.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.found(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "pst_sources"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.found(table(spark, sf_dir, "manifest"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redelivery.repeated_rows(table(spark, sf_dir, "manifest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p4_found": p4_found, "p6_found": p6_found}

SQL: dict[str, str] = {
    "p6_found": r"""
WITH RECURSIVE rows_ AS (
  SELECT seq, CASE WHEN trim(regexp_replace(eml_path, '\s+', '', 'g')) <> '' THEN eml_path END AS p,
         CASE WHEN contains(message_id, '@') THEN lower(regexp_replace(message_id, '[\s<>]+', '', 'g')) END AS m
  FROM manifest),
firsts AS (SELECT seq, p, m, CASE WHEN p IS NULL THEN seq ELSE min(seq) OVER (PARTITION BY p) END AS fp,
                  CASE WHEN m IS NULL THEN seq ELSE min(seq) OVER (PARTITION BY m) END AS fm FROM rows_),
links AS (SELECT seq AS a, fp AS b FROM firsts UNION SELECT fp, seq FROM firsts
          UNION SELECT seq, fm FROM firsts UNION SELECT fm, seq FROM firsts),
reach AS (SELECT DISTINCT a, b FROM links WHERE a <> b
          UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a WHERE l.b <> l.a)
SELECT a AS seq FROM reach GROUP BY a HAVING min(b) < a
"""
}
