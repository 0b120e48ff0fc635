"""Participants of messages and the filter over them."""

from __future__ import annotations

import os
from email.utils import getaddresses

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions import text as TX
from lettermill.schema import PARTICIPANT_HEADERS

#: Addresses up to which a filter is sent to every task; a larger one is joined.
FILTER_IN_TASK = 10_000


def filter_addresses(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """(address, line_no) of a filter file: one address a line, first mention counts; blanks and comments don't."""
    clean = TX.strip(TX.blank_if_null(F.col(line)))
    found = lines.where((clean != "") & ~F.startswith(clean, F.lit("#"))).select(TX.normalize_email(clean).alias("address"), F.col(order).alias("line_no"))
    return found.where("address is not null").groupBy("address").agg(F.min("line_no").alias("line_no"))


def merged_filters(*sources: DataFrame) -> DataFrame:
    """Addresses of several filter sources in order, first mention first: (address, source, line_no)."""
    out = None
    for k, s in enumerate(sources):
        one = s.select("address", F.lit(k).alias("source"), F.col("line_no").cast("bigint").alias("line_no"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no filter source")
    return out.groupBy("address").agg(F.min(F.struct("source", "line_no")).alias("first")).select("address", "first.source", "first.line_no")


def filter_fingerprint(addresses: DataFrame) -> DataFrame:
    """One row: the digest of the whole set. A filter file fits a task; a set beyond it is no filter."""
    return addresses.agg(TX.fingerprint(F.collect_set("address")).alias("fingerprint"))


def participants(headers: list[Column]) -> Column:
    """Distinct lower case addresses of simple headers, without Python."""
    return F.array_distinct(F.flatten(F.array(*[TX.addresses_in(h) for h in headers])))


def header_addresses(texts: dict[str, list[str]]) -> list[str]:
    """Distinct participants in the values of a message's headers; a header that can't be read is passed over."""
    out: dict[str, None] = {}
    for name in PARTICIPANT_HEADERS:
        try:
            pairs = getaddresses(texts.get(name, []))
        except Exception:  # noqa: BLE001, S112
            continue
        out.update(dict.fromkeys(a for _, address in pairs if "@" in (a := address.strip().lower())))
    return list(out)


def exact_participants(header: Column) -> Column:
    """Addresses of one header by the standard library's parser, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def parse(values: pd.Series) -> pd.Series:
        read = lambda v: list(dict.fromkeys(a.strip().lower() for _, a in getaddresses([v]) if "@" in a))
        return values.map(lambda v: read(v) if v else [])

    return parse(header)


def matching(messages: DataFrame, people: str, filters: DataFrame) -> DataFrame:
    """Add ``matched``: whether any of a message's participants is in the filter. An empty filter matches none.

    A filter of a bounded, counted size goes into the expression; a larger one is joined by address.
    """
    few = [r[0] for r in filters.select("address").distinct().limit(FILTER_IN_TASK + 1).collect()]
    if not few:
        return messages.withColumn("matched", F.lit(False))
    if len(few) <= FILTER_IN_TASK:
        return messages.withColumn("matched", F.coalesce(F.arrays_overlap(F.filter(people, lambda x: x.isNotNull()), F.lit(few)), F.lit(False)))
    # a message's own list is its key, so both sides agree whatever task makes them; equal lists match alike
    lists = messages.select(F.col(people).alias("__people")).where(F.size("__people") > 0).distinct()
    hits = lists.select("__people", F.explode("__people").alias("address")).join(filters.select("address").distinct(), "address", "left_semi").select("__people").distinct().withColumn("__hit", F.lit(True))
    return messages.join(hits, F.col(people) == F.col("__people"), "left").withColumn("matched", F.coalesce("__hit", F.lit(False))).drop("__people", "__hit")


def normalized(address: str | None) -> str | None:
    """``normalize_email`` for the driver."""
    clean = (address or "").strip().lower()
    left, at, right = clean.partition("@")
    return clean if at and left and right else None


def parse_list(raw: str | None) -> list[str]:
    """Addresses of a text split at line ends and commas, first mention first."""
    parts = [normalized(p) for line in (raw or "").splitlines() for p in line.split(",")]
    return list(dict.fromkeys(p for p in parts if p))


class FilterChanged(RuntimeError):
    """A case was run with another filter before."""


def guard_case_filter(case_dir: str, addresses: list[str], force: bool = False) -> str:
    """Write a case's filter and its fingerprint; refuse a filter other than the one in use, unless forced.

    A case that ran without a filter has no fingerprint, so a first filter may be added later.
    """
    import hashlib

    clean = list(dict.fromkeys(a for a in map(normalized, addresses) if a))
    digest = hashlib.sha256("\n".join(sorted(clean)).encode()).hexdigest()
    folder = os.path.join(case_dir, "config")
    mark = os.path.join(folder, "filter_emails.fingerprint")
    if os.path.exists(mark):
        with open(mark, encoding="utf-8") as f:
            before = f.read().strip()
        if before != digest and not force:
            raise FilterChanged(f"this case has a filter with fingerprint {before}; the new one has {digest}")
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, "filter_emails.txt")
    with open(target, "w", encoding="utf-8") as f:
        f.writelines(f"{a}\n" for a in clean)
    with open(mark, "w", encoding="utf-8") as f:
        f.write(digest + "\n")
    return target
