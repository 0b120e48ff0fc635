"""Filling fixed-capacity containers with documents, by mixture-controlled packing (problem 8).

Documents wait in one queue per source. A container is filled by deficit
round-robin: the source furthest below its share of the tokens gives its
largest document that still fits, and what a source got too much or too little
is carried to the next container. Windows of a few million tokens are packed
independently; a prefix sum over the windows hands each one the deficits that
those before it leave, so that the shares hold over the corpus too.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.tokens import count_tokens
from lettermill.session import cut, ship

#: Tokens that one window holds, about. Every window ends with one container that may stay part empty.
WINDOW_TOKENS = 1 << 22
MOST_CAPACITIES = 1000
#: Windows that one packing task takes, one after the other, however many there are.
WINDOWS_A_TASK = 4
#: Windows that one task of the prefix sums takes.
STRETCH = 4096

SCHEMA = "pack_id bigint, container_id bigint, doc_id bigint, piece bigint, token_start bigint, tokens bigint"


class _Queue:
    """Items of one source by size: the largest that fits is found by bisection."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.items: dict[int, list[int]] = {}

    def put(self, size: int, item: int) -> None:
        if size not in self.items:
            self.items[size] = []
            insort(self.sizes, size)
        self.items[size].append(item)

    def take(self, room: int) -> tuple[int, int] | None:
        k = bisect_right(self.sizes, room) - 1
        if k < 0:
            return None
        size = self.sizes[k]
        item = self.items[size].pop()
        if not self.items[size]:
            del self.items[size], self.sizes[k]
        return size, item


def pack_window(sizes: np.ndarray, sources: np.ndarray, capacity: int, deficit: np.ndarray, share: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(container, item, piece, start, tokens) of one window.

    ``sources`` are positions in ``deficit`` and ``share``. An item larger than the capacity is cut into full
    containers and a rest; no other is cut. ``deficit`` is updated in place.
    """
    out: list[tuple[int, int, int, int, int]] = []
    queues = [_Queue() for _ in share]
    full = 0
    pieces = {}
    for item in np.lexsort((np.arange(len(sizes)), sizes)):
        size, rest = int(sizes[item]), int(sizes[item]) % capacity if sizes[item] > capacity else int(sizes[item])
        if size > capacity:
            whole = size // capacity
            for p in range(whole):
                out.append((full, int(item), p + 1, p * capacity, capacity))
                full += 1
            pieces[int(item)] = whole
            deficit += share * (whole * capacity)
            deficit[sources[item]] -= whole * capacity
        if rest:
            queues[sources[item]].put(rest, int(item))
    never = np.iinfo(np.int64).max
    smallest = np.array([q.sizes[0] if q.sizes else never for q in queues], np.int64)
    container = full
    while smallest.min(initial=never) < never:
        room = capacity
        while True:
            fits = smallest <= room
            if not fits.any():
                break
            s = int(np.argmax(np.where(fits, deficit, -np.inf)))
            size, item = queues[s].take(room)
            smallest[s] = queues[s].sizes[0] if queues[s].sizes else never
            whole = pieces.get(item, 0)
            out.append((container, item, whole + 1, whole * capacity, size))
            room -= size
            deficit += share * size
            deficit[s] -= size
        container += 1
    return out


def _pack_group(capacities: list[tuple[int, int]]) -> object:
    def run(key: tuple, items: pa.Table, state: pa.Table) -> pa.Table:
        window = key[0].as_py()
        names = state.column("src").to_pylist()
        place = {s: k for k, s in enumerate(names)}
        sizes = items.column("tokens").to_numpy()
        docs = items.column("doc_id")
        order = np.argsort(items.column("row").to_numpy(), kind="stable")
        sizes, docs = sizes[order], docs.take(pa.array(order))
        sources = np.array([place[s] for s in items.column("source").to_pylist()], np.int64)[order]
        tables = []
        for pack_id, capacity in capacities:
            got = np.array(pack_window(sizes, sources, capacity, state.column("deficit").to_numpy().copy(), state.column("share").to_numpy()), np.int64).reshape(-1, 5)
            tables.append(
                pa.table(
                    {
                        "pack_id": pa.array(np.full(len(got), pack_id, np.int64)),
                        "container_id": pa.array((np.int64(window) << 32) + got[:, 0]),
                        "doc_id": docs.take(pa.array(got[:, 1])),
                        "piece": pa.array(got[:, 2]),
                        "token_start": pa.array(got[:, 3]),
                        "tokens": pa.array(got[:, 4]),
                    }
                )
            )
        return pa.concat_tables(tables)

    return run


def totals_before(sums: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``before``: the sum of ``value`` over all earlier windows with the same keys.

    Prefix sums run within stretches of windows, and once more over the stretches' totals, so no task sorts
    all windows.
    """
    sums = sums.withColumn("stretch", F.floor(F.col("window") / STRETCH))
    ends = sums.groupBy(*keys, "stretch").agg(F.sum(value).alias("whole"))
    earlier = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("until", F.coalesce(F.sum("whole").over(earlier), F.lit(0))).drop("whole")
    within = Window.partitionBy(*keys, "stretch").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    return sums.join(ends, [*keys, "stretch"]).withColumn("before", F.col("until") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("until", "stretch")


def pack_sized(sized: DataFrame, capacities: list[tuple[int, int]], window_tokens: int = WINDOW_TOKENS, weights: DataFrame | None = None) -> DataFrame:
    """Containers for (doc_id, source, tokens) rows; see ``pack_documents``."""
    ship(sized.sparkSession)
    if not capacities or len(capacities) > MOST_CAPACITIES or any(c < 1 for _, c in capacities):
        raise ValueError(f"1 to {MOST_CAPACITIES} capacities of at least one token are needed")
    rows = cut(sized.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("tokens").cast("long").alias("tokens")).where("tokens > 0").withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    windows = max(1, -(-total // window_tokens))
    rows = rows.withColumn("window", F.pmod(F.xxhash64("row"), F.lit(windows)))
    # tokens by window and source; what the windows before leave is a prefix sum
    held = rows.groupBy("window", "source").agg(F.sum("tokens").alias("held"))
    if weights is None:
        shares = rows.groupBy("source").agg((F.sum("tokens") / F.lit(float(max(total, 1)))).alias("share"))
    else:
        w = weights.groupBy("source").agg(F.sum("weight").alias("w"))
        shares = rows.select("source").distinct().join(w, "source", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        whole = shares.agg(F.sum("w")).first()[0] or 1.0
        shares = shares.select("source", (F.col("w") / F.lit(float(whole))).alias("share"))
    per_window = totals_before(held.groupBy("window").agg(F.sum("held").alias("all")), [], "all").select("window", F.col("before").alias("all_before"))
    before = totals_before(held, ["source"], "held").withColumnRenamed("before", "held_before").join(per_window, "window")
    state = (
        before.join(shares, "source")
        .select(F.col("window").alias("win"), F.col("source").alias("src"), F.col("share").alias("share"), (F.col("share") * F.col("all_before") - F.col("held_before")).alias("deficit"))
    )
    n = -(-windows // WINDOWS_A_TASK)
    left, right = rows.repartition(n, "window").groupBy("window"), state.repartition(n, "win").groupBy("win")
    return left.cogroup(right).applyInArrow(_pack_group(capacities), SCHEMA)


def pack_documents(docs: DataFrame, capacities: list[tuple[int, int]], vocabulary: str | None = None, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Containers of every capacity (``pack_id``, tokens) for the ``doc_id``, ``source`` and ``text`` of ``docs``.

    One row per document and container: its ``piece`` counts from 1 and spans ``tokens`` tokens from
    ``token_start``. A document has one piece unless it exceeds the capacity by itself. Null, empty and other
    texts of zero tokens need no container and have no row. A null source is a source of its own; repeated rows
    are items of their own; an empty table gives no rows; other columns are ignored. Ties in size are resolved
    by the order of the rows as read.
    """
    return pack_sized(count_tokens(docs, ["doc_id", "source"], vocabulary=vocabulary), capacities, window_tokens)
