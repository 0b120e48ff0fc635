"""Messages delivered more than once: keep one row per message (problem 6).

Two keys name a message: its path and its message id. Each becomes a 128-bit
identifier; exact quotient tables give the smallest ``seq`` per identifier.
Every row then points from itself to the smallest row of its path and of its
id. Rows that point nowhere may still be joined through a third row, so the
pointers are reduced until each row has one, which leads to the smallest row of
its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.operators.quotient import QuotientTable, permute
from lettermill.session import cut, parallelism, ship

#: Identifiers that one task holds before it passes on its partial result. A memory bound, not a limit: what
#: is passed on early is merged in the next stage.
FLUSH_AT = 1 << 20

#: Identifiers of one shard, about. A shard's table and batches take some 100 bytes each, 400 MB in all.
SHARD_ROWS = 1 << 22

_LOCAL = "hi bigint, lo bigint, seq bigint, first bigint"
_EDGE = "src bigint, dst bigint"


def message_key(message_id: Column) -> Column:
    """The message id without white space, angle brackets and letter case; null without an ``@``."""
    key = F.lower(F.regexp_replace(message_id, r"(?U)[\s<>]+", ""))
    return F.when(key.contains("@"), key)


def path_key(path: Column) -> Column:
    """The path itself; null if blank."""
    return F.when(F.length(F.regexp_replace(path, r"(?U)\s+", "")) > 0, path)


def _identifier(kind: str, key: Column) -> list[Column]:
    digest = F.md5(F.concat(F.lit(kind), key))
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    wide = lambda at: F.shiftleft(word(at), 32).bitwiseOR(word(at + 8))
    return [wide(1).alias("hi"), wide(17).alias("lo")]


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("hi").to_numpy().view(np.uint64), batch.column("lo").to_numpy().view(np.uint64)


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, pa.int64()) for c in columns], names=[part.split()[0] for part in schema.split(", ")])


def _first_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: each row with the smallest row of its identifier within this task.

    A representative row (``first`` equal to ``seq``) goes on to the shard of its identifier, any other only
    carries its pointer. So a hot identifier sends one row per task, or per flush, to its shard.
    """

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        hi, lo, seq = (np.concatenate(c) for c in zip(*held, strict=True))
        local = QuotientTable(max(4, int(len(hi) * 2).bit_length()))
        local.insert(hi, lo, seq)
        first = local.lookup(hi, lo)
        yield _batch(_LOCAL, hi, lo, seq, first)

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            hi, lo = permute(*_words(batch))
            held.append((hi, lo, batch.column("seq").to_numpy()))
            n += batch.num_rows
            if n >= FLUSH_AT:
                yield from flush(held)
                held, n = [], 0
    if held:
        yield from flush(held)


def _first_in_shard(skip: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = QuotientTable(10, skip), []
        for batch in batches:
            hi, lo = _words(batch)
            seq = batch.column("seq").to_numpy()
            table.insert(hi, lo, seq)
            held.append((hi, lo, seq))
        for hi, lo, seq in held:
            first = table.lookup(hi, lo)
            later = first < seq
            yield _batch(_EDGE, seq[later], first[later])

    return run


def pointers(keys: DataFrame) -> DataFrame:
    """(src, dst) from each row to the smallest row with its identifier, for (hi, lo, seq) rows."""
    ship(keys.sparkSession)
    local = cut(keys.mapInArrow(_first_local, _LOCAL))
    needed = max(parallelism(keys.sparkSession), -(-local.where("first = seq").count() // SHARD_ROWS))
    shards = 1 << (needed - 1).bit_length()
    within = local.where("first < seq").select(F.col("seq").alias("src"), F.col("first").alias("dst"))
    bits = shards.bit_length() - 1  # the leading bits of the quotient number the shards
    quotient = F.shiftrightunsigned("hi", 64 - bits) if bits else F.lit(0).cast("bigint")
    across = local.where("first = seq").select("hi", "lo", "seq").repartitionById(shards, quotient.cast("int")).mapInArrow(_first_in_shard(bits), _EDGE)
    return within.unionByName(across)


def reduce_pointers(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """One pointer per row: the forest whose roots are the smallest rows of the components.

    ``edges`` point from larger to smaller rows. A row with several pointers keeps the smallest target; its
    other targets get a pointer to that target instead, and every pointer is moved on to where its target
    points. Both lower the targets and add no edge; it ends when no row has two pointers. Chains shrink by
    half each round, so the rounds grow as the logarithm of the longest.
    """
    edges = cut(edges.distinct())
    for _ in range(rounds):
        low = cut(edges.groupBy("src").agg(F.min("dst").alias("low"), F.count("*").alias("n")))
        many = low.where("n > 1").select("src", "low")
        if many.isEmpty():
            return low.select("src", F.col("low").alias("dst"))
        spread = edges.join(many, "src").where("dst > low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        parents = low.select(F.col("src").alias("via"), F.col("low").alias("next"))
        moved = low.select("src", F.col("low").alias("dst")).unionByName(spread).join(parents, F.col("dst") == F.col("via"), "left")
        edges = cut(moved.select("src", F.coalesce("next", "dst").alias("dst")).distinct())
    raise RuntimeError(f"pointers did not settle in {rounds} rounds")


def repeated_rows(rows: DataFrame, seq: str = "seq", path: str = "eml_path", message_id: str = "message_id") -> DataFrame:
    """(seq) of every row that repeats a message whose smallest ``seq`` is another row.

    Rows are copies if their paths are equal and not blank, or their message ids agree apart from white space,
    brackets and letter case, also through third rows. Null and blank keys link nothing; a row without either
    key is a message of its own; rows with a null ``seq`` are left out; a ``seq`` that occurs twice counts
    once. An empty table gives no rows. Other columns are ignored. ``seq`` order decides, so ties can't occur.
    """
    base = rows.select(F.col(f"`{seq}`").cast("long").alias("seq"), path_key(F.col(f"`{path}`")).alias("p"), message_key(F.col(f"`{message_id}`")).alias("m")).where("seq is not null")
    both = base.select("seq", F.explode(F.array(F.when(F.col("p").isNotNull(), F.concat(F.lit("p"), "p")), F.when(F.col("m").isNotNull(), F.concat(F.lit("m"), "m")))).alias("key")).where("key is not null")
    keys = both.select(*_identifier("", F.col("key")), "seq")
    return reduce_pointers(pointers(keys)).select(F.col("src").alias("seq")).distinct()


def kept_rows(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """All columns of exactly one row per message."""
    return rows.join(repeated_rows(rows, seq), rows[seq] == F.col("seq") if seq != "seq" else "seq", "left_anti")
