"""New messages as a stream of files: each once, when it has been quiet long enough, into the stored manifest."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lettermill.operators import manifest as M
from lettermill.operators import ordering
from lettermill.session import cut
from lettermill.sources import files, messages

#: Rows of one micro-batch, so that its ordinals fit below the next batch's.
BATCH_BITS = 40


def new_only(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Of a batch the messages that the manifest hasn't settled."""
    settled = M.kept_on_resume(stored).select("eml_path").where("eml_path <> ''").distinct()
    return batch.join(settled, "eml_path", "left_anti")


def arrivals(spark: SparkSession, root: str, quiet: float = 0) -> DataFrame:
    """(eml_path, modified_at, size_bytes) of the messages now in a tree that haven't changed for ``quiet`` seconds.

    The listing is our own, since Spark's file sources pass over names that start with a dot or an underscore.
    """
    listed = files.list_files(spark, root, ".eml").withColumnRenamed("path", "eml_path")
    return listed.where(F.col("modified_at") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(quiet)))) if quiet > 0 else listed


def take_in(spark: SparkSession, root: str, table: str, timeout: float = 60, quiet: float = 0) -> int:
    """Parse what has arrived and isn't settled, append its manifest rows as one batch, return the batch's number.

    The stored rows are the state: a batch that breaks off leaves no committed folder and is made anew, a
    settled message is never read again, and one that failed is tried with the next batch. ``seq`` is the
    batch's number above a dense ordinal, so no two rows share one.
    """
    done = sorted(int(n.split("=")[1]) for n in os.listdir(table) if n.startswith("batch=") and os.path.exists(f"{table}/{n}/_SUCCESS")) if os.path.isdir(table) else []
    number = done[-1] + 1 if done else 0
    fresh = arrivals(spark, root, quiet).select("eml_path")
    if done:
        fresh = new_only(fresh, spark.read.option("basePath", table).parquet(*[f"{table}/batch={n}" for n in done]))
    fresh = cut(fresh)
    if fresh.isEmpty():
        return number
    heads = messages.read_headers(fresh, timeout).drop("participants")
    placed = ordering.dense_positions(heads.withColumn("all", F.lit(0)), "all", [ordering.path_order()], "place")
    rows = placed.withColumn("seq", F.lit(number) * F.lit(1 << BATCH_BITS) + F.col("place"))
    rows.drop("all", "place").write.mode("overwrite").parquet(f"{table}/batch={number}")
    return number


def start_intake(spark: SparkSession, root: str, table: str, checkpoint: str, every: str = "10 seconds", timeout: float = 60, quiet: float = 10) -> StreamingQuery:
    """A running stream that takes in what has arrived at every tick.

    The ticks come from a clock, not from Spark's file source, which would miss hidden names; what a tick finds
    to do follows from the stored rows, so a tick that is replayed, or lost, changes nothing.
    """

    def tick(_: DataFrame, __: int) -> None:
        take_in(spark, root, table, timeout, quiet)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
