"""Dense positions in a sorted relation, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.session import cut, parallelism


def path_order(path: str = "eml_path") -> Column:
    """Paths in the order of their components, not of their characters."""
    return F.split(F.col(path), "/")


def dense_positions(rows: DataFrame, group: str, order: list[Column], name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in its group's order.

    Rows are range-partitioned by group and order, so a group of any size spreads over tasks; each task counts
    its rows, and prefix sums of these counts (tasks by groups, small) give the offsets. Equal rows get
    positions of their own. Null groups and keys sort first.
    """
    keys = [F.col(group), *order]
    n = parallelism(rows.sparkSession)
    keyed = rows.withColumns({f"__k{i}": k for i, k in enumerate(order)})
    names = [f"__k{i}" for i in range(len(keys) - 1)]
    placed = cut(keyed.repartitionByRange(n, group, *names).sortWithinPartitions(group, *names).drop(*names).withColumns({"__at": F.monotonically_increasing_id(), "__part": F.spark_partition_id()}))
    counts = placed.groupBy("__part", F.col(group).alias("__group")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("__part").alias("__p"), "__group", "__first", before.alias("__before"))
    joined = placed.join(offsets, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn(name, F.col("__at") - F.col("__first") + F.col("__before") + 1).drop("__at", "__part", "__p", "__group", "__first", "__before")
