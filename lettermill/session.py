"""Session helpers shared by every operator: table reading, lineage cuts, scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def builder(app: str = "lettermill", cores: str = "*") -> SparkSession.Builder:
    """A session builder with the settings the operators rely on.

    A program that spark-submit started keeps the master, memory and shuffle width given to it; only one
    started by itself gets a local session.
    """
    made = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if "PYSPARK_GATEWAY_PORT" in os.environ:
        return made
    return made.master(f"local[{cores}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The session's ``spark.checkpoint.dir`` names it. Only a session without that
    setting, such as a local test, gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = os.path.join(tempfile.gettempdir(), f"lettermill-{uuid.uuid4().hex}")
    sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Number of shards for a hand-made shuffle: the session's own shuffle width."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes a task should have at least before rows are left where they are.
LEAST_TASK_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is too small to fill them by its own partitions, unchanged otherwise.

    Costly work per row needs tasks, but rows of a large input are not moved for it: the planner's size
    estimate decides, so what is shuffled is bounded by ``LEAST_TASK_BYTES`` per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < cores * LEAST_TASK_BYTES else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of the session, once per application.

    Operators that run Python call it, so a cluster needs no copy of the package on its nodes.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="lettermill-")) / "lettermill.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name) / p.relative_to(root))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)
    return spark
