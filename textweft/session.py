"""Session helpers: table access and durable lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only where none is named.

    On a cluster ``spark.checkpoint.dir`` names a folder every executor can
    reach.  Where it is unset a private folder is used if driver and executors
    are one process; anywhere else that is refused.
    """
    sc = spark.sparkContext
    named = sc.getConf().get(CHECKPOINT_KEY)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor of {sc.master} can reach")
        named = tempfile.mkdtemp(prefix="textweft-checkpoint-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage.

    Reliable: the files survive the loss of any executor.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_textweft_shipped", False):
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="textweft-code-")) / "textweft.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(target))
    sc._textweft_shipped = True


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def group_arrow(grouped, df: DataFrame, function, schema) -> DataFrame:
    """``applyInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return grouped.applyInArrow(function, schema)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed Parquet table in the shared folder and read it back.

    Cuts the lineage like :func:`checkpoint`, takes less disk and tells the
    planner the size.  The table is removed when the Python driver ends.
    """
    spark = df.sparkSession
    path = temporary(spark, "stored")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the context may be gone; the folder is temporary anyway
        pass


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the Python driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def numbered(rows: DataFrame, key: str, order: list[str], first: int = 0) -> DataFrame:
    """Add ``key``: ``first`` and on, in that order.

    The numbers come from the sizes of sorted partitions, not from one task;
    among equal rows the order is any.
    """
    # the low 33 bits of the generated id are the row's place in its partition
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_o")
    return placed.join(F.broadcast(offsets), "_p").withColumn(key, F.col("_o") + F.col("_i") + F.lit(first)).drop("_p", "_o", "_i")


#: Rows of a key table that may be broadcast; more are joined by a shuffle.
MOST_KEYS = 1_000_000


def attach(rows: DataFrame, keys: DataFrame, on: str | list[str], how: str = "inner", most: int = MOST_KEYS) -> DataFrame:
    """Join ``rows`` with a narrow table of keys that is expected to be small.

    The keys are stored and counted first: up to ``most`` they are broadcast, so
    that wide rows are not shuffled to lose most of them; beyond that it is an
    ordinary shuffled join.
    """
    kept = stored(keys)
    return rows.join(F.broadcast(kept) if kept.count() <= most else kept, on, how)


def only(rows: DataFrame, keys: DataFrame, on: str, most: int = MOST_KEYS) -> DataFrame:
    """Rows whose ``on`` is among ``keys`` (one column, distinct); see :func:`attach`."""
    return attach(rows, keys, on, "left_semi", most)


def spread(rows: DataFrame) -> DataFrame:
    """Give costly row-wise work at least one partition a core.

    A table of one small file is one task however long its work takes; tables
    that already have a partition for each core stay as they are, unshuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
