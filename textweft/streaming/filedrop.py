"""Documents dropped into a folder, analysed as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def watch(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def write_once(stream: DataFrame, key: str, target: str, checkpoints: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Append the transformed documents to ``target``, each key once, and return the query after what is there.

    Keys seen are kept in the stream's state, so a batch costs what it holds
    and not what was written before; of rows with one key in one batch, any is
    kept.  A batch writes its own folder, ``target``/batch=N, so one that is run
    again replaces what it wrote.  A null key is a key like others.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    once = stream.dropDuplicates([key])
    query = once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoints).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
