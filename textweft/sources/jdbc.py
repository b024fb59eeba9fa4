"""Relational tables over JDBC, read in ranges of their key."""

from __future__ import annotations

from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession


def url(host: str, database: str, user: str, password: str, port: int = 5432) -> str:
    """Connection address with quoted credentials."""
    return f"jdbc:postgresql://{host}:{port}/{database}?user={quote_plus(user)}&password={quote_plus(password)}"


def read_table(spark: SparkSession, address: str, name: str, key: str = "id", low: int = 0, high: int = 1, partitions: int = 8, fetch: int = 10_000) -> DataFrame:
    """One table in ``partitions`` ranges of ``key``; filters and columns are pushed to the database."""
    options = {"url": address, "dbtable": name, "partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": partitions, "fetchsize": fetch}
    return spark.read.format("jdbc").options(**options).load()


def append_table(rows: DataFrame, address: str, name: str, partitions: int = 8) -> None:
    rows.write.format("jdbc").options(url=address, dbtable=name, numPartitions=partitions).mode("append").save()
