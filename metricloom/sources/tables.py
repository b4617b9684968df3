"""Parquet tables by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """One parquet table; a given schema saves the footer read that would infer it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def table_reader(
    spark: SparkSession, folder: str, known: dict[str, T.StructType] | None = None
) -> Callable[[str], DataFrame]:
    """Tables of one folder by name, remembering in ``known`` every schema it had to infer."""
    schemas = {} if known is None else known

    def read(name: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        if path not in schemas:
            schemas[path] = read_table(spark, folder, name).schema
        return read_table(spark, folder, name, schemas[path])

    return read


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core for heavy row work on a table that came in fewer splits than cores.

    A table of many files passes through untouched; only a small one is redistributed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
