"""CSV loads with first-wins keys, reconciliation, and publication that can fail safely."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.operators.quality import constraint_report, row_reconcile
from metricloom.plans.star import CHECKS, FOREIGN_KEYS, PRIMARY_KEYS, RETAIL_SCHEMAS

POSITION = "_position"


class LoadError(ValueError):
    """The load or publication was refused; nothing was replaced."""


def load_table(spark: SparkSession, path: str, schema: T.StructType, with_position: bool = False) -> DataFrame:
    """Typed rows of one headed CSV.

    The header must equal the declared columns in order; empty text is NULL; a value of the
    wrong type fails the load. Types are cast from text rather than inferred.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"')
    header = [name.lstrip("﻿") for name in reader.csv(path).columns]
    if header != schema.names:
        raise LoadError(f"columns {header} differ from the declared {schema.names}")
    text = T.StructType([T.StructField(name, T.StringType()) for name in schema.names])
    raw = reader.option("enforceSchema", True).schema(text).csv(path)
    typed = [F.nullif(F.col(f.name), F.lit("")).cast(f.dataType).alias(f.name) for f in schema.fields]
    if not with_position:
        return raw.select(*typed)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return raw.select(*typed, place.alias(POSITION))


def load_dedup(
    incoming: DataFrame, key: Sequence[str], position: Column, existing: DataFrame | None = None
) -> DataFrame:
    """New rows only: the first row of each key by ``position``, minus keys already stored.

    The earliest row per key is a combinable minimum over (position, row), so a hot key is
    reduced on the map side instead of being sorted in one task.
    """
    carried = [c for c in incoming.columns if c not in key and c != POSITION]
    firsts = incoming.groupBy(*key).agg(
        F.min_by(F.struct(*carried) if carried else F.lit(1), position).alias("_row")
    )
    rows = firsts.select(*key, *([F.col(f"_row.{c}").alias(c) for c in carried]))
    rows = rows.select(*[c for c in incoming.columns if c != POSITION])
    if existing is not None:
        rows = rows.join(existing.select(*key).distinct(), list(key), "left_anti")
    return rows


def load_all(
    spark: SparkSession, paths: dict[str, str], schemas: dict[str, T.StructType] = RETAIL_SCHEMAS
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Load the declared tables in reference order with one reconciliation row per table."""
    loaded, counts = {}, []
    for name, schema in schemas.items():
        if name not in paths:
            continue
        source = load_table(spark, paths[name], schema, with_position=True)
        loaded[name] = load_dedup(source, PRIMARY_KEYS[name], F.col(POSITION))
        counts.append(row_reconcile(source, loaded[name], name))
    return loaded, reduce(lambda a, b: a.unionByName(b), counts)


def retail_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Every violated declaration of the retail tables."""
    required = {n: [f.name for f in RETAIL_SCHEMAS[n].fields if not f.nullable] for n in tables}
    report = constraint_report(tables, required, PRIMARY_KEYS, CHECKS, FOREIGN_KEYS)
    return report.filter(F.col("violations") > 0)


def _store(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(target).getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, target: str) -> list[int]:
    """Committed versions of a publication target, oldest first."""
    fs, path = _store(spark, target)
    folder = path(f"{target.rstrip('/')}/commits")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _commit(spark: SparkSession, target: str, content: dict) -> int:
    """Make ``content`` the next version.

    A version number is claimed by creating a file that must not exist yet, so two publishers never
    share one; the commit itself is written aside and renamed, so a reader sees all of it or nothing. A
    claim whose publisher died before its commit is a number that is never used.
    """
    fs, path = _store(spark, target)
    folder = f"{target}/commits"
    fs.mkdirs(path(folder))
    version = max([0, *versions(spark, target)])
    while True:
        version += 1
        try:
            fs.create(path(f"{folder}/{version:020d}.claim"), False).close()
            break
        except Py4JJavaError:
            if not fs.exists(path(f"{folder}/{version:020d}.claim")):
                raise
    aside = path(f"{folder}/{version:020d}.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps({**content, "version": version}, sort_keys=True).encode()))
    out.close()
    if not fs.rename(aside, path(f"{folder}/{version:020d}.json")):
        fs.delete(aside, False)
        raise LoadError(f"version {version} could not be committed")
    return version


def publish(
    tables: dict[str, DataFrame],
    target: str,
    audit=retail_violations,
    partition_by: dict[str, Sequence[str]] | None = None,
) -> int:
    """Write all tables as a new version of the target and return its number.

    The audit reads the written files, so what is published is what was checked. A version is seen
    by readers from the moment its commit file is there, and no file of an earlier one is touched. On
    any failure the new files are removed and the latest version stays what it was.
    """
    spark = next(iter(tables.values())).sparkSession
    target = target.rstrip("/")
    fs, path = _store(spark, target)
    data = f"data/{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            writer = df.write.mode("error")
            if partition_by and name in partition_by:
                writer = writer.partitionBy(*partition_by[name])
            writer.parquet(f"{target}/{data}/{name}")
        staged = {name: spark.read.schema(df.schema).parquet(f"{target}/{data}/{name}") for name, df in tables.items()}
        broken = audit(staged).collect()  # one row for each declared rule at most
        if broken:
            raise LoadError(f"publication refused: {[tuple(r) for r in broken]}")
        return _commit(spark, target, {"data": data, "tables": {name: df.schema.jsonValue() for name, df in tables.items()}})
    except Exception:
        fs.delete(path(f"{target}/{data}"), True)
        raise


def _committed(spark: SparkSession, target: str, version: int) -> dict:
    fs, path = _store(spark, target)
    stream = fs.open(path(f"{target.rstrip('/')}/commits/{version:020d}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def published(spark: SparkSession, target: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of one version, the latest if none is named.

    The version is chosen once: tables read together are of one publication, and stay readable while
    later ones are committed.
    """
    known = versions(spark, target)
    if not known or (version is not None and version not in known):
        raise LoadError(f"{target} has no version {'yet' if version is None else version}")
    commit = _committed(spark, target, known[-1] if version is None else version)
    return {name: spark.read.schema(T.StructType.fromJson(schema)).parquet(f"{target.rstrip('/')}/{commit['data']}/{name}") for name, schema in commit["tables"].items()}


def vacuum(spark: SparkSession, target: str, keep: int) -> list[int]:
    """Remove all but the last ``keep`` versions, commits first, and return their numbers.

    Readers that are pinned to a removed version fail; that choice is the caller's.
    """
    if keep < 1:
        raise ValueError("at least one version stays")
    fs, path = _store(spark, target)
    target = target.rstrip("/")
    old = versions(spark, target)[:-keep]
    for version in old:
        data = _committed(spark, target, version)["data"]
        fs.delete(path(f"{target}/commits/{version:020d}.json"), False)
        fs.delete(path(f"{target}/{data}"), True)
    return old
