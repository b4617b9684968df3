"""File manifests, case records and report sinks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.operators.quality import key_audit

# Bytes of a file that a task holds at a time while it hashes.
HASH_BUFFER = 8 << 20


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Per file: name, size and SHA-256 of its bytes, whatever its size.

    The listing reads no contents. Each file is then streamed through the hash by the task that
    owns its path, so memory does not depend on the size of the file.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("size_bytes"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column(0).to_pylist():
                # Spark writes local paths with one slash.
                files, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                digest = hashlib.sha256()
                with files.open_input_stream(place) as stream:
                    while block := stream.read(HASH_BUFFER):
                        digest.update(block)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], ["path", "size_bytes", "sha256"])

    found = listed.repartition("path").mapInArrow(hashed, "path string, size_bytes long, sha256 string")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "size_bytes", "sha256")


def csv_shape(spark: SparkSession, path: str) -> DataFrame:
    """Per headed CSV file: data rows and header columns."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name")
    text = spark.read.text(path)
    # A comma inside quotes has an odd number of quotes after it.
    cells = F.size(F.split("value", r',(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    header = (
        text.select(name, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), cells.alias("cells"))
        .groupBy("file_name")
        .agg(F.min_by("cells", F.struct("block", "row")).alias("column_count"))
    )
    rows = (
        spark.read.option("header", True).option("escape", '"').csv(path)
        .select(name)
        .groupBy("file_name")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    return header.join(rows, "file_name", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))


def read_records(spark: SparkSession, path: str, schema: T.StructType, record_id: str) -> DataFrame:
    """JSON-lines records of a declared schema; a missing or repeated id refuses the whole set."""
    records = spark.read.schema(schema).json(path)
    audit = key_audit(records, (record_id,)).first()
    if audit["missing_key_rows"] or audit["duplicate_rows"]:
        raise ValueError(
            f"{audit['duplicate_rows']} repeated and {audit['missing_key_rows']} missing {record_id} values"
        )
    return records


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """A report as JSON lines or parquet, written in parallel by its own partitions."""
    if form not in ("json", "parquet"):
        raise ValueError("a report is json or parquet")
    df.write.mode("overwrite").format(form).save(path)
