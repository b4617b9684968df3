"""Session defaults and the few runtime helpers every job shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Fixed value: Spark's name for deleting shuffle files when a query ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "metricloom", cores: str = "*") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    On one machine a session without the setting gets a folder of its own; on a cluster it is refused,
    since no folder of the driver can be read by executors.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = named or tempfile.mkdtemp(prefix="metricloom-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of the executors that made them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back.

    The rows survive lost executors, readers take only the columns they need, and the files go away
    with the application. What was shuffled for them goes as soon as they are written.
    """
    return written_at(df)[0]


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``written`` and the folder, for who can ``delete`` it earlier."""
    spark = df.sparkSession
    context = spark.sparkContext
    path = f"{shared_folder(spark).rstrip('/')}/written-{context.applicationId}-{uuid.uuid4().hex}"
    schema = df.schema
    with shuffles_freed(spark):
        # A frame of its own, as frames keep the setting with which they were made.
        df.select("*").write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(schema).parquet(path), path


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query are deleted when it ends, not when the driver collects its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def _file_system(spark: SparkSession, path: str) -> tuple:
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(context._jsc.hadoopConfiguration()), hadoop


def delete(spark: SparkSession, path: str) -> None:
    """Delete the folder of rows that nothing reads again."""
    files, hadoop = _file_system(spark, path)
    files.delete(hadoop, True)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when the application ends."""
    files, hadoop = _file_system(spark, path)
    files.deleteOnExit(hadoop)
