"""Feed files, and written tables that cut the lineage of iterative jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.schemas import FEED_SCHEMA

#: The setting by which Spark removes a query's shuffle files when the query ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    Taken from spark.checkpoint.dir or the context; only a local-mode session
    without either gets a temporary folder, which goes when Python ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.TemporaryDirectory(prefix="eventloom-", ignore_cleanup_errors=True)
    return _local_dirs[app].name


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/eventloom-{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Remove the intermediate tables; to be called when results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Lost executors then cost a re-read, never a recomputation of earlier rounds.
    Once the table is written, the files of its shuffles go too: left to
    garbage collection, those of all tables of a run lie on the disks together.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def read_feed(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Feed file(s) as a DataFrame; a missing path is an empty feed."""
    try:
        return spark.read.schema(FEED_SCHEMA).json(path, multiLine=multi_line)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FEED_SCHEMA)


def write_feed(feed: DataFrame, path: str, fmt: str = "json") -> None:
    """Write the feed columns; JSON goes one record per line, text kept as is."""
    feed.select(*FEED_SCHEMA.names).write.mode("overwrite").format(fmt).save(path)


def replace_feed(feed: DataFrame, path: str) -> str:
    """Write a new version of the feed and make it the current one; returns its name.

    The version is written into a folder of its own, and then one small file
    with its name takes the place of the old one in a single rename. Readers
    see the old feed or the new one; a write that breaks off changes nothing.
    """
    spark = feed.sparkSession
    version = uuid.uuid4().hex
    feed.write.parquet(f"{path}/versions/{version}")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    staged = fs.Path(f"{path}/current-{version}")
    context = fs.FileContext.getFileContext(staged.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.text(f"{path}/names/{version}")
    name = next(f.getPath() for f in staged.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs.Path(f"{path}/names/{version}"))
                if f.getPath().getName().startswith("part-"))
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(name, fs.Path(f"{path}/current.txt"), options)
    return version


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a feed written by `replace_feed`; without one, an empty feed."""
    try:
        version = spark.read.text(f"{path}/current.txt").first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FEED_SCHEMA)
    return spark.read.parquet(f"{path}/versions/{version}")


def split_records(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON texts in `column` parsed into (good, quarantined); one bad record stops nothing."""
    options = {"columnNameOfCorruptRecord": "_corrupt"}
    rows = df.withColumn("_r", F.from_json(column, f"{schema}, _corrupt string", options))
    is_bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    good = rows.filter(~is_bad).select(*[c for c in df.columns if c != column], "_r.*").drop("_corrupt")
    return good, rows.filter(is_bad).drop("_r")


def read_raw_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Raw JSON-lines files split into (good, quarantined)."""
    return split_records(spark.read.text(path), "value", schema)
