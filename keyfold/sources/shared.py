"""Tables and files that every executor can read.

Lineage is cut by writing a Parquet table below the folder that the cluster
names in ``spark.checkpoint.dir``. Only where that setting is missing and Spark
runs in one process (tests, a laptop) a folder of our own is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own.get(app)
        if base is None:
            base = _own[app] = "file://" + tempfile.mkdtemp(prefix="keyfold-")
    return f"{base.rstrip('/')}/keyfold-{app}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; its path is added to ``paths``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table or folder that :func:`store` or :func:`new_path` made."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_order(df: DataFrame) -> DataFrame:
    """``df`` with ``__file`` and ``__row``, by which its rows stand as they were written.

    Readers deal files out by size, so the place in the file tells the order; rows
    that do not come straight from files keep the order of their partitions.
    """
    try:
        return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return df.select("*", F.lit("").alias("__file"), F.monotonically_increasing_id().alias("__row"))
