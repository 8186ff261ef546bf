"""Written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of the session's ``spark.checkpoint.dir``; a temporary one only in local mode without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.conf.get("spark.app.id", "app")
    if base:
        return f"{base.rstrip('/')}/{app}"
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lexmill-")
    return f"file://{_own[app]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file system layer; a stopped session or a missing folder is no error."""
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except (Py4JError, OSError, AttributeError):  # the session is gone
        pass


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, computed once and written as Parquet, with the writer's options, to the shared folder; the result reads those files, so a lost executor costs no more than rereading."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing will read any more."""
    for df in tables:
        remove(df.sparkSession, df.scratch_path)
