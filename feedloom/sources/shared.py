"""Tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder used only by a local session that names none, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a cluster without one is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = LOCAL_FOLDER
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one; it goes when the session's file system closes."""
    path = f"{shared_dir(spark)}/feedloom-{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet under the shared folder and read it again. `dropped` deletes it, or the session's end."""
    path = f"{new_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._feedloom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete what `written` wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_feedloom_path", None)
        if path:
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p.getParent(), True)


def cleared(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    """Delete files of a `new_folder`, or all of it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in [path(folder)] if names is None else [path(f"{folder}/{name}") for name in names]:
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
