"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a new folder of this machine if Spark runs on it alone (tests), else an error, as
    executors elsewhere couldn't see that folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        path = tempfile.mkdtemp(prefix="hemaspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    """A table that nothing refers to any more; one that stays behind does no harm."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def dropped(df: DataFrame) -> None:
    """Deletes a table that `written` made and that no DataFrame still in use reads: for loops that write one a round."""
    if path := getattr(df, "_hemaspark_path", None):
        _delete(df.sparkSession, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage, and later steps don't compute df once more.

    DataFrames made of it read it when they run, so it stays until `dropped` or `release` deletes it, or whoever owns the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hemaspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made(spark).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._hemaspark_path = path  # type: ignore[attr-defined]
    return out


#: Tables written, by session.
_TABLES: weakref.WeakKeyDictionary[SparkSession, list[str]] = weakref.WeakKeyDictionary()


def _made(spark: SparkSession) -> list[str]:
    return _TABLES.setdefault(spark, [])


def release(spark: SparkSession) -> int:
    """Deletes all tables that the session has written, for when the results made of them have been stored; returns their number."""
    paths = _TABLES.pop(spark, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)
