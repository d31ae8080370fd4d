"""Intermediate tables and models in the shared folder of the cluster."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, with a part of its own for this application.

    Only a local session may go without the setting; it then uses a folder in the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError(
                "Set spark.checkpoint.dir to a folder that all executors share; "
                "intermediate tables are written there."
            )
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return f"{base.rstrip('/')}/returns_risk/{spark.conf.get('spark.app.id')}"


def remove_tables(spark: SparkSession) -> None:
    """Deletes every intermediate table of this application. Call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _file_system(spark: SparkSession, path: str):
    """Hadoop's path, and the file system that it lies in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, files = _file_system(spark, path)
    return files.exists(found)


def remove_table(spark: SparkSession, path: str) -> None:
    """Deletes one table. Call it when no result is read from it any more."""
    found, files = _file_system(spark, path)
    files.delete(found, True)


def write_version(df: DataFrame, path: str, keep: int = 2) -> None:
    """Writes ``df`` as a new version in the folder ``path``; the newest ``keep`` versions stay.

    A version counts once its ``_SUCCESS`` file is there, which Spark writes last: a crash in between leaves the version
    before it in force. Versions are ordered by the time of writing; two writers at once are not told apart.
    """
    df.write.parquet(folder := open_version(df.sparkSession, path))
    _keep_newest(df.sparkSession, folder, keep)


def open_version(spark: SparkSession, path: str) -> str:
    """The name of a new version's folder. It counts once it is written as a table, or given to ``publish_version``."""
    older = _versions(spark, path)
    last = int(older[-1].rsplit("/v-", 1)[1].split("-")[0]) if older else 0
    return f"{path.rstrip('/')}/v-{max(time.time_ns() // 1_000_000, last + 1):015d}-{uuid.uuid4().hex}"


def publish_version(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Makes a folder of several tables, all written, the newest version."""
    found, files = _file_system(spark, f"{folder}/_SUCCESS")
    files.create(found, True).close()
    _keep_newest(spark, folder, keep)


def _keep_newest(spark: SparkSession, folder: str, keep: int) -> None:
    for old in _versions(spark, folder.rsplit("/", 1)[0])[:-keep]:
        remove_table(spark, old)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions in a folder, oldest first."""
    folder, files = _file_system(spark, path)
    if not files.exists(folder):
        return []
    found = [status.getPath() for status in files.listStatus(folder) if status.getPath().getName().startswith("v-")]
    done = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted((p.toString() for p in done), key=lambda name: name.rsplit("/", 1)[1])


def newest_version(spark: SparkSession, path: str) -> str:
    """The folder of the newest complete version."""
    if not (versions := _versions(spark, path)):
        raise FileNotFoundError(f"No complete version in {path}")
    return versions[-1]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Runs ``df`` once into a Parquet table and returns the table.

    For results that several later steps read. The table outlives lost executors, keeps column
    pruning, and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
