"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench, with a folder of its own as the shared one."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("murmuration")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="murmuration-"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine; on a cluster a missing
    setting is an error, because executors could not read each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(tempfile.gettempdir(), f"murmuration-{spark.sparkContext.applicationId}")


_MADE: dict[str, list[str]] = {}  # intermediate tables by application


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one intermediate table."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables that this application has made so far; returns how many paths went.

    For when the results that read them have been written: a table not yet computed would miss them.
    """
    return _delete(spark, _MADE.pop(spark.sparkContext.applicationId, []))


def _delete(spark: SparkSession, paths: list[str]) -> int:
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    return sum(bool(p.getFileSystem(conf).delete(p, True)) for p in (jvm.org.apache.hadoop.fs.Path(x) for x in paths))


def scratch_made(spark: SparkSession) -> int:
    """How many intermediate tables this application has made and not deleted; a mark for ``drop_scratch``."""
    return len(_MADE.get(spark.sparkContext.applicationId, []))


def drop_scratch(spark: SparkSession, since: int, *keep: str) -> int:
    """Delete the intermediate tables made after a mark, but those with the labels ``keep``; returns how many went.

    For when all that reads them has itself been written.
    """
    made = _MADE.get(spark.sparkContext.applicationId, [])
    gone = [p for p in made[since:] if p.rsplit("/", 1)[-1].rsplit("-", 1)[0] not in keep]
    made[since:] = [p for p in made[since:] if p not in gone]
    release_shuffles(spark)
    return _delete(spark, gone)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that have ended, which else stay until the driver's heap happens to fill.

    Spark deletes the files of a shuffle once nothing in the driver refers to it; a lost file of one that is still in use
    would be made again.
    """
    gc.collect()  # frames that Python holds keep theirs
    spark._jvm.System.gc()


def cut_lineage(df, label: str):
    """Write a table to the shared folder and read it back, which survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
