"""Session settings and the shared folder in which iterative operators keep what they have worked out."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tablewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE); cluster settings win otherwise."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, one inside the warehouse folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:  # the session was stopped before
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Delete ``folder`` when the program ends."""
    atexit.register(_remove, spark, folder)


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``keep`` returned; nothing may read it any more."""
    if folder := getattr(df, "_kept_in", None):
        _remove(df.sparkSession, folder)


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there; the files go with ``release`` or when the program ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    remove_at_exit(spark, folder)
    kept = spark.read.schema(df.schema).parquet(folder)
    kept._kept_in = folder
    return kept


#: Spark's own setting that deletes the shuffle files of a query when it ends, not when the driver happens to collect garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables kept in the innermost ``step`` that is under way.
_passing: list[list[DataFrame]] = []


def keep_tidy(df: DataFrame) -> DataFrame:
    """``keep`` that leaves no shuffle files behind; within a ``step`` the table goes with it."""
    spark = df.sparkSession
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        kept = keep(df)
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    if _passing:
        _passing[-1].append(kept)
    return kept


def step(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, kept; the tables that ``keep_tidy`` wrote on the way are deleted."""
    _passing.append([])
    try:
        made = make()
    finally:
        passed = _passing.pop()
    kept = keep_tidy(made)
    for df in passed:
        release(df)
    return kept


def spread(df: DataFrame) -> DataFrame:
    """``df`` written once, its rows dealt evenly over the tasks, for operators that read a table several times.

    Tasks are cut by bytes, so a small file of many rows, or a join of narrow ones, would be read by a task or two.
    """
    spark = df.sparkSession
    return keep(df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
