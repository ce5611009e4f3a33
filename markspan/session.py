"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "markspan", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators expect; a cluster's own settings come from spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. The library never chooses one by itself."""
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF) or sc.getCheckpointDir()
    if not folder:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    return folder


def set_local_folder(spark: SparkSession, make: Callable[[], str]) -> None:
    """For entry points, tests and benches: where no folder is set and everything runs in one process, use `make()`."""
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF) or sc.getCheckpointDir()
    if not named and re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        sc.setCheckpointDir(make())


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by the keys to as many tasks as `spark.sql.shuffle.partitions` says.

    Adaptive execution would merge parts by their packed bytes, and a part's groups or words may take many times that in memory."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back, so that a costly stage is not run again by later branches
    or by a lost executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FEW_ROWS = 20_000


def dimension(df: DataFrame, name: str) -> DataFrame:
    """`written`, for a table that others are joined to. Spark takes the size of packed files for that of their rows, and a broadcast
    goes through the driver; so a table of more than FEW_ROWS rows is joined by sorting, whatever its files take."""
    rows = written(df, name)
    return rows if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS else rows.hint("merge")


@contextmanager
def dropping_shuffles(*sessions: SparkSession) -> Iterator[None]:
    """Jobs of the sessions that end within it leave no shuffle files. Otherwise those stay until the driver happens to collect its garbage,
    and a row of jobs fills the disks with what nobody reads again. A DataFrame that is run twice shuffles twice."""
    before = [s.conf.get(CLEANUP_CONF, None) for s in sessions]
    try:
        for s in sessions:
            s.conf.set(CLEANUP_CONF, "true")
        yield
    finally:
        for s, value in zip(sessions, before, strict=True):
            s.conf.unset(CLEANUP_CONF) if value is None else s.conf.set(CLEANUP_CONF, value)
