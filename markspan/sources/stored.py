"""Changing tables that are stored in submission buckets: upserts and deletions that rewrite touched buckets only.

A change first writes the new content of its buckets, whole, below the table (`_pending`), then puts it in place by dynamic partition
overwrite, then removes it. What a stopped job left there is put in place before anything else happens, so that repeating a job is
safe. One job at a time changes a table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from markspan.session import written
from markspan.sources.results import BUCKETS, submission_bucket

BUCKET = "submission_bucket"


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _path(spark, path)
    return store.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    store, place = _path(spark, path)
    store.delete(place, True)


def _put(spark: SparkSession, path: str, text: str = "") -> None:
    store, place = _path(spark, path)
    out = store.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def _schema(spark: SparkSession, folder: str) -> StructType | None:
    """The columns of the table, where a change has added some that untouched buckets lack."""
    if not exists(spark, f"{folder}/_schema/columns"):
        return None
    return StructType.fromJson(json.loads(spark.read.text(f"{folder}/_schema/columns", wholetext=True).first()[0]))


def read_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The table as it is after what a stopped job has left is put in place."""
    finish(spark, folder)
    schema = _schema(spark, folder)
    return (spark.read.schema(schema) if schema else spark.read).parquet(folder)


def finish(spark: SparkSession, folder: str) -> None:
    """Put a pending change in place; does nothing where none is complete."""
    pending = f"{folder}/_pending"
    if not exists(spark, f"{pending}/_READY"):
        remove(spark, pending)
        return
    rows = spark.read.parquet(f"{pending}/rows")
    held = {r[0] for r in rows.select(BUCKET).distinct().collect()}  # at most BUCKETS
    if held:
        writer = rows.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BUCKET).parquet(folder)
    _put(spark, f"{folder}/_schema/columns", rows.schema.json())
    for r in spark.read.parquet(f"{pending}/touched").collect():
        if r[0] not in held:
            remove(spark, f"{folder}/{BUCKET}={r[0]}")
    remove(spark, pending)


def _replace(spark: SparkSession, folder: str, touched: list[int], rows: DataFrame) -> None:
    """Make `rows` the whole content of the touched buckets."""
    pending = f"{folder}/_pending"
    rows.write.mode("overwrite").parquet(f"{pending}/rows")
    spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int").coalesce(1).write.mode("overwrite").parquet(f"{pending}/touched")
    _put(spark, f"{pending}/_READY")
    finish(spark, folder)


def _touched(ids: DataFrame) -> list[int]:
    """The buckets of the submissions, at most BUCKETS numbers."""
    return sorted(r[0] for r in ids.select(submission_bucket(F.col("submission_id"), BUCKETS).alias("b")).distinct().collect())


def upsert(spark: SparkSession, folder: str, changes: DataFrame, key: Sequence[str] = ("submission_id", "candidate_id")) -> None:
    """Set the columns of `changes` on the stored rows with its key, and add rows whose key is not stored yet.

    `changes` has unique keys, submission_id among them. Columns that it lacks keep their values; new columns are null elsewhere
    in the rewritten buckets, and read as null in the others."""
    stored = read_stored(spark, folder)
    changes = written(changes, "changes")
    touched = _touched(changes)
    if not touched:
        return
    old = stored.filter(F.col(BUCKET).isin(touched))
    values = [c for c in changes.columns if c not in key]
    new = changes.select(*[F.col(c).alias(f"__{c}") for c in changes.columns], F.lit(True).alias("__changed"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    joined = old.join(new, same, "full")
    changed = F.coalesce("__changed", F.lit(False))
    kinds = dict(stored.dtypes)
    columns = []
    for c in dict.fromkeys([*stored.columns, *values]):
        if c == BUCKET:
            continue
        mine = F.col(c) if c in kinds else F.lit(None)
        columns.append((F.coalesce(mine, F.col(f"__{c}")) if c in key else F.when(changed, F.col(f"__{c}")).otherwise(mine) if c in values else mine).alias(c))
    rows = joined.select(*columns).withColumn(BUCKET, submission_bucket(F.col("submission_id")))
    _replace(spark, folder, touched, rows)


def delete_submissions(spark: SparkSession, folders: Sequence[str], deleted: DataFrame, record: str) -> None:
    """Remove the rows of the submissions from all tables that hold some.

    The ids are written to `record` before the first table changes and stay there until the last one has, so that `resume_deletion`
    ends what a stopped job began. Deleting again changes nothing."""
    if exists(spark, f"{record}/_SUCCESS"):
        resume_deletion(spark, folders, record)
    deleted.select("submission_id").distinct().write.mode("overwrite").parquet(record)
    resume_deletion(spark, folders, record)


def resume_deletion(spark: SparkSession, folders: Sequence[str], record: str) -> None:
    if not exists(spark, f"{record}/_SUCCESS"):
        return
    ids = spark.read.parquet(record)
    touched = _touched(ids)
    for folder in folders:
        stored = read_stored(spark, folder).filter(F.col(BUCKET).isin(touched))
        hit = stored.join(ids, stored["submission_id"].eqNullSafe(ids["submission_id"]), "left_semi")
        buckets = sorted(r[0] for r in hit.select(BUCKET).distinct().collect())
        if buckets:
            mine = stored.filter(F.col(BUCKET).isin(buckets))
            _replace(spark, folder, buckets, mine.join(ids, mine["submission_id"].eqNullSafe(ids["submission_id"]), "left_anti"))
    remove(spark, record)
