"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by the digest of the normalised text. A new batch is reduced to one row
per digest, anti-joined with the index by sort and merge, and what is new is appended. A batch that is added again, or
whose job is repeated after a failure, finds its digests present and appends nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markspan.session import new_path, written
from markspan.sources.stored import exists

BUCKETS = 64


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null reads as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """Digests seen so far with the id that stays for each: (digest binary, keep_id long), bucketed and sorted by digest.

    `path` is a folder that all executors reach; opening it again continues the index. `buckets` is fixed when the index is
    created and stored with it; take about one bucket for each 200 MB that the index is expected to reach (40 bytes a digest).
    Another number at a later opening is an error, since rows dealt to other buckets would not be found."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        layout = f"{path}/_layout"
        stored = spark.read.parquet(layout).first()[0] if exists(spark, f"{layout}/_SUCCESS") else None
        if stored and buckets and stored != buckets:
            raise ValueError(f"the index has {stored} buckets, not {buckets}")
        buckets = stored or buckets or BUCKETS
        if not stored:
            spark.range(1).select(F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(layout)
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> None:
        """Append the digests of `batch` (digest, doc_id, ...) that the index lacks, each with the batch's smallest id.

        The grouping combines before its shuffle, so that a digest with very many rows arrives as one row per task."""
        firsts = batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        new = firsts.join(self.rows().hint("merge"), "digest", "left_anti")
        new.repartition(self.buckets, "digest").select("digest", "keep_id").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def drop_name(self) -> None:
        """Forget the session's name of the index; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, copies): one row for each pair, so that repeated rows and large groups shrink before the shuffle."""
    hashed = docs.select(text_digest(F.col("text")).alias("digest"), "doc_id")
    return hashed.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))


def exact_groups(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are; a null text equals the empty one. The smallest doc_id of a group
    stays, or the id that an index given here already holds for the text. Of rows that repeat id and text one is kept. A
    null id is larger than any other. Empty input gives no rows. Only doc_id and text are read."""
    spark = docs.sparkSession
    ids = written(digests(docs), "digests")
    own = index or DigestIndex(spark, new_path(spark, "digest-index"))
    own.add(ids)
    sizes = ids.groupBy("digest").agg(F.sum("copies").alias("group_size"))
    groups = written(sizes.join(own.rows(), "digest"), "digest-groups")
    if index is None:
        own.drop_name()
    rows = ids.join(groups, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns.

    One row of each (digest, id) is taken before the shuffle; joining on both keys spreads a large group over the tasks."""
    spark = docs.sparkSession
    own = index or DigestIndex(spark, new_path(spark, "digest-index"))
    own.add(docs.select(text_digest(F.col("text")).alias("digest"), "doc_id"))
    key = {"digest": "__digest", "keep_id": "__keep"}
    stays = own.rows().withColumnsRenamed(key)
    rows = docs.withColumn("__digest", text_digest(F.col("text"))).withColumn("__keep", F.col("doc_id"))
    once = rows.dropDuplicates(["__digest", "__keep"])
    same = (once["__digest"] == stays["__digest"]) & once["__keep"].eqNullSafe(stays["__keep"])
    return once.join(stays, same, "left_semi").select(*docs.columns)
