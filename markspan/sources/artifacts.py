"""What a text-recognition run leaves behind: a record and a text for each page, and a summary that is written last.

A run is named by its folder YYYY/MM/DD/context/source/HHMMSS. Pages are stored as rows in day folders; a run counts once its summary
is stored, so that what a stopped job has left of a run is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markspan.functions.text import base_name, word_count
from markspan.operators.events import run_folder
from markspan.operators.reports import run_summary
from markspan.session import written
from markspan.sources.intake import run_tokens
from markspan.sources.results import append_by_day
from markspan.sources.stored import exists

PAGE_FIELDS = ("run_dir", "page", "image_file", "text_file", "status", "error", "word_count", "average_confidence", "confidence_samples", "text")
RUN_FIELDS = ("run_dir", "context_id", "source_filename", "preprocessing_mode", "pages_total", "pages_ok", "average_confidence")


def page_records(pages: DataFrame) -> DataFrame:
    """Records of pages (context_id, source_filename, created_at, page, image_path, text, error, average_confidence,
    confidence_samples): a page with an error has no text, no words and no confidence."""
    context, source = run_tokens(F.col("context_id"), F.col("source_filename"))
    ok = F.col("error").isNull()

    def if_ok(value, otherwise):
        return F.when(ok, F.coalesce(value, F.lit(otherwise))).otherwise(F.lit(otherwise))

    return pages.select(
        "context_id", "source_filename", "created_at", run_folder(F.col("created_at"), context, source).alias("run_dir"), F.col("page").cast("bigint").alias("page"),
        base_name(F.col("image_path")).alias("image_file"), F.format_string("pages/page_%03d.txt", F.col("page").cast("bigint")).alias("text_file"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"), "error", if_ok(word_count(F.col("text")).cast("bigint"), 0).cast("bigint").alias("word_count"),
        if_ok(F.col("average_confidence"), 0.0).alias("average_confidence"), if_ok(F.col("confidence_samples").cast("bigint"), 0).cast("bigint").alias("confidence_samples"),
        if_ok(F.col("text"), "").alias("text"),
    )


def run_summaries(records: DataFrame, preprocessing_mode: str | None = None) -> DataFrame:
    """One row per run; the average is that of the page averages above 0."""
    sums = run_summary(records.select(F.col("run_dir").alias("doc_id"), "status", "average_confidence"))
    runs = records.groupBy("run_dir").agg(*[F.min(c).alias(c) for c in ("context_id", "source_filename", "created_at")])
    mode = F.lit(preprocessing_mode).cast("string").alias("preprocessing_mode")
    return runs.join(sums, runs["run_dir"] == sums["doc_id"]).select("run_dir", "context_id", "source_filename", mode, "pages_total", "pages_ok", "average_confidence", "created_at")


def write_runs(pages: DataFrame, folder: str, preprocessing_mode: str | None = None) -> None:
    """Store the pages of runs, then the runs' summaries. A run that is stored already is left as it is, so that repeating a job
    adds nothing."""
    spark = pages.sparkSession
    records = page_records(pages)
    if exists(spark, f"{folder}/runs"):
        records = records.join(spark.read.parquet(f"{folder}/runs").select("run_dir"), "run_dir", "left_anti")
    # Pages name the job that has written them; those of a job that stopped before its summaries belong to no run.
    records = written(records, "page-records").withColumn("attempt", F.lit(uuid.uuid4().hex))
    append_by_day(records.drop("context_id", "source_filename"), "created_at", f"{folder}/pages")
    summaries = run_summaries(records, preprocessing_mode)
    append_by_day(summaries.join(records.select("run_dir", "attempt").distinct(), "run_dir"), "created_at", f"{folder}/runs")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/runs").select(*RUN_FIELDS, "attempt")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of stored runs, as written by the job that stored the summary."""
    pages = spark.read.parquet(f"{folder}/pages").select(*PAGE_FIELDS, "attempt")
    return pages.join(read_runs(spark, folder).select("run_dir", "attempt"), ["run_dir", "attempt"], "left_semi").select(*PAGE_FIELDS)
