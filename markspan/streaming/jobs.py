"""Streaming forms of the intake, status, layout and marking work.

Each job reads new files, works through everything available and stops, so that it can run on any schedule. Results of
a micro-batch go to `<out>/batch_id=N`, written over when a batch is replayed. Status, lifecycle and arrived sheet rows merge: what
a batch adds is summed up within the batch, and every few batches their folders become one snapshot, so that readers meet
a bounded number of folders and no state is kept beside the results. Marking reads only the buckets of the sheets that a batch touches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from markspan.functions import codes, modeljson
from markspan.operators import infer, marking
from markspan.operators.events import event_order, payload_fields
from markspan.operators.layout import representative_pages
from markspan.session import dropping_shuffles, new_path, spread, written
from markspan.sources import stored

BATCH = "batch_id"
STATUS = (
    "submission_id BIGINT, id BIGINT, action STRING, message STRING, created_at TIMESTAMP_NTZ, current_page STRING, current_candidate STRING"
)

# The status an action leads to; a higher rank is never undone by a lower one.
LIFECYCLE = {
    "upload": (0, "pending"),
    "extract_start": (1, "processing"),
    "page_progress": (1, "processing"),
    "extract_complete": (2, "completed"),
    "extract_error": (2, "failed"),
}


def read_new_files(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _batch_path(out: str, batch_id: int) -> str:
    return f"{out}/{BATCH}={batch_id}"


def run_batches(stream: DataFrame, out: str, mode: str, build: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Work through all available input; each batch's rows replace what an earlier try of that batch wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = build(batch, batch_id) if build else batch
        rows.write.mode("overwrite").parquet(_batch_path(out, batch_id))

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{out}-progress")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def newest_rows(spark: SparkSession, out: str, keys: Sequence[str], schema: str) -> DataFrame:
    """The newest row of each key over all batches."""
    rows = spark.read.schema(f"{schema}, {BATCH} BIGINT").parquet(out)
    values = [c for c in rows.columns if c not in (*keys, BATCH)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("v"))
    return newest.select(*keys, "v.*")


# --- merged results ----------------------------------------------------------------------------------------------

COMPACT_EVERY = 16  # batches that become a snapshot
SNAPSHOT = "snapshot"
Merge = Callable[[DataFrame], DataFrame]


def _folders(spark: SparkSession, out: str) -> dict[str, list[int]]:
    """Numbers of the complete snapshots and batches below a folder."""
    found: dict[str, list[int]] = {SNAPSHOT: [], BATCH: []}
    place = spark._jvm.org.apache.hadoop.fs.Path(out)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(place):
        for status in store.listStatus(place):
            kind, _, number = status.getPath().getName().partition("=")
            if kind in found and stored.exists(spark, f"{out}/{kind}={number}/_SUCCESS"):
                found[kind].append(int(number))
    return {kind: sorted(numbers) for kind, numbers in found.items()}


def _current(spark: SparkSession, out: str, before: int | None = None) -> list[str]:
    """The newest snapshot and the batches after it (up to `before`, exclusive)."""
    found = _folders(spark, out)
    limit = before if before is not None else 1 << 62
    snapshots = [n for n in found[SNAPSHOT] if n < limit]
    newest = snapshots[-1] if snapshots else -1
    return [f"{out}/{SNAPSHOT}={newest}"] * bool(snapshots) + [_batch_path(out, n) for n in found[BATCH] if newest < n < limit]


def merged_rows(spark: SparkSession, out: str, schema: str | StructType, merge: Merge, before: int | None = None) -> DataFrame:
    """What all batches have added, merged; at most one snapshot and COMPACT_EVERY batches are read, give or take one."""
    paths = _current(spark, out, before)
    reader = spark.read.schema(schema)
    rows = reduce(DataFrame.unionByName, [reader.parquet(p) for p in paths]) if paths else spark.createDataFrame([], schema)
    return merge(rows)


def _compact(spark: SparkSession, out: str, schema: str | StructType, merge: Merge, batch_id: int, buckets: Sequence[str] = ()) -> None:
    """Make the batches up to this one a snapshot. The last snapshot and its batches stay until the next time, for readers that have begun
    with them."""
    found = _folders(spark, out)
    merged = merged_rows(spark, out, schema, merge, batch_id + 1)
    writer = merged.hint("rebalance", *buckets).write.mode("overwrite")
    (writer.partitionBy(*buckets) if buckets else writer).parquet(f"{out}/{SNAPSHOT}={batch_id}")
    last = max([n for n in found[SNAPSHOT] if n < batch_id], default=-1)
    for kind, numbers in found.items():
        for n in numbers:
            if n < last or (kind == BATCH and n <= last):
                stored.remove(spark, f"{out}/{kind}={n}")


def run_merged(stream: DataFrame, out: str, part: Merge, merge: Merge, schema: str, every: int = COMPACT_EVERY) -> None:
    """Work through all available input: each batch is written as `part` sums it up, and every few batches become a snapshot.

    `merge` must not mind rows that come twice, so that a replayed batch changes nothing."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        part(batch).write.mode("overwrite").parquet(_batch_path(out, batch_id))
        if batch_id % every == every - 1:
            _compact(spark, out, schema, merge, batch_id)

    stream.writeStream.option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


# --- new result files ------------------------------------------------------------------------------------------


def answers_from_responses(responses: DataFrame, id_col: str) -> DataFrame:
    """Canonical question and stored code of every answer in each response; row by row, so it runs on a stream."""
    obj = modeljson.text_map(modeljson.object_text(F.col("response")))
    inner = modeljson.text_map(obj["answers"])
    rows = responses.select(id_col, F.explode(F.map_entries(inner)).alias("e"))
    out = rows.select(id_col, codes.question_key(F.col("e.key")).alias("question"), codes.stored_answer(F.col("e.value")).alias("answer"))
    return out.filter(F.col("question").isNotNull())


def process_new_responses(stream: DataFrame, id_col: str, out: str) -> None:
    """Append the answers of newly arrived responses; the file sink commits each batch once."""
    query = (
        answers_from_responses(stream, id_col)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{out}-progress")
        .option("path", out)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


# --- status ----------------------------------------------------------------------------------------------------


STATUS_PARTS = """submission_id BIGINT, e STRUCT<at: TIMESTAMP_NTZ, num: BIGINT, id: BIGINT, action: STRING, message: STRING, created_at: TIMESTAMP_NTZ>,
    p STRUCT<at: TIMESTAMP_NTZ, num: BIGINT, current_page: STRING, current_candidate: STRING>"""
LIFECYCLE_PARTS = "submission_id BIGINT, s STRUCT<rank: INT, at: TIMESTAMP_NTZ, num: BIGINT, status: STRING>"


def _status_parts(log: DataFrame) -> DataFrame:
    order = [c.alias(n) for c, n in zip(event_order(), ("at", "num"), strict=True)]
    page = F.struct(*order, F.col("page").alias("current_page"), F.col("label").alias("current_candidate"))
    told = payload_fields(log).select("submission_id", F.struct(*order, "id", "action", "message", "created_at").alias("e"), F.when(F.col("action") == "page_progress", page).alias("p"))
    return _newest_status(told)


def _newest_status(parts: DataFrame) -> DataFrame:
    return parts.groupBy("submission_id").agg(F.max("e").alias("e"), F.max("p").alias("p"))


def _shown_status(parts: DataFrame) -> DataFrame:
    return parts.select("submission_id", "e.id", "e.action", "e.message", "e.created_at", "p.current_page", "p.current_candidate")


def live_status(log: DataFrame) -> DataFrame:
    """The newest event of each submission, and the page and candidate of its newest page event.

    Partial maxima are formed before the shuffle."""
    return _shown_status(_status_parts(log))


def track_status(stream: DataFrame, out: str, every: int = COMPACT_EVERY) -> None:
    run_merged(stream, out, _status_parts, _newest_status, STATUS_PARTS, every)


def tracked_status(spark: SparkSession, out: str) -> DataFrame:
    """`live_status` of all events so far."""
    return _shown_status(merged_rows(spark, out, STATUS_PARTS, _newest_status))


def _lifecycle_parts(log: DataFrame) -> DataFrame:
    ranks = F.create_map(*[F.lit(x) for a, (r, _) in LIFECYCLE.items() for x in (a, r)])
    states = F.create_map(*[F.lit(x) for a, (_, s) in LIFECYCLE.items() for x in (a, s)])
    at, num = event_order()
    known = log.filter(F.col("action").isin(*LIFECYCLE))
    told = F.struct(ranks[F.col("action")].alias("rank"), at.alias("at"), num.alias("num"), states[F.col("action")].alias("status"))
    return _highest_state(known.select("submission_id", told.alias("s")))


def _highest_state(parts: DataFrame) -> DataFrame:
    return parts.groupBy("submission_id").agg(F.max("s").alias("s"))


def lifecycle(log: DataFrame) -> DataFrame:
    """pending, processing, completed or failed; a finished state stays, replays change nothing."""
    return _lifecycle_parts(log).select("submission_id", "s.status")


def track_lifecycle(stream: DataFrame, out: str, every: int = COMPACT_EVERY) -> None:
    run_merged(stream, out, _lifecycle_parts, _highest_state, LIFECYCLE_PARTS, every)


def tracked_lifecycle(spark: SparkSession, out: str) -> DataFrame:
    """`lifecycle` of all events so far."""
    return merged_rows(spark, out, LIFECYCLE_PARTS, _highest_state).select("submission_id", "s.status")


# --- layouts ---------------------------------------------------------------------------------------------------


def detect_new_layouts(stream: DataFrame, fn: infer.PageFunction, out: str) -> None:
    """One format call per layout over all batches.

    A batch is first reduced to one page per layout; layouts of earlier batches are then left out before the call."""
    spark = stream.sparkSession

    def build(batch: DataFrame, batch_id: int) -> DataFrame:
        chosen = representative_pages(batch)
        try:
            stored = spark.read.parquet(out)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return infer.formats_of(chosen, fn)  # no batch has been written yet
        known = stored.filter(F.col(BATCH) < batch_id).select(F.col("format_id").alias("layout_hash"))
        return infer.formats_of(chosen.join(known, "layout_hash", "left_anti"), fn)

    run_batches(stream, out, "append", build)


# --- marking ---------------------------------------------------------------------------------------------------


ROW_BUCKETS = 64
BUCKET = "bucket"


def with_place(stream: DataFrame) -> DataFrame:
    """Rows of a file stream with `place`, which orders the rows of a batch: the file's time, its path, the row in it."""
    return stream.select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index").alias("place"))


def mark_new_sheets(
    stream: DataFrame,
    keys: DataFrame,
    key_long: DataFrame,
    out: str,
    drawing_long: DataFrame | None = None,
    every: int = COMPACT_EVERY,
    buckets: int = ROW_BUCKETS,
) -> None:
    """Mark sheets as they arrive against the stored keys.

    The stream holds long rows (candidate_id, submission_id, paper_type, kind, question, value); kind is answer or drawing,
    and a sheet without answers has one row with no question. A sheet's rows may come in any files: each batch is stored
    below `<out>-rows` by bucket of the candidate, and the sheets it touches are marked again from their rows so far, read from
    their buckets alone. Of a question the row of the newest batch counts, within a batch that of the greatest `place` (see `with_place`), or of
    the greatest value where there is none. A replayed batch replaces its rows.

    Stored rows tell whether they are their sheet's last of the batch, so that places, which are long, are shuffled once. Marking
    shuffles the rows of questions that a key asks for, and of each sheet the row that names its submission and paper type."""
    spark = stream.sparkSession
    arrived = f"{out}-rows"
    key = ["candidate_id", "kind", "question"]
    values = [c for c in stream.columns if c not in (*key, "place")]
    place = [F.col("place")] if "place" in stream.columns else []
    told = F.struct(F.lit(0).cast("bigint").alias(BATCH), F.lit(True).alias("last"), *[F.col(c) for c in values]).alias("v")
    bucket = F.pmod(F.xxhash64("candidate_id"), F.lit(buckets)).cast("int").alias(BUCKET)
    schema = StructType([*stream.select(*key, told).schema.fields, *stream.select(bucket).schema.fields])
    asked = key_long.select(F.lit("answer").alias("kind"), "question")
    if drawing_long is not None:
        asked = asked.unionByName(drawing_long.select(F.lit("drawing").alias("kind"), "question"))
    with dropping_shuffles(spark):
        asked = written(asked.distinct().withColumn("asked", F.lit(True)), "asked")

    def arriving(batch: DataFrame, batch_id: int) -> DataFrame:
        """The newest row of each key. Rows are dealt by parts of buckets, so that a task writes few files."""
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        part = F.pmod(F.hash("candidate_id"), F.lit(1 + 4 * tasks // buckets)).alias("part")
        rows = batch.select(*key, F.struct(*place, *values).alias("v"), bucket, part).repartition(tasks, BUCKET, "part")
        newest = rows.groupBy(*key, BUCKET, "part").agg(F.max("v").alias("v"))
        top = F.max("v").over(Window.partitionBy("candidate_id", BUCKET, "part"))
        newest = newest.withColumn("last", F.col("v").eqNullSafe(top))
        return newest.select(*key, F.struct(F.lit(batch_id).cast("bigint").alias(BATCH), "last", *[F.col("v")[c].alias(c) for c in values]).alias("v"), BUCKET)

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key, BUCKET).agg(F.max("v").alias("v"))

    def touched_sheets(rows: DataFrame, batch_id: int) -> DataFrame:
        """One row per sheet with rows in the batch: submission, paper type and the newest values of asked questions."""
        flagged = rows.join(asked, ["kind", "question"], "left").filter(F.col("candidate_id").isNotNull() & (F.col("asked") | F.col("v.last")))
        value = F.when(F.col("asked"), F.col("v.value")).alias("value")
        slim = flagged.select(*key, "asked", F.struct(f"v.{BATCH}", "v.last", "v.submission_id", "v.paper_type", value).alias("v"))
        one = spread(slim, "candidate_id").groupBy(*key, "asked").agg(F.max("v").alias("v"))
        given = F.collect_list(F.when(F.col("asked"), F.struct("kind", "question", "v.value"))).alias("given")
        sheets = one.groupBy("candidate_id").agg(F.max(F.struct(f"v.{BATCH}", "v.last", "v.submission_id", "v.paper_type")).alias("s"), given)
        return sheets.filter(F.col(f"s.{BATCH}") == batch_id).select("candidate_id", "s.submission_id", "s.paper_type", "given")

    def build(batch: DataFrame, batch_id: int) -> None:
        arriving(batch, batch_id).write.mode("overwrite").partitionBy(BUCKET).parquet(_batch_path(arrived, batch_id))
        mine = spark.read.schema(schema).parquet(_batch_path(arrived, batch_id))
        hit = F.col(BUCKET).isin([r[0] for r in mine.select(BUCKET).distinct().collect()])  # at most `buckets`
        seen = merged_rows(spark, arrived, schema, lambda rows: touched_sheets(rows.filter(hit), batch_id), batch_id + 1)
        path = new_path(spark, "touched-sheets")
        seen.write.parquet(path)
        seen = spark.read.schema(seen.schema).parquet(path)
        rows = seen.select("candidate_id", F.inline("given"))
        answers = rows.filter("kind = 'answer'").select("candidate_id", "question", F.col("value").alias("answer"))
        drawings = rows.filter("kind = 'drawing'").select("candidate_id", "question", F.col("value").alias("response"))
        marked = marking.marked_candidates(seen.drop("given"), keys, key_long, answers, drawing_long, drawings)
        marked.withColumn(BATCH, F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(_batch_path(out, batch_id))
        stored.remove(spark, path)
        if batch_id % every == every - 1:
            _compact(spark, arrived, schema, newest, batch_id, [BUCKET])
            _compact(spark, out, marked.withColumn(BATCH, F.lit(0).cast("bigint")).schema, _newest_marks, batch_id)

    def build_and_drop(batch: DataFrame, batch_id: int) -> None:
        with dropping_shuffles(spark, batch.sparkSession):
            build(batch, batch_id)

    stream.writeStream.option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).foreachBatch(build_and_drop).start().awaitTermination()


def _newest_marks(rows: DataFrame) -> DataFrame:
    columns = [c for c in rows.columns if c not in ("candidate_id", BATCH)]
    newest = rows.groupBy("candidate_id").agg(F.max_by(F.struct(*columns, BATCH), BATCH).alias("v"))
    return newest.select("candidate_id", "v.*").select(*rows.columns)


def streamed_marks(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The newest marks of each sheet; `schema` names the wanted columns, candidate_id among them."""
    return merged_rows(spark, out, f"{schema}, {BATCH} BIGINT", _newest_marks).drop(BATCH)
