"""Streams over several batches give what the batch operators give, also after a replay."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from markspan.operators import marking
from markspan.plans.views import Inputs
from markspan.session import new_path
from markspan.streaming import jobs

LOG = "id BIGINT, submission_id BIGINT, action STRING, message STRING, extra_data STRING, created_at TIMESTAMP_NTZ"


MARKS = "candidate_id BIGINT, key_id BIGINT, correct BIGINT, total BIGINT, percentage DOUBLE"
SHEETS = "candidate_id BIGINT, submission_id BIGINT, paper_type STRING, kind STRING, question BIGINT, value STRING"


def files(df, spark, name, n=3):
    path = new_path(spark, name)
    df.repartition(n).write.parquet(path)
    return path


def rows(df):
    return sorted(map(repr, df.collect()))


def test_status_and_lifecycle_over_batches(spark, folder):
    """Many batches: few folders are read, and neither a second run nor a replayed batch changes anything."""
    log = Inputs(spark, folder).log.select("id", "submission_id", "action", "message", "extra_data", "created_at")
    path = files(log, spark, "log", 11)
    for track, tracked, build in (
        (jobs.track_status, jobs.tracked_status, jobs.live_status),
        (jobs.track_lifecycle, jobs.tracked_lifecycle, jobs.lifecycle),
    ):
        out = new_path(spark, "out")
        track(jobs.read_new_files(spark, path, LOG, files_per_batch=1), out, 3)
        got = tracked(spark, out)
        want = rows(build(log).select(*got.columns))
        assert rows(got) == want
        assert len(jobs._current(spark, out)) <= 1 + 3
        found = jobs._folders(spark, out)
        assert len(found[jobs.SNAPSHOT]) <= 2 and len(found[jobs.BATCH]) <= 2 * 3
        track(jobs.read_new_files(spark, path, LOG, 1), out, 3)
        log.filter("id % 2 = 0").limit(50).createOrReplaceTempView("again")
        part = jobs._status_parts if track is jobs.track_status else jobs._lifecycle_parts
        part(spark.table("again")).write.parquet(jobs._batch_path(out, 11))  # events that have come before
        assert rows(tracked(spark, out)) == want


def test_a_compaction_that_stopped_is_not_read(spark):
    out = new_path(spark, "out")
    log = spark.createDataFrame([(1, 1, "upload", None, None, None)], LOG)
    jobs._lifecycle_parts(log).write.parquet(jobs._batch_path(out, 0))
    spark.range(5).write.parquet(f"{out}/{jobs.SNAPSHOT}=0")
    jobs.stored.remove(spark, f"{out}/{jobs.SNAPSHOT}=0/_SUCCESS")
    assert [tuple(r) for r in jobs.tracked_lifecycle(spark, out).collect()] == [(1, "pending")]
    assert jobs.tracked_lifecycle(spark, new_path(spark, "none")).collect() == []


def test_a_finished_state_stays(spark):
    events = [(1, 1, "upload", 1), (2, 1, "extract_complete", 2), (3, 1, "page_progress", 3), (4, 2, "extract_error", 1), (5, 2, "extract_start", 2), (6, 3, "page_progress", 1), (7, 4, "other", 1)]
    log = spark.createDataFrame(events, "id bigint, submission_id bigint, action string, t int").withColumn(
        "created_at", F.timestamp_seconds(F.col("t")).cast("timestamp_ntz")
    )
    assert {r.submission_id: r.status for r in jobs.lifecycle(log).collect()} == {1: "completed", 2: "failed", 3: "processing"}


def test_one_format_call_per_layout(spark, tmp_path):
    pages = spark.createDataFrame([(n, f"L{n % 4}", n / 100) for n in range(40)], "page bigint, layout_hash string, quality double")
    path, out, calls = files(pages, spark, "layouts"), new_path(spark, "formats"), str(tmp_path)

    def fmt(row):
        import uuid

        open(f"{calls}/{row['format_id']}-{uuid.uuid4().hex}", "w").close()
        return json.dumps({"description": row["format_id"]})

    jobs.detect_new_layouts(jobs.read_new_files(spark, path, "page BIGINT, layout_hash STRING, quality DOUBLE", 1), fmt, out)
    assert sorted(r.format_id for r in spark.read.parquet(out).collect()) == ["L0", "L1", "L2", "L3"]
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["L0", "L1", "L2", "L3"]


def test_marks_over_batches(spark, folder):
    i = Inputs(spark, folder)
    keys = i.key.select("key_id", "paper_type").distinct()
    answers = i.ans.select("candidate_id", F.lit("answer").alias("kind"), "question", F.col("answer").alias("value"))
    path = new_path(spark, "sheets")
    i.sheet.join(answers, "candidate_id", "left").repartition(3, "candidate_id").write.parquet(path)
    schema = "candidate_id BIGINT, submission_id BIGINT, paper_type STRING, kind STRING, question BIGINT, value STRING"
    out = new_path(spark, "scores")
    jobs.mark_new_sheets(jobs.read_new_files(spark, path, schema, files_per_batch=1), keys, i.key, out)
    got = jobs.streamed_marks(spark, out, MARKS)
    want = marking.marked_candidates(i.sheet, keys, i.key, i.ans).select(*got.columns)
    assert rows(got) == rows(want)


def test_marks_read_touched_buckets_and_decide_ties(spark, monkeypatch):
    keys = spark.createDataFrame([(1, "P")], "key_id bigint, paper_type string")
    key = spark.createDataFrame([(1, 1, "A"), (1, 2, "B")], "key_id bigint, question bigint, correct string")
    path, out = new_path(spark, "sheets"), new_path(spark, "scores")
    plans = []
    merged = jobs.merged_rows

    def spy(*args):
        got = merged(*args)
        plans.append(got._jdf.queryExecution().executedPlan().toString())
        return got

    monkeypatch.setattr(jobs, "merged_rows", spy)
    batches = [
        [(c, 9, "P", "answer", 1, "A") for c in range(40)],
        # Two answers of one question in one batch: the later row counts.
        [(7, 9, "P", "answer", 1, "C"), (7, 9, "P", "answer", 1, "A"), (7, 9, "P", "answer", 2, "B"), (8, 9, "P", "answer", 1, "A"), (8, 9, "P", "answer", 1, "C")],
        [(9, 9, "x", None, None, None)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, SHEETS).coalesce(1).write.mode("append").parquet(path)
        jobs.mark_new_sheets(jobs.with_place(jobs.read_new_files(spark, path, SHEETS)), keys, key, out, every=2, buckets=16)
    assert any("PartitionFilters: [isnotnull(bucket" in p or "PartitionFilters: [bucket" in p for p in plans)
    marks = {r.candidate_id: (r.key_id, r.correct) for r in jobs.streamed_marks(spark, out, MARKS).collect()}
    assert len(marks) == 40 and marks[7] == (1, 2) and marks[8] == (1, 0) and marks[9] == (None, None) and marks[0] == (1, 1)
    assert len(jobs._current(spark, f"{out}-rows")) == 2


def shuffle_files(spark):
    listed = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in listed.split("\n") if "/shuffle_" in f}


def test_batches_leave_no_shuffle_files(spark):
    """Batches leave neither shuffles nor the rows they were marked from; stored rows carry no places and lie in few files.

    The row that names a sheet's submission need not be one that a key asks for; rows of a null candidate mark nothing."""
    keys = spark.createDataFrame([(1, "P")], "key_id bigint, paper_type string")
    key = spark.createDataFrame([(1, 1, "A"), (1, 2, "B")], "key_id bigint, question bigint, correct string")
    drawn = spark.createDataFrame([(1, 31, "arc")], "key_id bigint, question bigint, expected string")
    path, out = new_path(spark, "sheets"), new_path(spark, "scores")
    sheet = [(c, 9, "x", "answer", 1, "A") for c in range(300)] + [(None, 9, "P", "answer", 1, "A")]
    batches = [sheet, [(c, 8, "P", "drawing", 31 + c % 2, "an arc") for c in range(200)] + [(0, 7, "P", "other", 5, "z")]]
    before = shuffle_files(spark)
    for batch in batches:
        spark.createDataFrame(batch, SHEETS).coalesce(1).write.parquet(path, mode="append")
        jobs.mark_new_sheets(jobs.with_place(jobs.read_new_files(spark, path, SHEETS)), keys, key, out, drawn)
    assert shuffle_files(spark) - before == set()
    stored = spark.read.parquet(f"{out}-rows")
    assert stored.schema["v"].dataType.names == ["batch_id", "last", "submission_id", "paper_type", "value"]
    assert len(stored.filter("batch_id = 0").inputFiles()) <= 2 * jobs.ROW_BUCKETS
    assert not [f for f in jobs.stored._path(spark, out)[0].listStatus(jobs.stored._path(spark, out)[1].getParent()) if "touched" in f.getPath().getName()]
    marks = {r.candidate_id: (r.submission_id, r.key_id, r.correct) for r in jobs.streamed_marks(spark, out, f"submission_id BIGINT, {MARKS}").collect()}
    assert marks == {c: (9, None, None) if c >= 200 else (8 if c else 7, 1, 2 - c % 2) for c in range(300)}


def test_new_responses_are_read_once(spark):
    path, out = new_path(spark, "responses"), new_path(spark, "answers")
    schema = "candidate_id BIGINT, response STRING"
    for n in range(2):
        spark.createDataFrame([(n, '{"answers": {"Q1": "a", "": "x", "2": null}}'), (10 + n, "broken")], schema).write.mode("append").parquet(path)
        jobs.process_new_responses(jobs.read_new_files(spark, path, schema), "candidate_id", out)
    got = spark.read.parquet(out)
    assert rows(got) == rows(spark.createDataFrame([(n, q, a) for n in range(2) for q, a in (("1", "A"), ("2", "BL"))], got.schema))
