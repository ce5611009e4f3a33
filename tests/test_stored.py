"""Changing stored tables, stopping halfway, and marking by request."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from markspan.operators import requests
from markspan.sources import results, stored


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(400).selectExpr("id AS candidate_id", "id % 40 AS submission_id", "concat('c', id) AS name")
    folder = str(tmp_path / "candidates")
    results.append_by_submission(rows, folder)
    return folder


def content(spark, folder, *columns):
    return sorted(map(tuple, stored.read_stored(spark, folder).select(*columns).collect()), key=repr)


def test_upsert_rewrites_touched_buckets_only(spark, table, tmp_path):
    before = {f.path: f.modificationTime for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(table).collect()}
    changes = spark.createDataFrame([(3, 3, 7), (43, 3, 8), (9999, 3, 9)], "candidate_id bigint, submission_id bigint, score int")
    stored.upsert(spark, table, changes)
    once = content(spark, table, "candidate_id", "submission_id", "name", "score")
    assert len(once) == 401 and (3, 3, "c3", 7) in once and (9999, 3, None, 9) in once and (4, 4, "c4", None) in once
    after = {f.path: f.modificationTime for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(table).collect()}
    bucket = spark.range(1).select(results.submission_bucket(F.lit(3).cast("bigint"))).first()[0]
    kept = {p for p in before if f"{stored.BUCKET}={bucket}/" not in p}
    assert kept and all(before[p] == after[p] for p in kept)
    stored.upsert(spark, table, changes)
    assert content(spark, table, "candidate_id", "submission_id", "name", "score") == once
    stored.upsert(spark, table, changes.limit(0))
    assert len(content(spark, table, "candidate_id")) == 401


def test_upsert_stopped_while_buckets_are_replaced(spark, table, monkeypatch):
    changes = spark.createDataFrame([(5, 5, 1)], "candidate_id bigint, submission_id bigint, score int")
    whole = stored.finish
    calls = []

    def stop(session, folder):
        """The touched bucket is gone already when the job dies."""
        calls.append(folder)
        if len(calls) == 2:
            bucket = session.read.parquet(f"{folder}/_pending/touched").first()[0]
            stored.remove(session, f"{folder}/{stored.BUCKET}={bucket}")
            raise RuntimeError
        whole(session, folder)

    monkeypatch.setattr(stored, "finish", stop)
    with pytest.raises(RuntimeError):
        stored.upsert(spark, table, changes)
    monkeypatch.undo()
    rows = content(spark, table, "candidate_id", "submission_id", "score")
    assert len(rows) == 400 and (5, 5, 1) in rows


def test_change_stopped_before_it_is_ready_leaves_no_trace(spark, table):
    spark.range(3).write.parquet(f"{table}/_pending/rows")
    assert len(content(spark, table, "candidate_id")) == 400
    assert not stored.exists(spark, f"{table}/_pending")


def test_deletion_over_tables_and_its_repetition(spark, table, tmp_path, monkeypatch):
    second, record = str(tmp_path / "answers"), str(tmp_path / "deletion")
    results.append_by_submission(spark.range(90).selectExpr("id", "id % 9 AS submission_id"), second)
    deleted = spark.createDataFrame([(k,) for k in (3, 3, 5, 77)] + [(None,)], "submission_id bigint")
    replace, done = stored._replace, []

    def stop(session, folder, *rest):
        if done:
            raise RuntimeError
        done.append(folder)
        replace(session, folder, *rest)

    monkeypatch.setattr(stored, "_replace", stop)
    with pytest.raises(RuntimeError):
        stored.delete_submissions(spark, [table, second], deleted, record)
    monkeypatch.undo()
    assert stored.exists(spark, record)
    stored.resume_deletion(spark, [table, second], record)
    assert not stored.exists(spark, record)
    assert len(content(spark, table, "candidate_id")) == 380 and len(content(spark, second, "id")) == 70
    assert {r[0] for r in content(spark, second, "submission_id")} == {0, 1, 2, 4, 6, 7, 8}
    stored.delete_submissions(spark, [table, second], deleted, record)
    assert len(content(spark, table, "candidate_id")) == 380


def test_a_bucket_that_loses_all_rows_goes(spark, tmp_path):
    folder = str(tmp_path / "t")
    results.append_by_submission(spark.createDataFrame([(1, 1), (2, 2)], "candidate_id bigint, submission_id bigint"), folder)
    stored.delete_submissions(spark, [folder], spark.createDataFrame([(1,)], "submission_id bigint"), str(tmp_path / "r"))
    assert content(spark, folder, "candidate_id") == [(2,)]


def test_reads_of_touched_buckets_are_pruned(spark, table):
    plan = stored.read_stored(spark, table).filter(F.col(stored.BUCKET).isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(submission_bucket" in plan or "PartitionFilters: [(submission_bucket" in plan


REQUESTS = "request_id bigint, submission_id bigint, key_id bigint, answer_key map<string,string>, drawing_key map<string,string>"


def test_requests(spark):
    subs = spark.createDataFrame([(1, "completed"), (2, "failed"), (3, "completed"), (4, None)], "submission_id bigint, status string")
    sheets = spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "candidate_id bigint, submission_id bigint")
    key = spark.createDataFrame([(7, 1, "A"), (7, 2, "B"), (8, 1, "C")], "key_id bigint, question bigint, correct string")
    drawing = spark.createDataFrame([(7, 30, "arc")], "key_id bigint, question bigint, expected string")
    answers = spark.createDataFrame([(10, 1, "a"), (10, 2, "IN"), (11, 2, "C"), (10, 99, "B")], "candidate_id bigint, question bigint, answer string")
    drawn = spark.createDataFrame([(11, 30, "an ARC")], "candidate_id bigint, question bigint, response string")
    b20 = {str(k): "B" for k in range(1, 21)}
    wanted = [
        (1, 1, 7, None, None), (2, 1, None, b20, {"30": "line"}), (3, 9, 7, None, None), (4, 2, 7, None, None), (5, 1, 5, b20, None),
        (6, 1, None, None, None), (7, 1, 0, {}, None), (8, 3, 7, None, None), (9, 4, 7, None, None), (10, 1, 0, {"1": "A"}, {}),
    ]
    req = spark.createDataFrame(wanted, REQUESTS)
    told = {r.request_id: r.reason for r in requests.checked_requests(req, subs, key, sheets).collect()}
    assert told == {
        1: None, 2: None, 3: requests.NO_SUBMISSION, 4: requests.NOT_COMPLETED, 5: requests.NO_KEY, 6: requests.NO_KEY_GIVEN, 7: requests.NO_KEY_GIVEN,
        8: requests.NO_CANDIDATES, 9: requests.NOT_COMPLETED, 10: None,
    }
    got = requests.marked_by_request(req, subs, sheets, key, drawing, answers, drawn)
    rows = {(r.request_id, r.candidate_id): r for r in got.withColumn("questions", F.map_keys("marked_answers")).collect()}
    assert sorted(rows) == [(1, 10), (1, 11), (2, 10), (2, 11), (10, 10), (10, 11)]
    assert rows[1, 10].marked_answers == {"1": "P", "2": "IN"} and rows[1, 10].marked_drawing == {"30": "BL"}
    assert (rows[1, 11].correct, rows[1, 11].total, rows[1, 11].percentage) == (1, 3, 33.3)
    assert rows[2, 11].questions == list(b20) and rows[2, 11].marked_drawing == {"30": "IM"} and rows[2, 11].total == 21
    assert rows[10, 10].marked_drawing is None and (rows[10, 10].correct, rows[10, 10].total) == (1, 1)
