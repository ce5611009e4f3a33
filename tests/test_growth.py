"""Work that must stay spread, or off the shuffle, as tables grow."""

from __future__ import annotations

import threading

import pytest

from markspan.operators import infer, normalize
from markspan.plans import page_flow, queries_stream
from markspan.plans.catalog import spark_queries
from markspan.plans.views import Inputs
from markspan.sources import results, stored


@pytest.mark.parametrize("view", ["v_ans", "v_draw", "v_text", "v_resp"])
def test_sheet_views_keep_all_tasks(spark, folder, view):
    """Parts are not merged by their packed bytes before the rows of a sheet are grouped."""
    assert Inputs(spark, folder).view(view).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_expected_questions_are_not_shuffled(spark):
    """Ranges meet by format, their questions do not; equal and overlapping ranges give each question once."""
    rows = [("a", "mcq", "1-4"), ("a", "mcq", "1-4"), ("a", "mcq", "3-6"), ("a", "zeta", "6-8"), ("a", None, "8-9"), ("a", "alpha", "6-7"), ("a", "drawing", "4-4"), (None, "mcq", "2-2")]
    df = spark.createDataFrame(rows, "format_id string, q_type string, q_range string")
    out = normalize.expected_questions(df)
    got = sorted(map(tuple, out.collect()), key=repr)
    want = {"1": "mcq", "2": "mcq", "3": "mcq", "4": "drawing", "5": "mcq", "6": "zeta", "7": "zeta", "8": "zeta", "9": None}
    assert got == sorted([*[("a", q, t) for q, t in want.items()], (None, "2", "mcq")], key=repr)
    # In a plan, what comes first runs last.
    plan = normalize.expected_questions(df)._jdf.queryExecution().executedPlan().toString()
    assert "sequence" in plan and plan.index("sequence") < plan.index("Exchange")


def test_small_documents_share_files(spark, tmp_path):
    """The number of files follows the size of the documents, not their number."""
    lines = spark.range(3000).selectExpr("id div 3 AS submission_id", "CAST(id % 3 AS INT) AS section", "0L AS n", "concat('l', id) AS line")
    results.write_source_documents(lines, str(tmp_path / "docs"), 1000)
    assert len([p for p in (tmp_path / "docs").rglob("part-*") if p.is_file()]) < 50
    texts = {r.submission_id: r.document for r in results.document_texts(results.read_source_documents(spark, str(tmp_path / "docs"))).collect()}
    assert texts == {k: f"l{3 * k}\nl{3 * k + 1}\nl{3 * k + 2}\n" for k in range(1000)}


def test_words_are_not_shuffled(spark, folder):
    """Texts are dealt out before they are cut into words."""
    plan = spark_queries()["u6_distinct_in_order"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_one_call_at_a_time_needs_no_thread():
    def fn(row):
        if row["page"] == 1:
            raise ValueError("gone")
        return threading.current_thread().name

    got = sorted((r["page"], a, t, e) for r, a, t, e in infer._calls(iter([{"page": 0}, {"page": 1}]), fn, 3, (), 1))
    assert got == [(0, threading.current_thread().name, 1, None), (1, None, 3, "gone")]


def test_changes_are_calculated_once(spark, tmp_path):
    folder, seen = str(tmp_path / "t"), spark.sparkContext.accumulator(0)
    results.append_by_submission(spark.range(20).selectExpr("id AS candidate_id", "id % 5 AS submission_id"), folder)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    changes = spark.range(3).selectExpr("id AS candidate_id", "id % 5 AS submission_id", "7 AS score").mapInPandas(counted, "candidate_id bigint, submission_id bigint, score int")
    stored.upsert(spark, folder, changes)
    assert seen.value == 3


def test_sheets_are_staged_by_all_tasks(spark, folder, monkeypatch):
    class Staged(Exception):
        pass

    def stop(i, df, name):
        raise Staged(df.rdd.getNumPartitions())

    monkeypatch.setattr(queries_stream, "staged", stop)
    with pytest.raises(Staged) as e:
        spark_queries()["r4_streaming_marks"](spark, folder)
    assert e.value.args[0] == 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_formats_and_pages_do_not_go_through_the_driver(spark, monkeypatch):
    """Many formats, and what has a row for each page, are joined by sorting, however small their files are."""
    monkeypatch.setattr("markspan.session.FEW_ROWS", 2, raising=False)
    plans = []
    kept = page_flow.written
    monkeypatch.setattr(page_flow, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    pages = spark.range(6).selectExpr("id AS page", "concat('h', id) AS layout_hash", "0.5D AS quality", "false AS is_blank")
    cells = spark.range(12).selectExpr("id div 2 AS page", "1L AS question", "id % 2 + 1 AS opt", "0.1D + 0.5D * (id % 2) AS ink_ratio", "0.1D AS lower_ink")

    def fmt(row):
        return '{"mcq_range": "1-%d"}' % (1 + row["page"] % 2)

    answers = page_flow.extract(pages, cells, fmt, lambda row: '{"answers": {"1": "C", "2": "A"}}', lambda row: '{"answers": {}}', waits=()).answers
    got = {(r.page, r.question): (r.answer, r.method) for r in answers.collect()}
    measured = {(p, "1"): ("B", "cv_only") for p in (0, 2, 4)}
    assert got == measured | {(p, q): (a, "llm_full") for p in (1, 3, 5) for q, a in (("1", "B"), ("2", "A"))}
    plans.append(answers._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and [p for p in plans if "Broadcast" in p] == []
