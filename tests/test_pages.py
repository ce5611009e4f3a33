"""Measured pages, layouts and model calls."""

from __future__ import annotations

import hashlib
import json
import time

import numpy as np
from pyspark.sql import functions as F

from markspan.functions import pixels
from markspan.operators import infer, layout, marks, normalize
from markspan.plans import page_flow


def test_layout_hash_equals_hand_made_text(spark):
    regions = [(1, "header", 0, 0, 1000, 280), (1, "answer_grid", 310, 700, 650, 500), (1, "answer_grid", 310, 700, 650, 500), (2, "drawing_area", -20, 5, 99, 139)]
    df = spark.createDataFrame(regions, "page bigint, region_type string, x int, y int, w int, h int").withColumns({"page_w": F.lit(1000), "page_h": F.lit(1400)})
    got = {r.page: r.layout_hash for r in layout.layout_hashes(df).collect()}
    text = {1: "answer_grid:3,5,6,3|answer_grid:3,5,6,3|header:0,0,10,2", 2: "drawing_area:0,0,0,0"}
    assert got == {p: hashlib.md5(t.encode()).hexdigest()[:12] for p, t in text.items()}


def test_pixel_measures(spark):
    rng = np.random.default_rng(1)
    page = rng.integers(0, 256, (6, 4))
    df = spark.createDataFrame([(1, 4, 6, [int(x) for x in page.ravel()])], "page_id bigint, width int, height int, pixels array<int>")
    row = layout.page_quality(layout.page_stats(df)).first()
    padded = np.pad(page, 1, mode="reflect")
    lap = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * page
    assert abs(row.std_dev - page.std()) < 1e-9
    assert abs(row.laplacian_var - lap.var()) < 1e-6
    assert row.image_hash == hashlib.sha256("".join("1" if x > page.mean() else "0" for x in page.ravel()).encode()).hexdigest()
    assert abs(row.quality - (min(lap.var() / 500, 1) * 0.6 + (page.max() - page.min()) / 255 * 0.4)) < 1e-9
    assert df.select(F.size(pixels.top_rows(F.col("pixels"), F.col("width"), F.col("height")))).first()[0] == 4


def test_laplacian_of_pages_of_many_sizes(spark):
    rng = np.random.default_rng(2)
    pages = [(k, [int(v) for v in rng.integers(0, 256, h * w)], w) for k, (h, w) in enumerate([(3, 4), (4, 3), (6, 2), (3, 4), (2, 6), (12, 1)] * 5)]
    df = spark.createDataFrame(pages, "page bigint, pixels array<int>, width int").repartition(3)
    got = {r.page: r.v for r in df.select("page", pixels.laplacian_variance("pixels", "width").alias("v")).collect()}
    for page, px, w in pages:
        grid = np.pad(np.array(px).reshape(-1, w), 1, mode="reflect")
        lap = grid[:-2, 1:-1] + grid[2:, 1:-1] + grid[1:-1, :-2] + grid[1:-1, 2:] - 4 * grid[1:-1, 1:-1]
        assert abs(got[page] - lap.var()) < 1e-6


def test_blank_needs_all_three_and_unmeasured_is_kept(spark):
    rows = [(1, 9.0, 0.001, 0.0005), (2, 9.0, 0.002, 0.0005), (3, 10.0, 0.0, 0.0), (4, None, 0.0, 0.0), (5, 9.0, 0.0, None)]
    df = spark.createDataFrame(rows, "page_id int, s double, i double, e double")
    assert [r.page_id for r in df.filter(layout.blank_by_measures(F.col("s"), F.col("i"), F.col("e"))).collect()] == [1]


def test_representative_page(spark):
    rows = [("a", 3, 0.5), ("a", 1, 0.5), ("a", 2, 0.1), ("b", 9, 0.0), ("b", 4, -1.0), ("c", 7, None), ("c", 8, 0.2)]
    df = spark.createDataFrame(rows, "layout_hash string, page bigint, quality double")
    assert {r.layout_hash: r.page for r in layout.representative_pages(df).collect()} == {"a": 1, "b": 4, "c": 8}


def test_marked_options(spark):
    rows = [(1, 1, 1, 0.2, 0.2), (1, 1, 2, 0.1, 0.1), (1, 2, 1, 0.2, 0.2), (1, 2, 2, 0.19, 0.19), (1, 3, 1, 0.05, 0.05), (1, 4, 2, 0.3, 0.3), (1, 5, 2, 0.12, 0.12), (1, 5, 1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "page bigint, question bigint, opt bigint, ink_ratio double, lower_ink double")
    assert {r.question: r.opt for r in marks.marked_options(df).collect()} == {1: 1, 2: None, 3: None, 4: 2, 5: 2}


def test_merge_precedence(spark):
    def side(rows):
        return spark.createDataFrame(rows, "page bigint, question string, answer string")

    full = side([(1, "1", "A"), (1, "2", "A"), (1, "3", "BL"), (1, "4", "A"), (1, "6", "A")])
    focused = side([(1, "1", "B"), (1, "2", "BL"), (1, "3", "BL"), (1, "5", "BL"), (1, "7", "C")])
    measured = side([(1, "4", " c "), (1, "6", "Z"), (1, "8", "D")])
    got = {r.question: r.answer for r in marks.merge_sources(full, focused, measured).collect()}
    assert got == {"1": "B", "2": "A", "3": "BL", "4": "C", "6": "A", "7": "C", "8": "D"}


def test_retries_and_error_rows(spark, tmp_path):
    pages = spark.range(6).withColumnRenamed("id", "page")
    folder = str(tmp_path)

    def flaky(row):
        page = int(row["page"])
        if page == 2:
            raise RuntimeError("always")
        mark = f"{folder}/{page}"
        if page == 3:
            import os

            if not os.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("once")
        return json.dumps({"answers": {"1": "A"}})

    got = {r.page: r for r in infer.call_pages(pages, flaky, waits=(0.0,), concurrency=2).collect()}
    assert (got[2].response, got[2].attempts, got[2].error) == (None, 3, "always")
    assert (got[3].attempts, got[3].error) == (2, None)
    assert len(got) == 6 and got[0].attempts == 1


def test_calls_in_flight(spark):
    """40 slow pages on 2 tasks with 4 calls in flight take about an eighth of the time one after another, with the same rows."""
    def slow(row):
        time.sleep(0.3)
        return f"page {row['page']}"

    pages = spark.range(40).withColumnRenamed("id", "page")
    spark.range(8).mapInPandas(lambda b: b, "id bigint").count()  # workers are there

    def timed(**kwargs):
        begin = time.monotonic()
        got = sorted(map(tuple, infer.call_pages(pages, slow, waits=(), **kwargs).collect()))
        return got, time.monotonic() - begin

    together, quick = timed(concurrency=2, in_flight=4)
    alone, long = timed(concurrency=1)
    assert together == alone == [(k, f"page {k}", 1, None) for k in range(40)]
    assert long >= 12 and quick < long / 4


def test_a_page_that_waits_holds_no_call_back():
    begun, running, most = {}, 0, 0

    def flaky(row):
        nonlocal running, most
        running += 1
        most = max(most, running)
        try:
            time.sleep(0.02)
            begun.setdefault(row["page"], []).append(time.monotonic())
            if row["page"] < 3 and len(begun[row["page"]]) < 3:
                raise ValueError("again")
            if row["page"] == 9:
                raise KeyError("gone")
            return "x"
        finally:
            running -= 1

    start = time.monotonic()
    got = {row["page"]: rest for row, *rest in infer._calls(iter([{"page": k} for k in range(30)]), flaky, 3, (0.3, 0.6), 2)}
    took = time.monotonic() - start
    assert len(got) == 30 and got[0] == ["x", 3, None] and got[9] == [None, 3, "'gone'"] and got[20] == ["x", 1, None]
    assert most == 2 and took < 3  # one after another the waits alone take 3.6 s
    assert begun[20][0] < begun[0][1] + 0.3
    assert list(infer._calls(iter([]), flaky, 3, (), 4)) == []


def test_only_needed_pages_reach_the_model(spark, tmp_path):
    calls = str(tmp_path)
    pages = spark.createDataFrame(
        [(1, "L1", 0.9, False), (2, "L1", 0.5, False), (3, "L2", 0.9, False), (4, "L2", 0.1, True)], "page bigint, layout_hash string, quality double, is_blank boolean"
    )
    cells = spark.createDataFrame([(1, 1, 2, 0.5, 0.5), (1, 2, 1, 0.5, 0.5)], "page bigint, question bigint, opt bigint, ink_ratio double, lower_ink double")

    def seen(kind, row):
        import uuid

        open(f"{calls}/{kind}-{row['page']}-{uuid.uuid4().hex}", "w").close()

    def fmt(row):
        seen("format", row)
        return '{"mcq_range": {"start": 1, "end": 2}}' if row["page"] == 1 else "?"

    def full(row):
        seen("full", row)
        return "nothing" if row["page"] == 3 else '{"answers": {"1": "c", "2": "no answer"}}'

    def focused(row):
        seen("focused", row)
        return '{"answers": {"2": "D"}}'

    answers, records = page_flow.extract(pages, cells, fmt, full, focused, waits=())
    got = {(r.page, r.question): (r.answer, r.method) for r in answers.collect()}
    assert got == {(1, "1"): ("B", "cv_only"), (1, "2"): ("A", "cv_only"), (2, "1"): ("C", "llm_full"), (2, "2"): ("D", "llm_full")}
    kinds = {r.page: (r.method, r.confidence, r.error) for r in records.collect()}
    assert kinds == {1: ("cv_only", 0.95, None), 2: ("llm_full", 0.9, None), 3: ("failed", 0.0, page_flow.NO_OBJECT)}
    made = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    assert made == ["focused-2", "format-1", "format-3", "full-2", "full-3"]


def test_drawings_win_over_answers(spark):
    text = '{"answers": {"1": "A", "2": "B"}, "drawing_questions": {"2": "arc", "7": "line"}}'
    df = spark.createDataFrame([(1, text), (2, '{"answers": null}'), (3, "x")], "page bigint, response string")
    rows = page_flow.response_answers(df, drawings=True)
    kept = normalize.keyed_answers(rows, ["page"], "raw_key", "raw_value", "pos")
    assert {(r.page, r.question): r.value for r in kept.collect()} == {(1, "1"): "A", (1, "2"): "DR", (1, "7"): "DR"}
