"""Key matching, marking invariants and plans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from markspan.operators import marking


def brute_match(pt, keys):
    by_type = {}
    for key_id, kt in keys:
        kt = (kt or "").strip().upper()
        if kt:
            by_type[kt] = key_id
    pt = ("NONE" if pt is None else pt).strip().upper()
    if pt in by_type:
        return by_type[pt]
    return next((k for t, k in by_type.items() if t in pt or pt in t), None)


def test_matching_equals_brute_force(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ab1") for _ in range(n))
    keys = [(n, rng.choice(["", None, " "]) if n % 9 == 0 else word(rng.randrange(1, 5))) for n in range(1, 30)]
    sheets = [(n, rng.choice([None, "", "  ", "none"]) if n % 10 == 0 else word(rng.randrange(1, 8))) for n in range(1, 400)]
    got = marking.match_keys(
        spark.createDataFrame(sheets, "candidate_id bigint, paper_type string"), spark.createDataFrame(keys, "key_id bigint, paper_type string")
    )
    want = {c: brute_match(pt, keys) for c, pt in sheets}
    assert {r.candidate_id: r.key_id for r in got.collect()} == want


def test_null_can_count_as_empty(spark):
    sheets = spark.createDataFrame([(1, None)], "candidate_id bigint, paper_type string")
    keys = spark.createDataFrame([(4, "X"), (2, "Y")], "key_id bigint, paper_type string")
    assert marking.match_keys(sheets, keys).first().key_id is None
    assert marking.match_keys(sheets, keys, null_as_empty=True).first().key_id == 2


@pytest.fixture(scope="module")
def exam(spark):
    rng = random.Random(3)
    sheets = [(c, c % 7, rng.choice(["P1", "p1 ", "P2x", "zz", None])) for c in range(300)]
    answers = [(c, str(q), rng.choice(["A", "b", "C", "BL", "IN"])) for c in range(300) for q in range(1, 9) if rng.random() < 0.8]
    answers += [(5, str(q), "A") for q in range(100, 400)]
    key = [(1, str(q), rng.choice("ABC")) for q in range(1, 7)] + [(2, str(q), rng.choice("abc")) for q in range(1, 17)]
    drawing = [(2, "30", "arc"), (2, "31", "")]
    responses = [(c, str(q), rng.choice(["an ARC", "line", " "])) for c in range(300) for q in (30, 31) if rng.random() < 0.6]
    return {
        "sheets": spark.createDataFrame(sheets, "candidate_id bigint, submission_id bigint, paper_type string"),
        "keys": spark.createDataFrame([(1, "P1"), (2, "P2")], "key_id bigint, paper_type string"),
        "key": spark.createDataFrame(key, "key_id bigint, question string, correct string"),
        "answers": spark.createDataFrame(answers, "candidate_id bigint, question string, answer string"),
        "drawing": spark.createDataFrame(drawing, "key_id bigint, question string, expected string"),
        "responses": spark.createDataFrame(responses, "candidate_id bigint, question string, response string"),
    }


def test_scores_agree_with_marks(exam):
    matched = marking.match_keys(exam["sheets"], exam["keys"])
    scored = marking.scores(matched, exam["key"], exam["answers"], exam["drawing"], exam["responses"])
    asked = matched.select("candidate_id", "key_id").join(exam["key"], "key_id")
    marks = marking.mark_answers(asked, exam["answers"]).select("candidate_id", "question", "mark")
    drawn = matched.select("candidate_id", "key_id").join(exam["drawing"], "key_id")
    marks = marks.unionByName(marking.mark_drawings(drawn, exam["responses"]).select("candidate_id", "question", "mark"))
    assert marks.groupBy("candidate_id", "question").count().filter("count > 1").count() == 0
    direct = {tuple(r) for r in scored.filter("key_id IS NOT NULL").select("candidate_id", "correct", "total", "percentage").collect()}
    assert direct == {tuple(r) for r in marking.scores_from_marks(marks).collect()}
    assert scored.filter("correct > total").count() == 0
    assert scored.count() == exam["sheets"].count()


def test_whole_results_agree_with_scores(exam):
    matched = marking.match_keys(exam["sheets"], exam["keys"])
    columns = ["candidate_id", "key_id", "correct", "total", "percentage"]
    a = marking.scores(matched, exam["key"], exam["answers"], exam["drawing"], exam["responses"]).select(*columns)
    b = marking.marked_sheets(matched, exam["key"], exam["answers"], exam["drawing"], exam["responses"])
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*columns).collect()))
    for r in b.filter("key_id = 2").select(F.map_keys("marked_answers"), F.map_keys("marked_drawing")).collect():
        assert tuple(r) == ([str(q) for q in range(1, 17)], ["30", "31"])
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(candidate_id") <= 2


def test_result_does_not_depend_on_partitioning(exam):
    def run(parts):
        def spread(df):
            return df.orderBy(F.rand(parts)).repartition(parts)

        out = marking.marked_candidates(
            spread(exam["sheets"]), exam["keys"], exam["key"], spread(exam["answers"]), exam["drawing"], spread(exam["responses"])
        )
        return sorted(map(repr, out.select("candidate_id", "key_id", "correct", "total", "percentage").collect()))

    assert run(1) == run(6)


def test_no_cross_join_in_matching(exam):
    out = marking.marked_candidates(exam["sheets"], exam["keys"], exam["key"], exam["answers"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    types = marking.type_matches(
        exam["sheets"].select(marking.type_name(F.col("paper_type")).alias("paper_type_norm")).distinct(), marking.keys_by_type(exam["keys"])
    )
    plan += types._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_inline_key(spark, exam):
    asked = marking.with_inline_key(exam["sheets"].select("candidate_id"), {1: "A", 99: "B"})
    marks = marking.mark_answers(asked, exam["answers"])
    assert marks.count() == 600
    assert {r.mark for r in marks.filter("question = '99'").collect()} == {"BL"}


def test_long_paper_types(spark):
    long = "x" + "AB12" * 1300
    keys = spark.createDataFrame([(1, long + "TAIL"), (2, "B12A"), (3, "ZZ")], "key_id bigint, paper_type string")
    types = spark.createDataFrame([(10, long), (11, "QB12AQ"), (12, "nothing"), (13, "12AB12TAIL"), (14, "")], "candidate_id bigint, paper_type string")
    got = {r.candidate_id: (r.key_id, r.match_kind) for r in marking.match_keys(types, keys).collect()}
    assert got == {10: (1, "contains"), 11: (2, "contains"), 12: (None, None), 13: (1, "contains"), 14: (1, "contains")}
