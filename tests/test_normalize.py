"""Range fill, duplicate keys, formats and header rules on small hand-made inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from markspan.functions import modeljson
from markspan.operators import normalize


def formats(spark, rows):
    return spark.createDataFrame(rows, "format_id string, q_type string, q_range string")


def test_later_types_win_and_broken_ranges_vanish(spark):
    fmt = formats(spark, [("a", "mcq", "1-4"), ("a", "numeric", "6-3"), ("a", "drawing", "5-5"), ("a", "other", "x-2"), ("a", "bad", "")])
    got = {r.question: r.q_type for r in normalize.expected_questions(fmt).collect()}
    assert got == {"1": "mcq", "2": "mcq", "3": "numeric", "4": "numeric", "5": "drawing", "6": "numeric"}


def test_range_fill_and_answers_outside(spark):
    fmt = formats(spark, [("a", "mcq", "1-2"), ("a", "numeric", "3-3"), ("a", "drawing", "4-4")])
    raw = spark.createDataFrame(
        [(1, "Q01", "x", 0), (1, "1", "(b)", 1), (1, "3", " Paris ", 2), (1, "4", "a sketch", 3), (1, "9", "C", 4), (1, "10", "Rome", 5), (1, "name", None, 6), (2, "1", "F", 0)],
        "candidate_id bigint, k string, v string, pos int",
    )
    sheets = spark.createDataFrame([(1, "a"), (2, "none")], "candidate_id bigint, format_id string")
    keyed = normalize.keyed_answers(raw, ["candidate_id"], "k", "v", "pos")
    out = normalize.normalise_answers(keyed, sheets, normalize.expected_questions(fmt))
    got = {(r.candidate_id, r.question): r.answer for r in out.collect()}
    assert got == {
        (1, "1"): "B", (1, "2"): "BL", (1, "3"): "Paris", (1, "4"): "DR", (1, "9"): "C", (1, "10"): "Rome", (1, "name"): "BL", (2, "1"): "F",
    }
    maps = normalize.answer_maps(out.select("candidate_id", "question", "answer"), ["candidate_id"])
    first = maps.filter("candidate_id = 1").select(F.map_keys("answers")).first()[0]
    assert first == ["1", "2", "3", "4", "9", "10", "name"]


def test_options_of_the_sheet_are_used(spark):
    fmt = formats(spark, [("a", "mcq", "1-1"), ("b", "mcq", "1-1")])
    sheets = spark.createDataFrame([(1, "a", ["A", "B"]), (2, "b", ["f", "g"])], "candidate_id bigint, format_id string, options array<string>")
    keyed = spark.createDataFrame([(1, "1", "G"), (2, "1", "G"), (2, "5", "F")], "candidate_id bigint, question string, value string")
    out = normalize.normalise_answers(keyed, sheets, normalize.expected_questions(fmt))
    assert {(r.candidate_id, r.question): r.answer for r in out.collect()} == {(1, "1"): "IN", (2, "1"): "G", (2, "5"): "F"}


def test_last_of_equal_keys_wins_also_when_null(spark):
    raw = spark.createDataFrame([(1, "Q1", "A", 0), (1, "01", None, 1)], "candidate_id bigint, k string, v string, pos int")
    assert normalize.keyed_answers(raw, ["candidate_id"], "k", "v", "pos").first().value is None


def test_format_responses(spark):
    texts = {
        "obj": '{"mcq_range": {"end": 9}, "drawing_range": {"start": 0, "end": 3}, "answer_options": ["X"]}',
        "text": '```json\n{"mcq_range": "1 - 4", "numeric_range": "5-6", "description": "d"}\n```',
        "bad": '{"mcq_range": "one-two"}',
        "broken": '{"mcq_range": ',
        "nothing": "{}",
    }
    df = spark.createDataFrame(list(texts.items()), "format_id string, response string")
    got = {r.format_id: r for r in normalize.parse_format_responses(df).collect()}
    assert (got["obj"].mcq_start, got["obj"].mcq_end, got["obj"].drawing_start, got["obj"].answer_options) == (1, 9, None, ["X"])
    assert (got["text"].mcq_end, got["text"].numeric_start, got["text"].description) == (4, 5, "d")
    assert (got["bad"].description, got["broken"].description, got["bad"].numeric_end) == ("Fallback format", "Fallback format", 20)
    assert (got["nothing"].mcq_start, got["nothing"].total_questions, got["nothing"].description) == (None, 30, "Unknown format")


def test_json_recovery(spark):
    texts = {
        '{"a":1}': '{"a":1}', 'x {"a":1} y': '{"a":1}', '```\n{"a":1}\n```': '{"a":1}', "no": None, '{"a":1} {"b":2}': None, "": None,
        '[{"a":1}]': '{"a":1}', "{'a':1}": None, '```json\n[1]\n``` {"b":2}': '{"b":2}', '{"a":"}"} tail': '{"a":"}"}', None: None,
    }
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    got = [r[0] for r in df.select("n", modeljson.object_text(F.col("t")).alias("o")).orderBy("n").select("o").collect()]
    assert got == list(texts.values())


def test_last_of_repeated_names_counts(spark):
    df = spark.createDataFrame([('{"a":"1","b":"2","a":"3"}',)], "t string")
    assert df.select(modeljson.text_map(F.col("t"))).first()[0] == {"a": "3", "b": "2"}


def test_alias_folding_order(spark):
    rows = [({"name": "", "student_name": "S", "candidate_name": "C"},), ({"name": None, "student_name": ""},), ({"zone": "z"},)]
    df = spark.createDataFrame(rows, "fields map<string,string>")
    assert sorted(r.candidate_name for r in normalize.fold_aliases(df, "fields").collect()) == ["", "", "S"]
