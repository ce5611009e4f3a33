"""Hand-worked truth tables of the vocabulary rules."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from markspan.functions import codes


def apply(spark, expr, values):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
    return [r[0] for r in df.select("n", expr(F.col("v")).alias("x")).orderBy("n").select("x").collect()]


MCQ = {
    None: "BL", "": "BL", "  ": "BL", "n/a": "BL", "No Answer": "BL", "null": "BL", "b": "B", " (c) ": "C", "A and C": "IN",
    "CORRECT: B": "B", "BB": "B", "BLACK": "IN", "7": "IN", "multi-mark": "IN", "illegible": "IN", "a.": "A", "A1": "A",
    "XA": "A", "X": "IN", "option-d": "D", "A,A": "A", "\t E \n": "E", "FF": "IN", "ABX": "IN", "in": "IN",
}


def test_mcq(spark):
    assert apply(spark, codes.mcq_answer, list(MCQ)) == list(MCQ.values())


def test_mcq_with_other_options(spark):
    values = ["yes", "Y1", "y1 or y2", "1", "a"]
    assert apply(spark, lambda c: codes.mcq_answer(c, ["y1", "y2"]), values) == ["IN", "Y1", "IN", "IN", "IN"]
    assert apply(spark, lambda c: codes.mcq_answer(c, []), ["e"]) == ["E"]
    assert apply(spark, lambda c: codes.mcq_answer(c, F.array(F.lit("f"), F.lit(""))), ["F", "a"]) == ["F", "IN"]


def test_looks_like_mcq(spark):
    table = {None: True, "": True, "unclear": True, "c": True, "it is (B)!": True, "ADA": True, "42": False, "Paris": False, "BAD": True, "12 A5": True, "??": False}
    assert apply(spark, codes.looks_like_mcq, list(table)) == list(table.values())


def test_open(spark):
    table = {None: "BL", " None ": "BL", "Ambiguous": "IN", "  Paris ": "Paris", "0": "0", "bl": "BL"}
    assert apply(spark, codes.open_answer, list(table)) == list(table.values())


def test_drawing(spark):
    table = {
        None: "BL", "dr": "DR", "a Sketch of it": "DR", "graphs": "graphs", "drawing!": "DR", "12": "12", "multiple": "IN", "DRAWN": "DRAWN",
        "see figure 3": "DR",
    }
    assert apply(spark, codes.drawing_answer, list(table)) == list(table.values())


def test_question_key(spark):
    table = {"Q07": "7", "12b3": "12", "  name ": "name", "": None, "   ": None, "000": "0", "Q1.5": "1", None: None, "9" * 25: "9" * 25}
    assert apply(spark, codes.question_key, list(table)) == list(table.values())


def test_stored_answer(spark):
    table = {None: "BL", " ": "BL", "a": "A", "dr": "DR", "Paris ": "Paris", "f": "f", "bl": "BL"}
    assert apply(spark, codes.stored_answer, list(table)) == list(table.values())


@pytest.mark.parametrize(
    ("answer", "correct", "expected"),
    [(None, "A", "BL"), ("BL", "BL", "BL"), ("IN", "IN", "IN"), ("bl", "A", "bl"), ("a", "A", "P"), ("B", "a", "B"), (" A", "A", " A")],
)
def test_mark(spark, answer, correct, expected):
    df = spark.createDataFrame([(answer, correct)], "a string, c string")
    assert df.select(codes.mark(F.col("a"), F.col("c"))).first()[0] == expected


@pytest.mark.parametrize(
    ("response", "expected", "mark"),
    [(None, "x", "BL"), ("  ", "", "BL"), ("A big CIRCLE", "circle", "P"), ("square", "circle", "IM"), ("any", "", "P")],
)
def test_mark_drawing(spark, response, expected, mark):
    df = spark.createDataFrame([(response, expected)], "r string, e string")
    assert df.select(codes.mark_drawing(F.col("r"), F.col("e"))).first()[0] == mark


def test_percentage_equals_python_rounding(spark):
    rows = [(k, n) for n in range(1, 161) for k in range(0, n + 1)]
    df = spark.createDataFrame(rows, "k bigint, n bigint").withColumn("p", codes.percentage(F.col("k"), F.col("n")))
    wrong = [r for r in df.collect() if r.p != round(r.k / r.n * 100, 1)]
    assert wrong == []
    assert spark.createDataFrame([(0, 0)], "k bigint, n bigint").select(codes.percentage(F.col("k"), F.col("n"))).first()[0] == 0.0


def brute_mcq(value, options):
    """The rule in words: tokens standing alone decide first, then single letters anywhere."""
    text = "" if value is None else value.strip().upper()
    if text in codes.BLANK_TOKENS:
        return "BL"
    if text in codes.INVALID_TOKENS:
        return "IN"
    alone = {o for o in options if re.search(f"(?<![A-Z0-9]){o}(?![A-Z0-9])", text)}
    found = alone or {c for c in text if c in options}
    return found.pop() if len(found) == 1 else "IN"


@pytest.mark.parametrize("options", [["A", "B", "C"], ["A", "B1", "12", "YES"]])
def test_mcq_equals_brute_force(spark, options):
    rng = random.Random(len(options))
    values = ["".join(rng.choice("AaBbC1259-/ ,.YESyes") for _ in range(rng.randrange(0, 9))) for _ in range(3000)]
    got = apply(spark, lambda c: codes.mcq_answer(c, options), values)
    assert [(v, g) for v, g in zip(values, got, strict=True) if g != brute_mcq(v, options)] == []
