"""Matching candidates to answer keys, marking and scoring.

Keys are a dimension: `key_long` holds (key_id, question, correct), `drawing_long` holds (key_id, question, expected).
No join is forced to broadcast: Spark broadcasts a side when its measured size allows it and shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.functions import codes
from markspan.operators.ordered import number_rows
from markspan.session import written

ANCHOR = 8  # characters by which containment candidates meet


def type_name(c: Column, null_as_empty: bool = False) -> Column:
    """Normalised paper type; a missing one reads NONE unless the caller wants it empty."""
    return codes.folded(F.coalesce(c, F.lit("" if null_as_empty else "NONE")))


def keys_by_type(keys: DataFrame, order: str = "key_id") -> DataFrame:
    """One row per normalised type: the last key wins and takes the first one's place; empty types are left out."""
    typed = keys.withColumn("paper_type_norm", codes.folded(F.coalesce("paper_type", F.lit(""))))
    return (
        typed.filter(F.col("paper_type_norm") != "")
        .groupBy("paper_type_norm")
        .agg(F.min(order).alias("key_pos"), F.max_by("key_id", order).alias("key_id"))
    )


def exact_matches(candidates: DataFrame, by_type: DataFrame) -> DataFrame:
    typed = candidates.withColumn("paper_type_norm", type_name(F.col("paper_type")))
    return typed.join(by_type, "paper_type_norm")


def _grams(df: DataFrame) -> DataFrame:
    """Each text once per distinct piece of 1 to ANCHOR characters that it holds."""
    size = F.length("paper_type_norm")
    starts = df.filter(size > 0).select("*", F.explode(F.sequence(F.lit(1), size)).alias("__i"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(ANCHOR), size - F.col("__i") + 1))
    cut = starts.select("*", F.explode(lengths).alias("__n"))
    return cut.withColumn("gram", F.substring("paper_type_norm", F.col("__i"), F.col("__n"))).drop("__i", "__n").distinct()


def type_matches(types: DataFrame, by_type: DataFrame) -> DataFrame:
    """The key of each distinct paper type: equal type first, else the first key where one text contains the other.

    Containment is an equality join: the longer text is cut into its pieces of up to ANCHOR characters, and the shorter one
    meets the piece that it begins with; then the whole texts are compared. Work is linear in the length of the texts."""
    keys = by_type.select(F.col("paper_type_norm").alias("key_type"), "key_pos", "key_id")
    types = types.select("paper_type_norm")

    def hits(df: DataFrame, rank: int) -> DataFrame:
        return df.select("paper_type_norm", F.struct(F.lit(rank).alias("rank"), "key_pos", "key_id").alias("hit"))

    equal = types.join(keys, F.col("paper_type_norm") == F.col("key_type"))
    in_type = _grams(types).join(keys, F.col("gram") == F.left("key_type", F.lit(ANCHOR)))
    in_type = in_type.filter(F.contains("paper_type_norm", F.col("key_type")))
    of_keys = _grams(by_type.select("paper_type_norm", "key_pos", "key_id")).withColumnRenamed("paper_type_norm", "key_type")
    in_key = types.join(of_keys, F.left("paper_type_norm", F.lit(ANCHOR)) == F.col("gram")).filter(F.contains("key_type", F.col("paper_type_norm")))
    # Every key contains the empty type, so that the first one fits it.
    first = by_type.agg(F.min(F.struct(F.lit(1).alias("rank"), "key_pos", "key_id")).alias("hit")).scalar()
    empty = types.filter(F.col("paper_type_norm") == "").select("paper_type_norm", first.alias("hit"))
    found = hits(equal, 0).unionByName(hits(in_type, 1)).unionByName(hits(in_key, 1)).unionByName(empty)
    best = types.join(found.groupBy("paper_type_norm").agg(F.min("hit").alias("hit")), "paper_type_norm", "left")
    kind = F.when(F.col("hit.rank") == 0, F.lit("exact")).when(F.col("hit").isNotNull(), F.lit("contains"))
    return best.select("paper_type_norm", F.col("hit.key_id").alias("key_id"), kind.alias("match_kind"))


def match_keys(candidates: DataFrame, keys: DataFrame, null_as_empty: bool = False) -> DataFrame:
    """Candidates with key_id and match_kind, null where no key fits.

    Matching runs once per distinct type. The type table is written out, so that Spark knows its true size: a small one
    is broadcast and the candidates are not shuffled, a large one is joined by shuffling."""
    typed = candidates.withColumn("paper_type_norm", type_name(F.col("paper_type"), null_as_empty))
    matched = written(type_matches(typed.select("paper_type_norm").distinct(), keys_by_type(keys)), "type-keys")
    return typed.join(matched, "paper_type_norm", "left")


def with_inline_key(candidates: DataFrame, key: dict[str, str], value: str = "correct") -> DataFrame:
    """One row per candidate and question of a key given with the request."""
    entries = F.array(*[F.struct(F.lit(str(q)).alias("question"), F.lit(v).alias(value)) for q, v in key.items()])
    return candidates.select("*", F.inline(entries))


def mark_answers(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Marks for rows of (candidate_id, question, correct); every asked question appears once."""
    joined = asked.join(answers.select("candidate_id", "question", "answer"), ["candidate_id", "question"], "left")
    return joined.withColumn("mark", codes.mark(F.col("answer"), F.col("correct")))


def mark_drawings(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """Marks for rows of (candidate_id, question, expected)."""
    joined = asked.join(responses.select("candidate_id", "question", "response"), ["candidate_id", "question"], "left")
    return joined.withColumn("mark", codes.mark_drawing(F.col("response"), F.col("expected")))


def key_sizes(key_long: DataFrame, drawing_long: DataFrame | None = None) -> DataFrame:
    rows = key_long.select("key_id")
    if drawing_long is not None:
        rows = rows.unionByName(drawing_long.select("key_id"))
    return rows.groupBy("key_id").agg(F.count(F.lit(1)).alias("total"))


def scores(
    sheets: DataFrame,
    key_long: DataFrame,
    answers: DataFrame,
    drawing_long: DataFrame | None = None,
    responses: DataFrame | None = None,
) -> DataFrame:
    """Add correct, total and percentage to sheets (candidate_id, key_id, ...); null where there is no key.

    Answers no key asks about are dropped first, so a sheet keeps at most one row per key question. Sheets and answers
    are then shuffled once, on candidate_id, and the counting reuses that partitioning."""

    def rows(df: DataFrame, ids: Sequence[str], value: str, name: str, drawn: bool) -> DataFrame:
        return df.select(*ids, "question", F.col(value).alias(name), F.lit(drawn).alias("drawn"))

    key = rows(key_long, ["key_id"], "correct", "wanted", False)
    given = rows(answers, ["candidate_id"], "answer", "given", False)
    if drawing_long is not None and responses is not None:
        key = key.unionByName(rows(drawing_long, ["key_id"], "expected", "wanted", True))
        given = given.unionByName(rows(responses, ["candidate_id"], "response", "given", True))
    given = given.join(key.select("question", "drawn").distinct(), ["question", "drawn"], "left_semi")
    met = sheets.join(given, "candidate_id", "left").join(key, ["key_id", "question", "drawn"], "left")
    wanted, text = F.col("wanted"), F.col("given")
    mark = F.when(F.col("drawn"), codes.mark_drawing(text, wanted)).otherwise(codes.mark(text, wanted))
    hit = wanted.isNotNull() & (mark == codes.CORRECT)
    kept = [c for c in sheets.columns if c != "candidate_id"]
    counted = met.groupBy("candidate_id", *kept).agg(F.count_if(hit).alias("correct"))
    sized = counted.join(key_sizes(key_long, drawing_long), "key_id", "left")
    has_key = F.col("key_id").isNotNull()
    total = F.when(has_key, F.coalesce("total", F.lit(0).cast("bigint")))
    return (
        sized.withColumn("total", total)
        .withColumn("correct", F.when(has_key, F.col("correct")))
        .withColumn("percentage", F.when(has_key, codes.percentage(F.col("correct"), F.col("total"))))
        .select("candidate_id", *kept, "correct", "total", "percentage")
    )


# --- whole results: maps and score of each sheet -----------------------------------------------------------------


def _ordered(question: Column, *rest: Column) -> Column:
    """A struct that sorts numbers first in number order, then other keys as text; `q` holds the question as text."""
    kind, number, text = codes.order_columns(question.cast("string"))
    return F.struct(kind.alias("kind"), number.alias("number"), text.alias("q"), *rest)


def key_lists(key_long: DataFrame, drawing_long: DataFrame | None = None) -> DataFrame:
    """One row per key: its questions and its drawing questions in order, as arrays of (kind, number, q, wanted)."""

    def rows(df: DataFrame, value: str, drawn: bool) -> DataFrame:
        return df.select("key_id", _ordered(F.col("question"), F.col(value).alias("wanted")).alias("e"), F.lit(drawn).alias("drawn"))

    both = rows(key_long, "correct", False)
    if drawing_long is not None:
        both = both.unionByName(rows(drawing_long, "expected", True))
    listed = {name: F.array_sort(F.collect_list(F.when(F.col("drawn") == drawn, F.col("e")))) for name, drawn in (("asked", False), ("asked_drawing", True))}
    return both.groupBy("key_id").agg(*[c.alias(name) for name, c in listed.items()])


def sheet_maps(answers: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """One row per candidate with ordered maps of its answers and drawing responses, questions as text and unique per sheet.

    One shuffle, on candidate_id; null answers stay entries."""

    def rows(df: DataFrame, value: str, drawn: bool) -> DataFrame:
        return df.select("candidate_id", _ordered(F.col("question"), F.col(value).alias("v")).alias("e"), F.lit(drawn).alias("drawn"))

    both = rows(answers, "answer", False)
    if responses is not None:
        both = both.unionByName(rows(responses, "response", True))

    def told(drawn: bool) -> Column:
        entries = F.array_sort(F.collect_list(F.when(F.col("drawn") == drawn, F.col("e"))))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["q"], e["v"])))

    return both.groupBy("candidate_id").agg(told(False).alias("answers"), told(True).alias("drawings"))


def marked_maps(sheets: DataFrame, lists: DataFrame) -> DataFrame:
    """Add marked_answers, marked_drawing, correct, total and percentage to sheets (candidate_id, key_id, answers, drawings, ...).

    Nothing is shuffled but the keys' lists, if they are not small. Without a key all are null; marked_drawing is null, too,
    where the key has no drawing questions. Every question of the key is marked, an unanswered one BL."""
    joined = sheets.join(lists, "key_id", "left")
    has_key = F.col("key_id").isNotNull()

    def marks(items: str, given: str, rule: Callable[[Column, Column], Column]) -> Column:
        return F.map_from_entries(F.transform(items, lambda e: F.struct(e["q"].alias("q"), rule(F.col(given)[e["q"]], e["wanted"]).alias("mark"))))

    nothing = F.array().cast(lists.schema["asked"].dataType)
    told = joined.withColumn("asked", F.coalesce("asked", nothing)).withColumn("asked_drawing", F.coalesce("asked_drawing", nothing))
    told = told.withColumn("marked_answers", F.when(has_key, marks("asked", "answers", codes.mark)))
    told = told.withColumn("marked_drawing", F.when(has_key & (F.size("asked_drawing") > 0), marks("asked_drawing", "drawings", codes.mark_drawing)))

    def hits(m: str) -> Column:
        return F.coalesce(F.size(F.filter(F.map_values(m), lambda v: v == codes.CORRECT)), F.lit(0))

    drawn = F.when(F.col("marked_drawing").isNotNull(), hits("marked_drawing")).otherwise(0)
    told = told.withColumn("correct", F.when(has_key, (hits("marked_answers") + drawn).cast("bigint")))
    told = told.withColumn("total", F.when(has_key, (F.size("asked") + F.size("asked_drawing")).cast("bigint")))
    told = told.withColumn("percentage", F.when(has_key, codes.percentage(F.col("correct"), F.col("total"))))
    return told.drop("asked", "asked_drawing")


def asked_only(rows: DataFrame, key: DataFrame) -> DataFrame:
    """Rows whose question some key asks for."""
    return rows.join(key.select(F.col("question").alias("__q")).distinct(), F.col("question") == F.col("__q"), "left_semi")


def marked_sheets(
    sheets: DataFrame, key_long: DataFrame, answers: DataFrame, drawing_long: DataFrame | None = None, responses: DataFrame | None = None
) -> DataFrame:
    """Sheets (candidate_id, key_id, ...) with marked_answers and marked_drawing, maps in question order, and their score.

    Answers no key asks about are dropped before the one shuffle of sheets and answers on candidate_id."""
    given = sheet_maps(asked_only(answers, key_long), asked_only(responses, drawing_long) if drawing_long is not None and responses is not None else None)
    lists = key_lists(key_long, drawing_long if responses is not None else None)
    return marked_maps(sheets.join(given, "candidate_id", "left"), lists).drop("answers", "drawings")


def scores_from_marks(marks: DataFrame) -> DataFrame:
    """The same score from long mark rows (answers and drawings unioned)."""
    return (
        marks.groupBy("candidate_id")
        .agg(F.count_if(F.col("mark") == codes.CORRECT).alias("correct"), F.count(F.lit(1)).alias("total"))
        .withColumn("percentage", codes.percentage(F.col("correct"), F.col("total")))
    )


RESULTS = ("candidate_name", "candidate_number", "marked_answers", "marked_drawing", "correct", "total", "percentage")


def marking_report(
    sheets: DataFrame, keys: DataFrame, key_long: DataFrame, answers: DataFrame, drawing_long: DataFrame | None = None, responses: DataFrame | None = None
) -> DataFrame:
    """The results of each submission in candidate order, every candidate once: rows (submission_id, total_candidates, n,
    candidate_id, candidate_name, candidate_number, marked_answers, marked_drawing, correct, total, percentage).

    Missing names and numbers are empty. Candidates without a fitting key stay, with empty marks and score. Sheets are numbered
    before they are marked."""
    numbered = number_rows(sheets, ["submission_id"], [F.col("candidate_id")], "n", "total_candidates")
    marked = marked_sheets(match_keys(numbered, keys), key_long, answers, drawing_long, responses)
    named = {c: F.coalesce(c, F.lit("")) for c in ("candidate_name", "candidate_number")}
    return marked.withColumns(named).select("submission_id", "total_candidates", "n", "candidate_id", *RESULTS)


def marked_candidates(
    candidates: DataFrame,
    keys: DataFrame,
    key_long: DataFrame,
    answers: DataFrame,
    drawing_long: DataFrame | None = None,
    responses: DataFrame | None = None,
) -> DataFrame:
    """Auto-matched marking end to end: every candidate once, score null when no key fits its paper type."""
    return scores(match_keys(candidates, keys), key_long, answers, drawing_long, responses)
