"""Marked options from measured ink, routing to a model, and merging of answer sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markspan.functions import codes

# The marking thresholds.
INK_SHARE, LOWER_SHARE = 0.65, 0.35
MIN_SCORE, MIN_SEPARATION = 0.075, 1.20
ENOUGH_ANSWERS = 0.8


def marked_options(cells: DataFrame) -> DataFrame:
    """Per (page, question) the chosen option, null when no mark is dark enough or clearly darkest.

    Only the two darkest options matter, and Spark keeps just those before the shuffle."""
    score = F.col("ink_ratio") * INK_SHARE + F.col("lower_ink") * LOWER_SHARE
    w = Window.partitionBy("page", "question").orderBy(F.col("score").desc(), "opt")
    top = cells.select("page", "question", "opt", score.alias("score")).withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    ranked = top.groupBy("page", "question").agg(
        F.max(F.when(F.col("rn") == 1, F.col("opt"))).alias("opt"),
        F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("best"),
        F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("score"))), F.lit(0.0)).alias("second"),
    )
    separation = F.col("best") / F.greatest(F.col("second"), F.lit(1e-6))
    clear = (F.col("best") >= MIN_SCORE) & (separation >= MIN_SEPARATION)
    return ranked.select("page", "question", F.when(clear, F.col("opt")).alias("opt"), "best", "second")


def option_letters(chosen: DataFrame, options: codes.Options = None) -> DataFrame:
    """Turn the 1-based option position into its letter; positions past the last option read as the last."""
    letters = codes.option_array(options)
    at = F.least(F.col("opt"), F.size(letters).cast("bigint")).cast("int")
    return chosen.filter(F.col("opt").isNotNull()).select("page", "question", F.element_at(letters, at).alias("answer"))


def unclear_questions(pages: DataFrame, mcq: DataFrame, answered: DataFrame) -> DataFrame:
    """Questions of each page's choice range without a measured answer.

    `pages` is (page, format_id), `mcq` is (format_id, start, end)."""
    asked = pages.join(mcq, "format_id").select("page", F.explode(F.sequence("start", "end")).alias("question"))
    return asked.join(answered.select("page", "question"), ["page", "question"], "left_anti")


def needs_model(pages: DataFrame, ranges: DataFrame, answered: DataFrame) -> DataFrame:
    """Per page whether measured answers are too few to do without the model.

    `ranges` is one row per format: (format_id, mcq_count, has_drawing); a number range alone never needs the model. The counts, a
    row for each page, are joined by sorting."""
    counts = answered.groupBy("page").agg(F.count(F.lit(1)).alias("measured")).hint("merge")
    joined = pages.join(counts, "page", "left").join(ranges, "format_id", "left")
    measured = F.coalesce("measured", F.lit(0).cast("bigint"))
    asked = F.coalesce("mcq_count", F.lit(0).cast("bigint"))
    rule = (measured == 0) | ((asked > 0) & (measured < asked * ENOUGH_ANSWERS)) | F.coalesce("has_drawing", F.lit(False))
    return joined.select("page", "format_id", measured.alias("measured"), asked.alias("mcq_count"), rule.alias("needs_model"))


def merge_sources(
    full: DataFrame, focused: DataFrame, measured: DataFrame, options: codes.Options = None, page_options: DataFrame | None = None
) -> DataFrame:
    """One answer per (page, question): a measured option, else the focused pass, else the full pass.

    A focused BL only replaces a full BL. `page_options` is (page, options array<string>): what counts as an option on each
    page; pages without take `options`. All three sources meet in one aggregation."""
    def side(df: DataFrame, source: str) -> DataFrame:
        return df.select("page", "question", "answer", F.lit(source).alias("source"))

    rows = side(full, "full").unionByName(side(focused, "focused")).unionByName(side(measured, "measured"))
    by = {s: F.max(F.when(F.col("source") == s, F.col("answer"))).alias(s) for s in ("full", "focused", "measured")}
    wide = rows.groupBy("page", "question").agg(*by.values())
    known = codes.option_array(options)
    if page_options is not None:
        own = page_options.select("page", codes.option_array(F.col("options")).alias("__options"))
        wide, known = wide.join(own, "page", "left"), F.coalesce(F.col("__options"), known)
    seen = F.array_contains(known, codes.folded(F.col("measured"))).eqNullSafe(True)
    take_focused = F.col("focused").isNotNull() & ((F.col("focused") != codes.BLANK) | (F.col("full") == codes.BLANK))
    answer = F.when(seen, codes.folded(F.col("measured"))).when(take_focused, F.col("focused")).otherwise(F.col("full"))
    return wide.select("page", "question", answer.alias("answer")).filter(F.col("answer").isNotNull())
