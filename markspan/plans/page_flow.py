"""From measured pages to answers, calling a model only where it is needed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspan.functions import codes, modeljson
from markspan.operators import infer, layout, marks, normalize
from markspan.session import dimension, written


# Fixed value: the message of a response without an object.
NO_OBJECT = "No valid JSON object found in model response"
# Confidence of a page by how it was read.
CONFIDENCE = {"cv_only": 0.95, "llm_full": 0.9, "failed": 0.0}


class Extraction:
    """`answers` (page, question, answer, method); `records` one row per page with headers, method, confidence, error.

    The focused pass, which only the answers need, runs when they are first asked for."""

    def __init__(self, answers: Callable[[], DataFrame], records: DataFrame):
        self._answers, self.records = answers, records

    @cached_property
    def answers(self) -> DataFrame:
        return self._answers()

    def __iter__(self) -> Iterator[DataFrame]:
        return iter((self.answers, self.records))


def response_answers(responses: DataFrame, id_col: str = "page", drawings: bool = False) -> DataFrame:
    """Raw answers (id, raw_key, raw_value, pos) from the responses that hold a JSON object.

    With `drawings` the questions of the drawing map follow as DR, so that they win over an answer of the same question."""
    objects = responses.select(id_col, modeljson.text_map(modeljson.object_text(F.col("response"))).alias("o"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.coalesce(F.map_entries(modeljson.text_map(F.col("o")["answers"])), none)
    if drawings:
        drawn = F.transform(
            F.map_keys(modeljson.text_map(F.col("o")["drawing_questions"])),
            lambda k: F.struct(k.alias("key"), F.lit(codes.DRAWING).alias("value")),
        )
        entries = F.concat(entries, F.coalesce(drawn, none))
    rows = objects.select(id_col, F.posexplode(entries).alias("pos", "e"))
    return rows.select(id_col, F.col("e.key").alias("raw_key"), F.col("e.value").alias("raw_value"), "pos")


def page_records(measured_pages: DataFrame, full: DataFrame) -> DataFrame:
    """Header fields, method, confidence and error of every page; measured pages have no header fields."""
    objects = full.select("page", "error", modeljson.text_map(modeljson.object_text(F.col("response"))).alias("fields"))
    read = normalize.resolve_headers(objects, "fields")
    failed = F.col("fields").isNull()
    unread = F.coalesce("error", F.lit(NO_OBJECT))
    empty = F.create_map().cast("map<string,string>")
    method = F.when(failed, F.lit("failed")).otherwise(F.lit("llm_full"))
    called = read.select(
        "page", *normalize.READ_ALIASES, F.coalesce(normalize.extra_after_read(F.col("fields")), empty).alias("extra_fields"),
        method.alias("method"), F.when(failed, unread).alias("error"),
    )
    nothing = F.lit(None).cast("string")
    quiet = measured_pages.select(
        "page", *[nothing.alias(c) for c in normalize.READ_ALIASES], empty.alias("extra_fields"), F.lit("cv_only").alias("method"),
        nothing.alias("error"),
    )
    levels = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return quiet.unionByName(called).withColumn("confidence", levels[F.col("method")])


def extract(
    pages: DataFrame,
    cells: DataFrame,
    format_fn: infer.PageFunction,
    full_fn: infer.PageFunction,
    focused_fn: infer.PageFunction,
    concurrency: int | None = None,
    in_flight: int = 1,
    waits=infer.WAITS,
) -> Extraction:
    """Answers and one record per page that is not blank.

    `pages` is (page, layout_hash, quality, is_blank, ...) and should carry image paths, not image bytes, because pages
    are joined to their routes; `cells` holds measured ink. One format call per layout; the full and focused calls only
    for pages whose measured marks are not enough. Every model result is written before it
    is used, so no later branch and no lost executor calls a model again. Formats are joined to the pages once. What has a row
    for each page is joined by sorting: packed files of page numbers look small enough to be broadcast by the driver."""
    valid = pages.filter(~F.coalesce("is_blank", F.lit(False)))
    formats = dimension(infer.detect_formats(valid.select("page", "layout_hash", "quality"), format_fn), "formats")
    placed = layout.attach_formats(valid.select("page", "layout_hash"), formats)
    placed = written(placed.select("page", "layout_hash", "answer_options", "mcq_start", "mcq_end"), "placed")
    sheets = placed.select("page", F.col("layout_hash").alias("format_id"), F.col("answer_options").alias("options"))
    has_mcq = F.col("mcq_start").isNotNull()
    lo, hi = F.least("mcq_start", "mcq_end"), F.greatest("mcq_start", "mcq_end")
    ranges = formats.select(
        "format_id", F.when(has_mcq, hi - lo + 1).alias("mcq_count"), F.col("drawing_start").isNotNull().alias("has_drawing")
    )
    choices = placed.filter(has_mcq).select("page", lo.alias("lo"), hi.alias("hi"), F.col("answer_options").alias("options"))
    inside = marks.marked_options(cells).join(choices.hint("merge"), "page").filter(F.col("question").between(F.col("lo"), F.col("hi")))
    seen = written(marks.option_letters(inside, F.col("options")), "measured")
    needs = marks.needs_model(sheets.select("page", "format_id"), ranges, seen)
    routed = written(needs.select("page", "needs_model", (F.col("mcq_count") > 0).alias("has_mcq")), "routes")

    asked = written(pages.join(routed.filter("needs_model").select("page", "has_mcq").hint("merge"), "page"), "asked")
    full = written(infer.call_pages(asked, full_fn, waits=waits, concurrency=concurrency, in_flight=in_flight), "full-pass")

    def keyed(df: DataFrame) -> DataFrame:
        rows = normalize.keyed_answers(response_answers(df), ["page"], "raw_key", "raw_value", "pos")
        return rows.withColumnRenamed("value", "answer")

    def answers() -> DataFrame:
        focused = infer.call_pages(asked.filter("has_mcq"), focused_fn, attempts=1, waits=(), concurrency=concurrency, in_flight=in_flight)
        focused = written(focused, "focused-pass")
        measured = seen.join(routed.filter(~F.col("needs_model")).select("page").hint("merge"), "page", "left_semi")
        readable = written(full.filter(modeljson.object_text(F.col("response")).isNotNull()).select("page"), "readable").hint("merge")
        seeds = seen.withColumn("question", F.col("question").cast("string")).join(readable, "page", "left_semi")
        merged = marks.merge_sources(keyed(full), keyed(focused).join(readable, "page", "left_semi"), seeds, page_options=placed.select("page", F.col("answer_options").alias("options")).hint("merge"))
        expected = dimension(normalize.expected_questions(normalize.format_ranges(formats)), "expected")
        model_sheets = sheets.join(readable, "page", "left_semi")
        normal = normalize.normalise_answers(merged.withColumnRenamed("answer", "value").hint("merge"), model_sheets, expected, "page")
        return measured.select("page", F.col("question").cast("string").alias("question"), "answer", F.lit("cv_only").alias("method")).unionByName(
            normal.select("page", "question", "answer", F.lit("llm_full").alias("method"))
        )

    return Extraction(answers, page_records(routed.filter(~F.col("needs_model")), full))
