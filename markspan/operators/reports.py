"""Counts, validation and documents over candidates and their answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.functions import codes
from markspan.functions.modeljson import text_map
from markspan.functions.text import half_up, label_from_key, preview
from markspan.operators.events import latest_event, payload_fields
from markspan.operators.ordered import ROWS_PER_TASK, number_rows

def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _per_candidate(answers: DataFrame, drawings: DataFrame | None) -> DataFrame:
    """Answer, DR and drawing counts per candidate in one aggregation."""
    is_dr = (F.upper(codes.strip(F.col("answer"))) == codes.DRAWING).cast("int")
    rows = answers.select("candidate_id", F.lit(1).alias("a"), F.coalesce(is_dr, F.lit(0)).alias("dr"), F.lit(0).alias("d"))
    if drawings is not None:
        rows = rows.unionByName(drawings.select("candidate_id", F.lit(0).alias("a"), F.lit(0).alias("dr"), F.lit(1).alias("d")))
    return rows.groupBy("candidate_id").agg(
        F.sum("a").alias("answers"), F.sum("dr").alias("dr_answers"), F.sum("d").alias("drawings")
    )


def candidate_counts(candidates: DataFrame, answers: DataFrame, drawings: DataFrame | None = None) -> DataFrame:
    joined = candidates.select("candidate_id", "submission_id").join(_per_candidate(answers, drawings), "candidate_id", "left")
    return joined.na.fill(0, ["answers", "dr_answers", "drawings"])


def submission_counts(counts: DataFrame) -> DataFrame:
    """The three drawing counts keep their own names: list view, status view and run summary differ."""
    status_drawings = F.when(F.col("drawings") > 0, F.col("drawings")).otherwise(F.col("dr_answers"))
    return counts.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("candidates_count"),
        F.sum("answers").alias("answers_count"),
        F.sum("drawings").alias("listed_drawings"),
        F.sum(status_drawings).alias("status_drawings"),
        F.sum("dr_answers").alias("dr_answers"),
        F.count_if(F.col("answers") > 0).alias("pages_with_data"),
    )


def submission_summary(submissions: DataFrame, counts: DataFrame) -> DataFrame:
    """Every submission with its counts, zero where it has no candidates."""
    joined = submissions.join(submission_counts(counts), "submission_id", "left")
    names = ["candidates_count", "answers_count", "listed_drawings", "status_drawings", "dr_answers", "pages_with_data"]
    return joined.na.fill(0, names)


def status_counters(submissions: DataFrame, log: DataFrame, counts: DataFrame) -> DataFrame:
    """Counters from the newest completion event; recomputed for completed submissions without them."""
    done = payload_fields(latest_event(log, "extract_complete")).select(
        "submission_id", "candidate_count", "answers_count", "drawing_count"
    )
    own = submission_counts(counts).select(
        "submission_id", "candidates_count", F.col("answers_count").alias("own_answers"), "status_drawings"
    )
    joined = submissions.join(done, "submission_id", "left").join(own, "submission_id", "left")
    logged = F.coalesce("candidate_count", _zero())
    recount = (F.col("status") == "completed") & (logged == 0)

    def pick(stored: str, counted: str) -> Column:
        return F.when(recount, F.coalesce(counted, _zero())).otherwise(F.coalesce(stored, _zero()))

    return joined.select(
        "submission_id",
        "status",
        pick("candidate_count", "candidates_count").alias("candidates_count"),
        pick("answers_count", "own_answers").alias("answers_count"),
        pick("drawing_count", "status_drawings").alias("drawing_count"),
    )


def submission_status(submissions: DataFrame, log: DataFrame, counts: DataFrame) -> DataFrame:
    """The status view: file, counters, and the page and candidate of the newest page event."""
    at = payload_fields(latest_event(log, "page_progress")).select(
        "submission_id", F.col("page").alias("current_page"), F.col("label").alias("current_candidate")
    )
    counters = status_counters(submissions.select("submission_id", "status"), log, counts)
    return submissions.drop("status").join(counters, "submission_id").join(at, "submission_id", "left")


def completion_events(submissions: DataFrame, counts: DataFrame, seconds: dict[str, Column]) -> DataFrame:
    """The summary event of each submission, as a log row payload; `seconds` names the durations, total_seconds among them."""
    joined = submission_summary(submissions, counts)
    payload = F.struct(
        F.col("candidates_count").alias("candidate_count"),
        "answers_count",
        F.col("dr_answers").alias("drawing_count"),
        F.col("pages_count").alias("pages_processed"),
        "pages_with_data",
        *[F.bround(c, 2).alias(name) for name, c in seconds.items()],
    )
    # Fixed value: the message's wording.
    message = F.concat(
        F.lit("Extracted "), F.col("candidates_count").cast("string"), F.lit(" candidates in "), F.format_string("%.1fs", seconds["total_seconds"])
    )
    return joined.select(
        "submission_id", F.lit("extract_complete").alias("action"), F.lit("success").alias("status"),
        message.alias("message"), F.to_json(payload).alias("extra_data"),
    )


def answer_distribution(answers: DataFrame) -> DataFrame:
    return answers.groupBy("answer").agg(F.count(F.lit(1)).alias("n"))


def extraction_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.count(F.lit(1)).alias("total_candidates"),
        F.coalesce(F.sum("answers"), _zero()).alias("total_answers"),
        F.coalesce(F.sum("drawings"), _zero()).alias("total_drawing_questions"),
    )


def average_answers(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Answers per candidate, rounded half up; 0 without candidates."""
    mean = F.sum("answers") / F.count(F.lit(1))
    return counts.groupBy(*by).agg(F.coalesce(half_up(mean), _zero()).cast("bigint").alias("avg_answers"))


def quality_gauge(answers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Blank and invalid counts: many of them point to a bad scan."""
    return answers.groupBy(*by).agg(
        F.count_if(F.col("answer") == codes.BLANK).alias("blank"),
        F.count_if(F.col("answer") == codes.INVALID).alias("invalid"),
        F.count(F.lit(1)).alias("total"),
    )


# --- validation ------------------------------------------------------------------------------------------------


def _warning(page: str, answer: Column, question: str) -> Column:
    # Fixed value: the warning's wording.
    return F.concat(
        F.lit("Page "), F.col(page).cast("string"), F.lit(": Unexpected answer '"), F.coalesce(answer, F.lit("None")),
        F.lit("' for Q"), F.col(question).cast("string"),
    )


def strict_warnings(answers: DataFrame, options: Sequence[str] = codes.DEFAULT_OPTIONS, value: str = "answer", page: str = "page_number") -> DataFrame:
    """Answers that are neither an option nor BL or IN."""
    valid = F.coalesce(F.col(value).isin(*options, codes.BLANK, codes.INVALID), F.lit(False))
    return answers.filter(~valid).withColumn("warning", _warning(page, F.col(value), "question"))


def tolerant_warnings(answers: DataFrame, value: str = "answer", page: str = "page_number") -> DataFrame:
    """Only null or blank answers; any text may be a written response."""
    empty = F.coalesce(codes.strip(F.col(value)), F.lit("")) == ""
    return answers.filter(empty).withColumn("warning", _warning(page, F.col(value), "question"))


def validation_summary(counts: DataFrame, warnings: DataFrame) -> DataFrame:
    """Totals per submission and whether it is free of warnings."""
    bad = warnings.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("warnings"))
    joined = counts.join(bad, "candidate_id", "left")
    out = joined.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("total_candidates"),
        F.sum("answers").alias("total_answers"),
        F.sum("drawings").alias("total_drawing_questions"),
        F.coalesce(F.sum("warnings"), _zero()).alias("warnings"),
    )
    return out.withColumn("is_valid", F.col("warnings") == 0)


# --- recognition confidence ------------------------------------------------------------------------------------


def page_confidence(tokens: DataFrame) -> DataFrame:
    """Per page both averages: over scores above 0 with the word count, and over scores from 0 with the sample count."""
    conf = F.col("conf")
    positive, valid = conf > 0, conf >= 0
    return tokens.groupBy("doc_id", "page").agg(
        F.coalesce(F.sum(F.when(positive, conf)) / F.nullif(F.count_if(positive), F.lit(0)), F.lit(0.0)).alias("word_confidence"),
        F.count_if(positive).alias("word_count"),
        F.coalesce(F.bround(F.sum(F.when(valid, conf)) / F.nullif(F.count_if(valid), F.lit(0)), 2), F.lit(0.0)).alias("average_confidence"),
        F.count_if(valid).alias("confidence_samples"),
    )


def run_summary(page_stats: DataFrame) -> DataFrame:
    """Per document: pages, pages that were read, and the mean of the page averages above 0.

    Averages are summed as whole hundredths, so the result does not depend on summing order."""
    hundredths = F.bround(F.col("average_confidence") * 100, 0).cast("bigint")
    some = F.col("average_confidence") > 0
    mean = F.sum(F.when(some, hundredths)) / F.nullif(F.count_if(some), F.lit(0)) / 100
    return page_stats.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages_total"),
        F.count_if(F.col("status") == "ok").alias("pages_ok"),
        F.coalesce(F.bround(mean, 2), F.lit(0.0)).alias("average_confidence"),
    )


# --- documents -------------------------------------------------------------------------------------------------


def report_text(sheets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A readable report per candidate, the whole sheet in one row; nothing is shuffled.

    `sheets` holds candidate_id, page_number, `columns`, ordered maps (answers, drawings, marked_answers; null or empty where
    there are none) and the score (correct, total, percentage; null without a key)."""
    # The headings of the report.
    def block(m: str, title: Column, value: Callable[[Column], Column] = lambda v: v) -> Column:
        lines = F.transform(F.map_entries(m), lambda e: F.concat(F.lit("    Q"), e["key"], F.lit(": "), value(e["value"])))
        return F.when(F.size(m) > 0, F.concat(F.array(title), lines)).otherwise(F.array().cast("array<string>"))

    def counted(name: str, m: str) -> Column:
        return F.concat(F.lit(f"  {name} ("), F.size(m).cast("string"), F.lit("):"))

    head = [
        F.concat(F.lit("  "), label_from_key(F.lit(c)), F.lit(": "), F.coalesce(F.col(c).cast("string"), F.lit("None")))
        for c in columns
    ]
    number = F.concat(F.lit("--- Candidate "), F.col("page_number").cast("string"), F.lit(" ---"))
    score = F.when(
        F.col("total").isNotNull(),
        F.array(F.concat(F.lit("  Score: "), F.concat_ws("/", "correct", "total"), F.lit(" ("), F.col("percentage").cast("string"), F.lit("%)"))),
    ).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(number, *head),
        block("answers", counted("Answers", "answers")),
        block("drawings", counted("Drawing Questions", "drawings"), preview),
        block("marked_answers", F.lit("  Marked Answers:")),
        score,
    )
    return sheets.select("candidate_id", F.array_join(lines, "\n").alias("report"))


def report_heads(submissions: DataFrame, counts: DataFrame, timestamp: str) -> DataFrame:
    """The opening lines of each file's report."""
    totals = submission_summary(submissions, counts)
    # The opening lines.
    lines = [
        F.concat(F.lit("=== Exam Answer Sheet: "), F.coalesce("filename", F.lit("Unknown")), F.lit(" ===")),
        F.lit(f"Extracted at: {timestamp}"),
        F.concat(F.lit("Total candidates: "), F.col("candidates_count").cast("string")),
    ]
    return totals.select("submission_id", F.concat_ws("\n", *lines).alias("head"))


def _json(c: Column) -> Column:
    """A value as JSON text; null is written out."""
    text = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _members(*pairs: tuple[str, Column]) -> Column:
    """Members of a JSON object; a null column leaves its member out."""
    return F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), text) for name, text in pairs])


# The parts of a document, in order.
HEAD, CANDIDATES, VALIDATION, WARNINGS, TOTALS, ERRORS, END = range(7)
HEADERS = ("candidate_name", "candidate_number", "country")


def candidate_object(extra: str = "extra_fields") -> Column:
    """A candidate as JSON: header fields, answers, drawings where there are some, a paper type unless it is empty, then overflow
    fields; one of them with a header field's name takes its place."""
    over = F.coalesce(F.col(extra), F.create_map().cast("map<string,string>"))
    has_type = (F.coalesce("paper_type", F.lit("")) != "") | F.map_contains_key(over, F.lit("paper_type"))

    def field(name: str) -> Column:
        return F.when(F.map_contains_key(over, F.lit(name)), _json(over[name])).otherwise(_json(F.col(name)))

    def mapped(name: str, keep_empty: bool) -> Column:
        text = F.to_json(F.coalesce(name, F.create_map().cast("map<string,string>")), {"ignoreNullFields": "false"})
        return text if keep_empty else F.when(F.size(name) > 0, text)

    fixed = [(c, field(c)) for c in HEADERS] + [("answers", mapped("answers", True)), ("drawing_questions", mapped("drawings", False)), ("paper_type", F.when(has_type, field("paper_type")))]
    names = [c for c, _ in fixed]
    further = F.filter(F.map_entries(over), lambda e: ~e["key"].isin(*names))
    texts = F.transform(further, lambda e: F.concat(_json(e["key"]), F.lit(":"), _json(e["value"])))
    return F.concat(F.lit("{"), F.concat_ws(",", _members(*fixed), texts), F.lit("}"))


def envelopes(
    submissions: DataFrame, candidates: DataFrame, counts: DataFrame, warnings: DataFrame, errors: DataFrame, timestamp: str, per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """One JSON document per source file, as ordered rows (submission_id, section, n, line) whose lines, one after another, are the
    document: its information, the candidates in page order, the validation with its warnings, the extraction errors if there are any.

    `submissions` holds submission_id, filename, pages_count, processing_time and detected_format (JSON text or null); `candidates`
    unique page numbers from 1, header fields, answers, drawings and extra_fields; `warnings` (submission_id, page_number, question,
    warning); `errors` (submission_id, n, error) as of `error_rollup`. A line is as long as one candidate, so that a file of any size
    stays spread."""
    totals = submission_counts(counts).select("submission_id", "candidates_count", "answers_count", "listed_drawings", "pages_with_data")
    bad = warnings.groupBy("submission_id").agg(F.count(F.lit(1)).alias("bad"))
    failed = errors.select("submission_id").distinct().withColumn("failed", F.lit(True))
    files = submissions.join(totals, "submission_id", "left").join(bad, "submission_id", "left").join(failed, "submission_id", "left")
    numbers = {c: F.coalesce(c, _zero()) for c in ("candidates_count", "answers_count", "listed_drawings", "pages_with_data", "bad")}
    # The member names of a document.
    info = _members(
        ("filename", _json(F.col("filename"))), ("extraction_timestamp", _json(F.lit(timestamp))), ("total_candidates", numbers["candidates_count"].cast("string")),
        ("pages_processed", _json(F.col("pages_count"))), ("pages_with_data", numbers["pages_with_data"].cast("string")),
        ("processing_time", _json(F.coalesce(F.col("processing_time").cast("double"), F.lit(0.0)))), ("detected_format", F.col("detected_format")),
    )
    valid = F.when(numbers["bad"] == 0, F.lit("true")).otherwise(F.lit("false"))
    sums = _members(
        ("total_candidates", numbers["candidates_count"].cast("string")), ("total_answers", numbers["answers_count"].cast("string")),
        ("total_drawing_questions", numbers["listed_drawings"].cast("string")),
    )
    some_failed = F.coalesce("failed", F.lit(False))
    fixed = {
        HEAD: F.concat(F.lit('{"document_information":{'), info, F.lit('},"candidates":[')),
        VALIDATION: F.concat(F.lit('],"logs":{"validation":{"is_valid":'), valid, F.lit(',"warnings":[')),
        TOTALS: F.concat(F.lit("],"), sums, F.lit("}"), F.when(some_failed, F.lit(',"extraction_errors":[')).otherwise(F.lit(""))),
        END: F.when(some_failed, F.lit("]}}")).otherwise(F.lit("}}")),
    }
    frames = F.array(*[F.struct(F.lit(k).alias("section"), _zero().alias("n"), line.alias("line")) for k, line in fixed.items()])
    lines = files.select("submission_id", F.inline(frames))

    def listed(df: DataFrame, section: int, n: str, text: Column) -> DataFrame:
        comma = F.when(F.col(n) > 1, F.lit(",")).otherwise(F.lit(""))
        return df.select("submission_id", F.lit(section).alias("section"), F.col(n).cast("bigint").alias("n"), F.concat(comma, text).alias("line"))

    kind, number, text = codes.order_columns(F.col("question").cast("string"))
    placed = number_rows(warnings, ["submission_id"], [F.col("page_number"), kind, number, text], "n", rows=per_task)
    parts = [
        listed(candidates, CANDIDATES, "page_number", candidate_object()),
        listed(placed, WARNINGS, "n", _json(F.col("warning"))),
        listed(errors, ERRORS, "n", _json(F.col("error"))),
    ]
    return reduce(DataFrame.unionByName, parts, lines)


def key_rows(df: DataFrame, answers: str = "answers_json", drawing: str = "drawing_json") -> DataFrame:
    """Stored answer-key rows from posted JSON maps, with their size; of a repeated name the last value counts, once."""
    maps = df.withColumn("answers", text_map(F.col(answers))).withColumn("drawing_key", text_map(F.col(drawing)))
    return maps.drop(answers, drawing).withColumn("total_questions", key_size(F.col("answers"), F.col("drawing_key")))


def key_size(answers: Column, drawing: Column) -> Column:
    def size(m: Column) -> Column:
        return F.when(m.isNotNull(), F.size(m)).otherwise(0)

    return (size(answers) + size(drawing)).cast("bigint")
