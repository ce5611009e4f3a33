"""The processing log: reading payloads, latest events, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markspan.functions.codes import strip
from markspan.functions.text import dated_path, finite_number, first_text, half_up, json_text
from markspan.operators import ordered

# Action names and their labels.
ACTION_LABELS = {
    "upload": "Uploaded",
    "extract_start": "Extraction started",
    "page_progress": "Progress update",
    "extract_complete": "Extraction complete",
    "extract_error": "Extraction failed",
}
EPOCH = "1970-01-01 00:00:00"

GROUP_LIMIT = 1000  # up to here Spark cuts the rows of a group before it shuffles them
RUN = 65536  # equal errors that are laid out together


def event_order() -> list[Column]:
    """Time, then id; a missing time counts as the oldest."""
    return [F.coalesce("created_at", F.lit(EPOCH).cast("timestamp_ntz")), F.coalesce("id", F.lit(0).cast("bigint"))]


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(strip(c).try_cast("bigint"), F.lit(default).cast("bigint"))


def log_events(df: DataFrame, action: str, status: str, message: Column, extra: Sequence[str], at: Column) -> DataFrame:
    """Rows of the log table built from a table of submissions."""
    payload = F.to_json(F.struct(*extra)) if extra else F.lit(None).cast("string")
    return df.select(
        "submission_id", F.lit(action).alias("action"), F.lit(status).alias("status"), message.alias("message"),
        payload.alias("extra_data"), at.alias("created_at"),
    )


def latest_event(log: DataFrame, action: str | None = None) -> DataFrame:
    """The newest event of each submission."""
    rows = log.filter(F.col("action") == action) if action else log
    picked = [c for c in log.columns if c != "submission_id"]
    newest = rows.groupBy("submission_id").agg(F.max_by(F.struct(*picked), F.struct(*event_order())).alias("e"))
    return newest.select("submission_id", "e.*")


def latest_events(log: DataFrame, limit: int = 10) -> DataFrame:
    """The newest `limit` events of each submission, with their recency from 1. Events without a submission are a group."""
    newest = [c.desc() for c in event_order()]
    if limit > GROUP_LIMIT:
        return ordered.newest_rows_of(log, ["submission_id"], newest, limit, "recency")
    w = Window.partitionBy("submission_id").orderBy(*newest)
    return log.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= limit)


def payload_fields(log: DataFrame) -> DataFrame:
    """Page and candidate label of an event, with their fallbacks, and its counters."""
    p = F.col("extra_data")
    truthy = [F.when(~json_text(p, f).isin("", "0"), json_text(p, f)) for f in ("page", "current")]
    return log.withColumns(
        {
            "page": F.coalesce(*truthy),
            "label": first_text(json_text(p, "label"), json_text(p, "candidate_name")),
            "candidate_count": safe_int(json_text(p, "candidate_count")),
            "answers_count": safe_int(json_text(p, "answers_count")),
            "drawing_count": safe_int(json_text(p, "drawing_count")),
        }
    )


def _whole_number(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def event_message(action: Column, message: Column, payload: Column) -> Column:
    page, current, total = (finite_number(json_text(payload, f)) for f in ("page", "current", "total"))
    who = F.coalesce(strip(first_text(json_text(payload, "label"), json_text(payload, "candidate_name"))), F.lit(""))
    who = F.when(who == "", F.lit("")).otherwise(F.concat(F.lit(" - "), who))
    labels = F.create_map(*[F.lit(x) for pair in ACTION_LABELS.items() for x in pair])
    return (
        F.when((action == "page_progress") & (page != 0), F.concat(F.lit("Processed page "), _whole_number(page), who))
        .when(
            (action == "page_progress") & (current != 0) & (total != 0),
            F.concat(F.lit("Step "), _whole_number(current), F.lit(" of "), _whole_number(total)),
        )
        .otherwise(first_text(message, labels[action], action, F.lit("Log event")))
    )


def progress_state(submissions: DataFrame, log: DataFrame) -> DataFrame:
    """Percent, current page, total and label per submission, from its status and its newest page event.

    `submissions` is (submission_id, status, pages_count, current_page, error_message)."""
    columns = ["submission_id", "id", "action", "message", "extra_data", "created_at"]
    latest = latest_event(log.select(*columns), "page_progress").select("submission_id", "message", "extra_data")
    begun = log.filter(F.col("action").isin("extract_start", "page_progress"))
    started = begun.groupBy("submission_id").agg(F.lit(True).alias("started"))
    joined = submissions.join(latest, "submission_id", "left").join(started, "submission_id", "left")
    read = joined.withColumns(
        {
            "log_progress": finite_number(json_text(F.col("extra_data"), "progress")),
            "log_current": F.coalesce(*[finite_number(json_text(F.col("extra_data"), f)) for f in ("current", "page")]),
            "log_total": finite_number(json_text(F.col("extra_data"), "total")),
            "pages": F.coalesce(F.col("pages_count").cast("double"), F.lit(0.0)),
            "at_page": F.coalesce(F.col("current_page").cast("double"), F.lit(0.0)),
            "log_label": event_message(F.lit("page_progress"), F.col("message"), F.col("extra_data")),
        }
    )
    log_progress, log_current, pages, page = (F.col(c) for c in ("log_progress", "log_current", "pages", "at_page"))
    share = F.when(log_progress <= 1, log_progress * 100).otherwise(log_progress)
    total, current = F.coalesce("log_total", "pages"), F.coalesce("log_current", "at_page")
    failed_share = F.when(log_progress.isNotNull(), share).when((current != 0) & (total != 0), current / total * 100).otherwise(0.0)
    none = F.lit(None).cast("double")
    working = first_text(F.col("log_label"), F.lit("Processing..."))
    is_started = F.coalesce("started", F.lit(False))

    def state(percent: Column, now: Column, of: Column, label: Column) -> Column:
        shown = F.greatest(F.lit(0), F.least(F.lit(100), half_up(percent))).cast("bigint")
        return F.struct(shown.alias("percent"), now.alias("current"), of.alias("total"), label.alias("label"))

    # The percentages and labels shown in each state.
    by_page = F.concat(F.lit("Processing page "), _whole_number(page), F.lit(" of "), _whole_number(pages))
    shown = (
        F.when(F.col("status") == "completed", state(F.lit(100.0), pages, pages, F.lit("Processing complete")))
        .when(
            F.col("status") == "failed",
            state(failed_share, current, total, first_text(F.col("error_message"), F.lit("Processing failed"))),
        )
        .when(F.col("status") == "pending", state(F.lit(5.0), none, pages, F.lit("Queued for processing")))
        .when((pages != 0) & (page != 0), state(page / pages * 100, page, pages, by_page))
        .when(log_progress.isNotNull(), state(share, current, total, working))
        .when((log_current != 0) & (total != 0), state(log_current / total * 100, log_current, total, working))
        .when(is_started, state(F.lit(12.0), none, total, F.lit("Extraction started")))
        .otherwise(state(F.lit(8.0), none, total, F.lit("Preparing extraction...")))
    )
    return read.select("submission_id", "status", shown.alias("s")).select("submission_id", "status", "s.*")


def running_progress(log: DataFrame) -> DataFrame:
    """Share of a submission's page events done at each event, 4 decimals."""
    rows = log.filter(F.col("action") == "page_progress")
    out = ordered.number_rows(rows, ["submission_id"], event_order(), "completed", "total")
    return out.withColumn("progress", F.bround(F.col("completed") / F.greatest(F.col("total"), F.lit(1)), 4))


def page_progress_events(pages: DataFrame) -> DataFrame:
    """The progress event of each page of a run.

    `pages` is (submission_id, page_number, label, answers_count, drawing_count), a page number once per submission."""
    rows = ordered.number_rows(pages, ["submission_id"], [F.col("page_number")], "current", "total")
    share = F.bround(F.col("current") / F.greatest(F.col("total"), F.lit(1)), 4)
    # Fixed value: the message's wording.
    message = F.format_string(
        "Page %d: %d answers, %d drawing (%d/%d)", "page_number", "answers_count", "drawing_count", "current", "total"
    )
    payload = F.struct(
        F.col("page_number").alias("page"), "current", "total", share.alias("progress"), "label", "answers_count", "drawing_count"
    )
    return rows.select(
        "submission_id", F.lit("page_progress").alias("action"), F.lit("info").alias("status"), message.alias("message"),
        F.to_json(payload).alias("extra_data"),
    )


def monotonic_progress(log: DataFrame, value: Column) -> DataFrame:
    """The highest value so far, so that a shown progress never goes back."""
    return ordered.running_max(log, ["submission_id"], event_order(), value, "shown")


def page_changes(log: DataFrame, page: Column) -> DataFrame:
    """Page events with the page before and whether it changed; the first one counts as a change."""
    paged = log.filter(F.col("action") == "page_progress").withColumn("page", page)
    out = ordered.previous_value(paged.filter(F.col("page") != 0), ["submission_id"], event_order(), F.col("page"), "previous_page")
    return out.withColumn("changed", ~F.col("page").eqNullSafe(F.col("previous_page")))


def error_rollup(errors: DataFrame, per_task: int = ordered.ROWS_PER_TASK) -> DataFrame:
    """The messages "Page n: message" of each submission, numbered in page order (no page first, equal pages by message).

    Rows (submission_id, n, error): a list of any length stays spread over tasks. Equal messages are counted before they are
    numbered, and laid out again in runs that are dealt over tasks."""
    page = F.col("page")
    text = F.concat(F.lit("Page "), F.coalesce(page.cast("string"), F.lit("None")), F.lit(": "), F.coalesce("message", F.lit("")))
    rows = errors.groupBy("submission_id", "page", text.alias("error")).agg(F.count(F.lit(1)).alias("times"))
    placed = ordered.running_sum(rows, ["submission_id"], [page, F.col("error")], F.col("times"), "before", per_task)

    def laid_out(runs: DataFrame) -> DataFrame:
        run = F.sequence(F.col("first"), F.least(F.col("first") + RUN - 1, F.col("before") + F.col("times")))
        return runs.select("submission_id", F.explode(run).alias("n"), "error")

    few = placed.filter(F.col("times") <= RUN).withColumn("first", F.col("before") + 1)
    many = placed.filter(F.col("times") > RUN)
    many = many.withColumn("first", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("times"), F.lit(RUN))))
    return laid_out(few).unionByName(laid_out(many.repartition("submission_id", "first")))


def run_folder(ts: Column, context: Column, source: Column) -> Column:
    return F.concat_ws("/", dated_path(ts), context, source, F.date_format(ts, "HHmmss"))
