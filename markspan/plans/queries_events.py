"""Queries over the processing log."""

from __future__ import annotations

from pyspark.sql import functions as F

from markspan.functions.text import finite_number, json_text
from markspan.operators import events
from markspan.plans.registry import half_even_sql, query

NUM = "TRY_CAST(json_extract_string(extra_data, '$.{f}') AS DOUBLE)"
PAGE = f"coalesce({NUM.format(f='page')}, {NUM.format(f='current')})"


def page_number():
    p = F.col("extra_data")
    return F.coalesce(finite_number(json_text(p, "page")), finite_number(json_text(p, "current")))


@query(
    "w3_latest_progress_event",
    """SELECT submission_id, id, message, extra_data, created_at FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY created_at DESC, id DESC) AS rn
  FROM v_log WHERE action = 'page_progress') WHERE rn = 1""",
)
def _(i):
    return events.latest_event(i.log, "page_progress").select("submission_id", "id", "message", "extra_data", "created_at")


@query(
    "w4_latest_ten_events",
    """SELECT submission_id, id, action, recency FROM (SELECT *, CAST(row_number() OVER (PARTITION BY submission_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS recency FROM v_log) WHERE recency <= 10""",
)
def _(i):
    return events.latest_events(i.log, 10).select("submission_id", "id", "action", "recency")


@query(
    "w5_running_progress",
    f"""WITH n AS (SELECT submission_id, id, row_number() OVER (PARTITION BY submission_id ORDER BY created_at, id) AS completed, count(*) OVER (PARTITION BY submission_id) AS total
    FROM v_log WHERE action = 'page_progress') SELECT *, {half_even_sql('completed', 'total', 4)} AS progress FROM n""",
)
def _(i):
    return events.running_progress(i.log).select("submission_id", "id", "completed", "total", "progress")


@query(
    "w6_monotonic_progress",
    f"""SELECT submission_id, id, max({NUM.format(f='progress')}) OVER (PARTITION BY submission_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS shown FROM v_log""",
)
def _(i):
    return events.monotonic_progress(i.log, finite_number(json_text(F.col("extra_data"), "progress"))).select("submission_id", "id", "shown")


@query(
    "w7_page_changes",
    f"""WITH p AS (SELECT submission_id, id, created_at, {PAGE} AS page FROM v_log WHERE action = 'page_progress'),
  l AS (SELECT *, lag(page) OVER (PARTITION BY submission_id ORDER BY created_at, id) AS previous_page FROM p WHERE page IS NOT NULL AND page <> 0)
  SELECT submission_id, id, page, previous_page, page IS DISTINCT FROM previous_page AS changed FROM l""",
)
def _(i):
    return events.page_changes(i.log, page_number()).select("submission_id", "id", "page", "previous_page", "changed")


@query(
    "a18_error_rollup",
    """WITH e AS (SELECT nullif(submission_id, submission_id - submission_id % 7) AS submission_id, CASE WHEN id % 11 <> 0 THEN id END AS page, message FROM v_log WHERE action = 'extract_error')
  SELECT submission_id, row_number() OVER (PARTITION BY submission_id ORDER BY page NULLS FIRST, message) AS n,
    'Page ' || coalesce(CAST(page AS VARCHAR), 'None') || ': ' || message AS error FROM e""",
)
def _(i):
    # Some errors have no submission or no page.
    page = F.when(F.col("id") % 11 != 0, F.col("id")).alias("page")
    owner = F.when(F.col("submission_id") % 7 != 0, F.col("submission_id")).alias("submission_id")
    return events.error_rollup(i.log.filter("action = 'extract_error'").select(owner, page, "message"))


@query(
    "f20_payload_fields",
    """WITH x AS (SELECT id, json_extract_string(extra_data, '$.page') AS p, json_extract_string(extra_data, '$.current') AS c,
    json_extract_string(extra_data, '$.label') AS l, json_extract_string(extra_data, '$.candidate_name') AS n, json_extract_string(extra_data, '$.candidate_count') AS cc,
    json_extract_string(extra_data, '$.answers_count') AS ac, json_extract_string(extra_data, '$.drawing_count') AS dc FROM v_log)
  SELECT id, coalesce(nullif(nullif(p, ''), '0'), nullif(nullif(c, ''), '0')) AS page, coalesce(nullif(l, ''), nullif(n, '')) AS label,
    coalesce(TRY_CAST(cc AS BIGINT), 0) AS candidate_count, coalesce(TRY_CAST(ac AS BIGINT), 0) AS answers_count, coalesce(TRY_CAST(dc AS BIGINT), 0) AS drawing_count FROM x""",
)
def _(i):
    return events.payload_fields(i.log).select("id", "page", "label", "candidate_count", "answers_count", "drawing_count")


SHOWN = "CAST(CAST({x} AS BIGINT) AS VARCHAR)"


MESSAGE = f"""CASE WHEN {NUM.format(f='page')} <> 0 THEN 'Processed page ' || {SHOWN.format(x=NUM.format(f='page'))} ||
      coalesce(' - ' || nullif(trim(coalesce(nullif(json_extract_string(extra_data, '$.label'), ''), json_extract_string(extra_data, '$.candidate_name'))), ''), '')
    WHEN {NUM.format(f='current')} <> 0 AND {NUM.format(f='total')} <> 0 THEN 'Step ' || {SHOWN.format(x=NUM.format(f='current'))} || ' of ' || {SHOWN.format(x=NUM.format(f='total'))}
    WHEN message <> '' THEN message ELSE 'Progress update' END"""


@query(
    "f21_progress_percent",
    f"""WITH lp AS (SELECT submission_id, {NUM.format(f='progress')} AS g, coalesce({NUM.format(f='current')}, {NUM.format(f='page')}) AS c, {NUM.format(f='total')} AS t, {MESSAGE} AS m
    FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY created_at DESC, id DESC) AS rn FROM v_log WHERE action = 'page_progress') WHERE rn = 1),
  st AS (SELECT DISTINCT submission_id, TRUE AS started FROM v_log WHERE action IN ('extract_start', 'page_progress')),
  j AS (SELECT s.submission_id, s.status, CAST(s.pages_count AS DOUBLE) AS pages, CAST(s.submission_id % 3 AS DOUBLE) AS page, lp.g, lp.c, lp.m, coalesce(lp.t, CAST(s.pages_count AS DOUBLE)) AS tt,
    CASE WHEN lp.g <= 1 THEN lp.g * 100 ELSE lp.g END AS share, coalesce(st.started, FALSE) AS started, CASE WHEN s.submission_id % 8 = 3 THEN 'broken ' || s.filename END AS err
    FROM v_sub s LEFT JOIN lp ON lp.submission_id = s.submission_id LEFT JOIN st ON st.submission_id = s.submission_id),
  k AS (SELECT *, CASE WHEN status IN ('completed', 'failed', 'pending') THEN status WHEN pages <> 0 AND page <> 0 THEN 'page' WHEN g IS NOT NULL THEN 'share'
    WHEN c <> 0 AND tt <> 0 THEN 'log' WHEN started THEN 'started' ELSE 'new' END AS w FROM j),
  r AS (SELECT submission_id, status, CASE w WHEN 'completed' THEN 100 WHEN 'failed' THEN CASE WHEN g IS NOT NULL THEN share WHEN coalesce(c, page) <> 0 AND tt <> 0 THEN coalesce(c, page) / tt * 100 ELSE 0 END
      WHEN 'pending' THEN 5 WHEN 'page' THEN page / pages * 100 WHEN 'share' THEN share WHEN 'log' THEN c / tt * 100 WHEN 'started' THEN 12 ELSE 8 END AS x,
    CASE w WHEN 'completed' THEN pages WHEN 'page' THEN page WHEN 'failed' THEN coalesce(c, page) WHEN 'share' THEN coalesce(c, page) WHEN 'log' THEN c END AS "current",
    CASE w WHEN 'completed' THEN pages WHEN 'pending' THEN pages WHEN 'page' THEN pages ELSE tt END AS total,
    CASE w WHEN 'completed' THEN 'Processing complete' WHEN 'failed' THEN coalesce(err, 'Processing failed') WHEN 'pending' THEN 'Queued for processing'
      WHEN 'page' THEN 'Processing page ' || {SHOWN.format(x='page')} || ' of ' || {SHOWN.format(x='pages')} WHEN 'share' THEN m WHEN 'log' THEN m WHEN 'started' THEN 'Extraction started' ELSE 'Preparing extraction...' END AS label FROM k)
  SELECT submission_id, status, CAST(greatest(0, least(100, floor(x + 0.5))) AS BIGINT) AS percent, "current", total, label FROM r""",
)
def _(i):
    error = F.when(F.col("submission_id") % 8 == 3, F.concat(F.lit("broken "), F.col("filename")))
    subs = i.sub.select(
        "submission_id", "status", "pages_count", (F.col("submission_id") % 3).alias("current_page"), error.alias("error_message")
    )
    return events.progress_state(subs, i.log)


@query(
    "f22_event_message",
    f"""WITH x AS (SELECT id, action, message, {NUM.format(f='page')} AS p, {NUM.format(f='current')} AS c, {NUM.format(f='total')} AS t,
    trim(coalesce(nullif(json_extract_string(extra_data, '$.label'), ''), json_extract_string(extra_data, '$.candidate_name'), '')) AS who FROM v_log)
  SELECT id, CASE WHEN action = 'page_progress' AND p <> 0 THEN 'Processed page ' || {SHOWN.format(x='p')} || CASE WHEN who <> '' THEN ' - ' || who ELSE '' END
    WHEN action = 'page_progress' AND c <> 0 AND t <> 0 THEN 'Step ' || {SHOWN.format(x='c')} || ' of ' || {SHOWN.format(x='t')}
    WHEN message <> '' THEN message WHEN action = 'upload' THEN 'Uploaded' WHEN action = 'extract_start' THEN 'Extraction started' WHEN action = 'page_progress' THEN 'Progress update'
    WHEN action = 'extract_complete' THEN 'Extraction complete' ELSE 'Extraction failed' END AS text FROM x""",
)
def _(i):
    return i.log.select("id", events.event_message(F.col("action"), F.col("message"), F.col("extra_data")).alias("text"))
