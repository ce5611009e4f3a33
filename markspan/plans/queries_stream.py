"""Queries that run the streaming jobs over the given tables until no input is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from markspan.plans.queries_marking import PCT, SCORES, keys
from markspan.plans.queries_model import LAYOUTS, describe_layout, layout_pages
from markspan.plans.registry import query
from markspan.session import dropping_shuffles, new_path
from markspan.streaming import jobs


def staged(i, df, name: str) -> str:
    path = new_path(i.spark, name)
    with dropping_shuffles(i.spark):
        df.write.parquet(path)
    return path


@query(
    "r1_new_result_files",
    """WITH b AS (SELECT candidate_id FROM v_resp WHERE candidate_id % 5 <> 3)
  SELECT a.candidate_id, CAST(a.question AS VARCHAR) AS question, CASE a.question WHEN 3 THEN 'BL' WHEN 4 THEN '42' ELSE a.answer END AS answer
  FROM v_ans a JOIN b ON b.candidate_id = a.candidate_id""",
)
def _(i):
    folder = staged(i, i.resp.select("candidate_id", "response"), "responses")
    stream = jobs.read_new_files(i.spark, folder, "candidate_id BIGINT, response STRING")
    out = new_path(i.spark, "new-answers")
    jobs.process_new_responses(stream, "candidate_id", out)
    return i.spark.read.schema("candidate_id BIGINT, question STRING, answer STRING").parquet(out)


@query(
    "r2_live_status",
    """WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY created_at DESC, id DESC) AS rn FROM v_log) WHERE rn = 1),
  p AS (SELECT submission_id, coalesce(nullif(nullif(json_extract_string(extra_data, '$.page'), ''), '0'), nullif(nullif(json_extract_string(extra_data, '$.current'), ''), '0')) AS current_page,
    coalesce(nullif(json_extract_string(extra_data, '$.label'), ''), nullif(json_extract_string(extra_data, '$.candidate_name'), '')) AS current_candidate
    FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY created_at DESC, id DESC) AS rn FROM v_log WHERE action = 'page_progress') WHERE rn = 1)
  SELECT n.submission_id, n.id, n.action, n.message, n.created_at, p.current_page, p.current_candidate FROM n LEFT JOIN p ON p.submission_id = n.submission_id""",
)
def _(i):
    out = new_path(i.spark, "status")
    jobs.track_status(i.stream("v_log"), out)
    return jobs.tracked_status(i.spark, out)


@query(
    "r3_first_seen_layouts",
    f"""WITH {LAYOUTS} SELECT layout_hash AS format_id, CAST(mcq_end AS BIGINT) AS mcq_end,
    CASE WHEN fb THEN 'Fallback format' ELSE 'from ' || CAST(rep_page AS VARCHAR) END AS description FROM fm""",
)
def _(i):
    folder = staged(i, layout_pages(i), "layouts")
    stream = jobs.read_new_files(i.spark, folder, "page BIGINT, layout_hash STRING, quality DOUBLE")
    out = new_path(i.spark, "formats")
    jobs.detect_new_layouts(stream, describe_layout, out)
    return i.spark.read.parquet(out).select("format_id", "mcq_end", "description")


@query(
    "r4_streaming_marks",
    f"""WITH {SCORES} SELECT m.candidate_id, m.submission_id, m.key_id, s.correct, s.total, {PCT.replace('correct', 's.correct').replace('total', 's.total')} AS percentage
  FROM matched m LEFT JOIN scored s ON s.candidate_id = m.candidate_id""",
)
def _(i):
    answers = i.ans.select("candidate_id", F.lit("answer").alias("kind"), "question", F.col("answer").alias("value"))
    drawings = i.draw.select("candidate_id", F.lit("drawing").alias("kind"), "question", F.col("response").alias("value"))
    rows = i.sheet.join(answers.unionByName(drawings), "candidate_id", "left")
    # A sheet's rows lie in three files at least, and the files arrive in three batches.
    batches, tasks = 3, int(i.spark.conf.get("spark.sql.shuffle.partitions"))
    folder = staged(i, rows.repartition(batches * tasks, F.coalesce("question", F.lit(0)) % batches, "candidate_id"), "sheets")
    schema = "candidate_id BIGINT, submission_id BIGINT, paper_type STRING, kind STRING, question BIGINT, value STRING"
    out = new_path(i.spark, "scores")
    jobs.mark_new_sheets(jobs.with_place(jobs.read_new_files(i.spark, folder, schema, files_per_batch=tasks)), keys(i), i.key, out, i.dkey)
    scored = "candidate_id BIGINT, submission_id BIGINT, key_id BIGINT, correct BIGINT, total BIGINT, percentage DOUBLE"
    return jobs.streamed_marks(i.spark, out, scored)


@query(
    "r5_lifecycle",
    """WITH r AS (SELECT submission_id, created_at, id, CASE action WHEN 'upload' THEN 0 WHEN 'extract_start' THEN 1 WHEN 'page_progress' THEN 1 ELSE 2 END AS rk,
    CASE action WHEN 'upload' THEN 'pending' WHEN 'extract_complete' THEN 'completed' WHEN 'extract_error' THEN 'failed' ELSE 'processing' END AS status FROM v_log)
  SELECT submission_id, status FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY rk DESC, created_at DESC, id DESC) AS rn FROM r) WHERE rn = 1""",
)
def _(i):
    out = new_path(i.spark, "lifecycle")
    jobs.track_lifecycle(i.stream("v_log"), out)
    return jobs.tracked_lifecycle(i.spark, out)
