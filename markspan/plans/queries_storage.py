"""Queries that write to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from markspan.functions.text import json_text
from markspan.operators import events, listing, reports
from markspan.plans.queries_reports import PAGE_STATS
from markspan.plans.registry import half_even_sql, query
from markspan.session import new_path
from markspan.sources import artifacts, intake, results, stored


@query(
    "s2_stored_documents",
    """SELECT candidate_id, candidate_id % 5 = 1 AS decoded, CASE WHEN candidate_id % 5 = 1 THEN json_extract_string(body, '$.name') END AS name,
    CASE WHEN candidate_id % 5 <> 1 THEN response END AS raw FROM v_resp""",
)
def _(i):
    parsed = results.parse_documents(i.resp, "response")
    return parsed.select("candidate_id", F.col("fields").isNotNull().alias("decoded"), F.col("fields")["name"].alias("name"), "raw")


@query(
    "s3_result_documents",
    "SELECT CAST(candidate_id AS VARCHAR) AS candidate_id, candidate_name, candidate_number, country FROM v_cand",
)
def _(i):
    docs = listing.candidate_json(i.cand, ["candidate_id", "candidate_name", "candidate_number", "country"])
    path = new_path(i.spark, "documents")
    results.write_documents(docs, "json", path)
    back = results.read_document_lines(i.spark, path)
    return back.select(*[F.col("fields")[c].alias(c) for c in ("candidate_id", "candidate_name", "candidate_number", "country")])


@query("s4_candidate_append", "SELECT candidate_id, submission_id, paper_type FROM v_sheet")
def _(i):
    path = new_path(i.spark, "candidates")
    results.append_by_submission(i.sheet.filter("paper_type IS NULL"), path)
    results.append_by_submission(i.sheet.filter("paper_type IS NOT NULL"), path)
    return i.spark.read.parquet(path).select("candidate_id", "submission_id", "paper_type")


@query(
    "s5_run_artifacts",
    """SELECT id, strftime(created_at, '%Y') AS year, strftime(created_at, '%m') AS month, strftime(created_at, '%d') AS day,
    strftime(created_at, '%Y/%m/%d') || '/submission_' || CAST(submission_id AS VARCHAR) || '/' || action || '/' || strftime(created_at, '%H%M%S') AS run_dir,
    'pages/page_' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') || '.txt' AS text_file FROM v_log""",
)
def _(i):
    context, source = intake.run_tokens(
        F.concat(F.lit("submission_"), F.col("submission_id").cast("string")), F.concat(F.col("action"), F.lit(".pdf"))
    )
    pages = i.log.select(
        "id", "created_at", events.run_folder(F.col("created_at"), context, source).alias("run_dir"),
        F.format_string("pages/page_%03d.txt", F.col("id") % 1000).alias("text_file"),
    )
    path = new_path(i.spark, "artifacts")
    results.append_by_day(pages, "created_at", path)
    schema = "id BIGINT, created_at TIMESTAMP_NTZ, run_dir STRING, text_file STRING, year STRING, month STRING, day STRING"
    return i.spark.read.schema(schema).parquet(path).drop("created_at")


RUN_PAGES = f"""{PAGE_STATS}, pages AS (SELECT o.doc_id, strftime(o.created_at, '%Y/%m/%d') || '/doc_' || CAST(o.doc_id AS VARCHAR) || '/scan_' || CAST(o.doc_id AS VARCHAR) || '/' || strftime(o.created_at, '%H%M%S') AS run_dir,
    o.page, 'p' || CAST(o.page AS VARCHAR) || '.png' AS image_file, 'pages/page_' || lpad(CAST(o.page AS VARCHAR), 3, '0') || '.txt' AS text_file,
    CASE WHEN o.error IS NULL THEN 'ok' ELSE 'error' END AS status, o.error, CAST(CASE WHEN o.error IS NULL THEN 5 ELSE 0 END AS BIGINT) AS word_count,
    CASE WHEN o.error IS NULL THEN pc.average_confidence ELSE 0 END AS average_confidence, CAST(CASE WHEN o.error IS NULL THEN pc.confidence_samples ELSE 0 END AS BIGINT) AS confidence_samples,
    CASE WHEN o.error IS NULL THEN o.text ELSE '' END AS text FROM v_ocr o JOIN pc ON pc.doc_id = o.doc_id AND pc.page = o.page)"""


def stored_runs(i):
    """The pages of all scans, stored by two jobs, the second of which meets some of the first one's runs again."""
    stats = reports.page_confidence(i.tok).select("doc_id", "page", "average_confidence", "confidence_samples")
    doc, page = F.col("doc_id").cast("string"), F.col("page").cast("string")
    pages = i.ocr.join(stats, ["doc_id", "page"]).select(
        F.concat(F.lit("doc_"), doc).alias("context_id"), F.concat(F.lit("in/scan "), doc, F.lit(".pdf")).alias("source_filename"), "created_at", "page",
        F.concat(F.lit("tmp/p"), page, F.lit(".png")).alias("image_path"), "text", "error", "average_confidence", "confidence_samples", "doc_id",
    )
    folder = new_path(i.spark, "runs")
    artifacts.write_runs(pages.filter("doc_id % 2 = 0"), folder, "document")
    artifacts.write_runs(pages, folder, "document")
    return folder


@query("s5_run_pages", f"WITH {RUN_PAGES} SELECT * EXCLUDE (doc_id) FROM pages")
def _(i):
    return artifacts.read_pages(i.spark, stored_runs(i))


@query(
    "s5_run_summaries",
    f"""WITH {RUN_PAGES}, h AS (SELECT run_dir, doc_id, count(*) AS pages_total, CAST(count(*) FILTER (WHERE status = 'ok') AS BIGINT) AS pages_ok,
    coalesce(sum(CAST(round(average_confidence * 100) AS BIGINT)) FILTER (WHERE average_confidence > 0), 0) AS s, count(*) FILTER (WHERE average_confidence > 0) AS n FROM pages GROUP BY 1, 2)
  SELECT run_dir, 'doc_' || CAST(doc_id AS VARCHAR) AS context_id, 'in/scan ' || CAST(doc_id AS VARCHAR) || '.pdf' AS source_filename, 'document' AS preprocessing_mode,
    pages_total, pages_ok, CAST({half_even_sql('s', 'n * 100', 2)} AS DOUBLE) AS average_confidence FROM h""",
)
def _(i):
    return artifacts.read_runs(i.spark, stored_runs(i)).drop("attempt")


@query(
    "j10_stored_deletion",
    """SELECT 'candidate' AS kind, candidate_id AS id, submission_id FROM v_sheet s WHERE NOT EXISTS (SELECT 1 FROM v_sub b WHERE b.submission_id = s.submission_id AND b.status = 'failed')
  UNION ALL SELECT 'event', id, submission_id FROM v_log l WHERE NOT EXISTS (SELECT 1 FROM v_sub b WHERE b.submission_id = l.submission_id AND b.status = 'failed')""",
)
def _(i):
    """Failed submissions are deleted with their candidates and their log."""
    folders = {kind: new_path(i.spark, f"kept-{kind}") for kind in ("candidate", "event")}
    results.append_by_submission(i.sheet, folders["candidate"])
    results.append_by_submission(i.log.select("id", "submission_id", "action"), folders["event"])
    stored.delete_submissions(i.spark, list(folders.values()), listing.with_status(i.sub, "failed"), new_path(i.spark, "deletion"))
    left = [
        stored.read_stored(i.spark, folders[kind]).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "submission_id")
        for kind, key in (("candidate", "candidate_id"), ("event", "id"))
    ]
    return left[0].unionByName(left[1])


@query(
    "s8_log_events",
    """SELECT submission_id, 'upload' AS action, 'success' AS status, 'Stored ' || filename AS message, filename, pages_count AS pages, created_at FROM v_sub""",
)
def _(i):
    rows = events.log_events(
        i.sub, "upload", "success", F.concat(F.lit("Stored "), F.col("filename")), ["filename", "pages_count"], F.col("created_at")
    )
    path = new_path(i.spark, "log")
    results.append_log(rows, path)
    back = i.spark.read.parquet(path)
    return back.select(
        "submission_id", "action", "status", "message", json_text(F.col("extra_data"), "filename").alias("filename"),
        json_text(F.col("extra_data"), "pages_count").cast("bigint").alias("pages"), "created_at",
    )
