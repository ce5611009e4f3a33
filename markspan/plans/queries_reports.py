"""Queries that list, count, validate and report."""

from __future__ import annotations

from pyspark.sql import functions as F

from markspan.functions import codes, modeljson, text
from markspan.operators import events, listing, marking, normalize, ordered, reports
from markspan.plans.queries_answers import with_extra
from markspan.plans.queries_marking import PCT, SCORES, keys
from markspan.plans.registry import half_even_sql, query, shown_map
from markspan.session import new_path, written
from markspan.sources import results

COUNTS = """a AS (SELECT candidate_id, count(*) AS answers, count(*) FILTER (WHERE answer = 'DR') AS dr FROM v_ans GROUP BY 1),
  d AS (SELECT candidate_id, count(*) AS drawings FROM v_draw WHERE trim(response) <> '' GROUP BY 1),
  counts AS (SELECT s.candidate_id, s.submission_id, coalesce(a.answers, 0) AS answers, coalesce(a.dr, 0) AS dr, coalesce(d.drawings, 0) AS drawings
    FROM v_sheet s LEFT JOIN a ON a.candidate_id = s.candidate_id LEFT JOIN d ON d.candidate_id = s.candidate_id)"""


def counts(i):
    """Counts per candidate; only drawings with some response are in the drawing map, others show only as DR."""
    return reports.candidate_counts(i.sheet, i.ans, i.draw.filter(codes.strip(F.col("response")) != ""))


def paged(i, view=None):
    """Candidate sheets numbered from 1 within their submission."""
    sheets = i.sheet if view is None else view
    return ordered.number_rows(sheets, ["submission_id"], [F.col("candidate_id")], "page_number")


PAGED = "row_number() OVER (PARTITION BY submission_id ORDER BY candidate_id)"


# --- lookups and listings --------------------------------------------------------------------------------------


@query("p1_exam_by_id", "SELECT exam_id, name FROM v_exam WHERE exam_id = 3")
def _(i):
    return listing.by_ids(i.exam, exam_id=3)


@query(
    "p1_document_by_two_ids",
    """WITH w AS (SELECT exam_id, max(document_id) AS document_id FROM v_doc GROUP BY 1)
  SELECT d.document_id, d.exam_id, d.country, d.file_path FROM v_doc d JOIN w ON w.exam_id = d.exam_id AND w.document_id = d.document_id""",
)
def _(i):
    wanted = i.doc.groupBy("exam_id").agg(F.max("document_id").alias("document_id"))
    return listing.by_id_pairs(i.doc, wanted, ["document_id", "exam_id"])


@query("p2_status_filter", "SELECT submission_id, filename, pages_count FROM v_sub WHERE status = 'completed'")
def _(i):
    return listing.with_status(i.sub, "completed").select("submission_id", "filename", "pages_count")


@query(
    "p3_completed_gate",
    """SELECT submission_id, status = 'completed' AS ready,
    CASE WHEN status <> 'completed' THEN 'Submission is ' || status || ', not completed' END AS reason FROM v_sub""",
)
def _(i):
    return listing.completed_gate(i.sub).select("submission_id", "ready", "reason")


@query("t1_newest_first", "SELECT json_id, exam_id, filename, created_at FROM v_json ORDER BY created_at DESC, json_id DESC")
def _(i):
    return listing.newest_first(i.json, "json_id")


@query(
    "t2_listing_page",
    "SELECT submission_id, filename, status FROM v_sub WHERE status = 'completed' ORDER BY created_at DESC NULLS LAST, submission_id DESC LIMIT 25 OFFSET 10",
)
def _(i):
    return listing.page_of(i.sub, "submission_id", skip=10, limit=25, status="completed").select("submission_id", "filename", "status")


@query("t3_page_order", f"SELECT candidate_id, submission_id, {PAGED} AS page_number FROM v_sheet ORDER BY submission_id, page_number")
def _(i):
    return paged(i).select("candidate_id", "submission_id", "page_number").orderBy("submission_id", "page_number")


@query("t5_log_order", "SELECT id, submission_id, created_at FROM v_log ORDER BY coalesce(created_at, TIMESTAMP '1970-01-01'), id")
def _(i):
    return i.log.orderBy(*events.event_order()).select("id", "submission_id", "created_at")


@query("w10_page_numbers", f"SELECT candidate_id, submission_id, {PAGED} AS page_number FROM v_sheet")
def _(i):
    return paged(i).select("candidate_id", "submission_id", "page_number")


@query(
    "p9_search",
    """SELECT candidate_id FROM v_cand WHERE contains(lower(coalesce(candidate_name, '')), 'n_1') OR contains(lower(coalesce(candidate_number, '')), 'n_1')
    OR contains(lower(country), 'n_1') OR contains(lower(coalesce(paper_type, '')), 'n_1') OR contains(lower(coalesce(zone, '')), 'n_1')
    OR contains(lower(coalesce(student_name, '')), 'n_1') OR contains(lower(coalesce(candidate_no, '')), 'n_1')""",
)
def _(i):
    return listing.search(with_extra(i.cand), "N_1", ["candidate_name", "candidate_number", "country", "paper_type"]).select("candidate_id")


@query(
    "p9_search_extra_fields",
    """SELECT candidate_id FROM v_cand WHERE contains(lower(coalesce(candidate_name, '')), 'zone p') OR contains(lower(coalesce(candidate_number, '')), 'zone p')
    OR contains(lower(country), 'zone p') OR contains(lower(coalesce(paper_type, '')), 'zone p') OR contains(lower(coalesce(zone, '')), 'zone p')""",
)
def _(i):
    return listing.search(with_extra(i.cand), "Zone P", ["candidate_name", "candidate_number", "country", "paper_type"]).select("candidate_id")


# --- joins -----------------------------------------------------------------------------------------------------


@query(
    "j1_submission_candidates",
    """SELECT s.candidate_id, s.submission_id, b.status, b.filename, b.submission_id IS NULL AS submission_missing
  FROM v_sheet s LEFT JOIN v_sub b ON b.submission_id = s.submission_id""",
)
def _(i):
    out = listing.candidates_of_submissions(i.sheet, i.sub)
    return out.select("candidate_id", "submission_id", "status", "filename", "submission_missing")


@query("j10_delete_kept", "SELECT candidate_id, submission_id FROM v_sheet WHERE submission_id NOT IN (SELECT submission_id FROM v_sub WHERE status = 'failed')")
def _(i):
    return listing.without_deleted(i.sheet, i.sub.filter("status = 'failed'"), "submission_id").select("candidate_id", "submission_id")


@query("j10_delete_removed", "SELECT candidate_id, submission_id FROM v_sheet WHERE submission_id IN (SELECT submission_id FROM v_sub WHERE status = 'failed')")
def _(i):
    return listing.deleted_children(i.sheet, i.sub.filter("status = 'failed'"), "submission_id").select("candidate_id", "submission_id")


@query(
    "j11_exam_details",
    """WITH c AS (SELECT exam_id, 'document' AS kind, document_id AS id, country AS label, file_path AS place FROM v_doc
    UNION ALL SELECT exam_id, 'json', json_id, filename, NULL FROM v_json),
  n AS (SELECT *, row_number() OVER (PARTITION BY exam_id, kind ORDER BY id) AS n FROM c)
  SELECT e.exam_id, e.name, n.kind, n.n, n.id, n.label, n.place FROM v_exam e LEFT JOIN n ON n.exam_id = e.exam_id""",
)
def _(i):
    return listing.exam_details(i.exam, i.doc, i.json)


# --- counts ----------------------------------------------------------------------------------------------------


@query(
    "a1_submission_summary",
    f"""WITH {COUNTS} SELECT b.submission_id, b.filename, b.status, count(c.candidate_id) AS candidates_count,
    CAST(coalesce(sum(c.answers), 0) AS BIGINT) AS answers_count, CAST(coalesce(sum(c.drawings), 0) AS BIGINT) AS drawing_count
  FROM v_sub b LEFT JOIN counts c ON c.submission_id = b.submission_id GROUP BY 1, 2, 3""",
)
def _(i):
    out = reports.submission_summary(i.sub, counts(i))
    return out.select("submission_id", "filename", "status", "candidates_count", "answers_count", F.col("listed_drawings").alias("drawing_count"))


LATEST_DONE = """done AS (SELECT submission_id, TRY_CAST(json_extract_string(extra_data, '$.candidate_count') AS BIGINT) AS cc,
    TRY_CAST(json_extract_string(extra_data, '$.answers_count') AS BIGINT) AS ac, TRY_CAST(json_extract_string(extra_data, '$.drawing_count') AS BIGINT) AS dc
    FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY created_at DESC, id DESC) AS rn FROM v_log WHERE action = 'extract_complete') WHERE rn = 1)"""


STATUS_CTES = f"""{COUNTS}, {LATEST_DONE},
  own AS (SELECT submission_id, count(*) AS cc, sum(answers) AS ac, sum(CASE WHEN drawings > 0 THEN drawings ELSE dr END) AS dc FROM counts GROUP BY 1),
  j AS (SELECT b.submission_id, b.status, coalesce(d.cc, 0) AS cc, coalesce(d.ac, 0) AS ac, coalesce(d.dc, 0) AS dc, coalesce(o.cc, 0) AS occ,
    coalesce(o.ac, 0) AS oac, coalesce(o.dc, 0) AS odc, b.status = 'completed' AND coalesce(d.cc, 0) = 0 AS recount
    FROM v_sub b LEFT JOIN done d ON d.submission_id = b.submission_id LEFT JOIN own o ON o.submission_id = b.submission_id)"""
STATUS_SQL = """SELECT submission_id, status, CASE WHEN recount THEN occ ELSE cc END AS candidates_count,
    CAST(CASE WHEN recount THEN oac ELSE ac END AS BIGINT) AS answers_count, CAST(CASE WHEN recount THEN odc ELSE dc END AS BIGINT) AS drawing_count FROM j"""


@query("a2_status_counters", f"WITH {STATUS_CTES} {STATUS_SQL}")
def _(i):
    return reports.status_counters(i.sub.select("submission_id", "status"), i.log, counts(i))


@query(
    "a2_submission_status",
    f"""WITH {STATUS_CTES}, sc AS ({STATUS_SQL}),
  pp AS (SELECT submission_id, coalesce(nullif(nullif(json_extract_string(extra_data, '$.page'), ''), '0'), nullif(nullif(json_extract_string(extra_data, '$.current'), ''), '0')) AS current_page,
    coalesce(nullif(json_extract_string(extra_data, '$.label'), ''), nullif(json_extract_string(extra_data, '$.candidate_name'), '')) AS current_candidate
    FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY created_at DESC, id DESC) AS rn FROM v_log WHERE action = 'page_progress') WHERE rn = 1)
  SELECT b.submission_id, b.filename, b.created_at, b.pages_count, sc.status, sc.candidates_count, sc.answers_count, sc.drawing_count, pp.current_page, pp.current_candidate
  FROM v_sub b JOIN sc ON sc.submission_id = b.submission_id LEFT JOIN pp ON pp.submission_id = b.submission_id""",
)
def _(i):
    return reports.submission_status(i.sub, i.log, counts(i))


@query(
    "a4_pages_with_data",
    f"""WITH {COUNTS} SELECT submission_id, count(*) AS pages_processed, CAST(count(*) FILTER (WHERE answers > 0) AS BIGINT) AS pages_with_data FROM counts GROUP BY 1""",
)
def _(i):
    return reports.submission_counts(counts(i)).select("submission_id", F.col("candidates_count").alias("pages_processed"), "pages_with_data")


@query(
    "a5_extraction_totals",
    f"""WITH {COUNTS} SELECT count(*) AS total_candidates, CAST(sum(answers) AS BIGINT) AS total_answers, CAST(sum(drawings) AS BIGINT) AS total_drawing_questions FROM counts""",
)
def _(i):
    return reports.extraction_totals(counts(i))


@query("a10_average_answers", f"WITH {COUNTS} SELECT submission_id, CAST(floor(sum(answers) / count(*) + 0.5) AS BIGINT) AS avg_answers FROM counts GROUP BY 1")
def _(i):
    return reports.average_answers(counts(i), ["submission_id"])


@query(
    "a20_completion_events",
    f"""WITH {COUNTS}, s AS (SELECT b.submission_id, b.pages_count, count(c.candidate_id) AS n, coalesce(sum(c.answers), 0) AS a, coalesce(sum(c.dr), 0) AS dr,
    count(*) FILTER (WHERE c.answers > 0) AS pd FROM v_sub b LEFT JOIN counts c ON c.submission_id = b.submission_id GROUP BY 1, 2)
  SELECT submission_id, 'extract_complete' AS action, 'success' AS status,
    'Extracted ' || CAST(n AS VARCHAR) || ' candidates in ' || CAST(pages_count AS VARCHAR) || '.5s' AS message,
    '{{"candidate_count":' || CAST(n AS VARCHAR) || ',"answers_count":' || CAST(a AS VARCHAR) || ',"drawing_count":' || CAST(dr AS VARCHAR) ||
    ',"pages_processed":' || CAST(pages_count AS VARCHAR) || ',"pages_with_data":' || CAST(pd AS VARCHAR) || ',"conversion_seconds":' || CAST(pages_count * CAST(0.25 AS DOUBLE) AS VARCHAR) ||
    ',"extraction_seconds":' || CAST(pages_count * CAST(0.5 AS DOUBLE) AS VARCHAR) || ',"total_seconds":' || CAST(pages_count AS VARCHAR) || '.5}}' AS extra_data
  FROM s""",
)
def _(i):
    pages = F.col("pages_count")
    seconds = {"conversion_seconds": pages * F.lit(0.25), "extraction_seconds": pages * F.lit(0.5), "total_seconds": pages + F.lit(0.5)}
    return reports.completion_events(i.sub, counts(i), seconds)


@query(
    "s8_page_progress_events",
    f"""WITH {COUNTS}, n AS (SELECT c.*, {PAGED} AS page, count(*) OVER (PARTITION BY submission_id) AS total FROM counts c)
  SELECT submission_id, 'page_progress' AS action, 'info' AS status, 'Page ' || CAST(page AS VARCHAR) || ': ' || CAST(answers AS VARCHAR) || ' answers, ' || CAST(dr AS VARCHAR) ||
    ' drawing (' || CAST(page AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ')' AS message,
    '{{"page":' || CAST(page AS VARCHAR) || ',"current":' || CAST(page AS VARCHAR) || ',"total":' || CAST(total AS VARCHAR) || ',"progress":' || CAST({half_even_sql('page', 'total', 4)} AS VARCHAR) ||
    ',"label":"' || CAST(candidate_id AS VARCHAR) || '","answers_count":' || CAST(answers AS VARCHAR) || ',"drawing_count":' || CAST(dr AS VARCHAR) || '}}' AS extra_data FROM n""",
)
def _(i):
    pages = paged(i, counts(i)).select(
        "submission_id", "page_number", F.col("candidate_id").cast("string").alias("label"), F.col("answers").alias("answers_count"),
        F.col("dr_answers").alias("drawing_count"),
    )
    return events.page_progress_events(pages)


# --- validation ------------------------------------------------------------------------------------------------

WARN = "'Page ' || CAST({p} AS VARCHAR) || ': Unexpected answer ''' || coalesce({a}, 'None') || ''' for Q' || CAST({q} AS VARCHAR)"
STRICT = "NOT coalesce(r.raw_value IN ('A', 'B', 'C', 'D', 'E', 'BL', 'IN'), FALSE)"
TOLERANT = "coalesce(trim(r.raw_value), '') = ''"


def paged_raw(i):
    pages = paged(i).select("candidate_id", "page_number")
    return i.raw.join(pages, "candidate_id").withColumnRenamed("raw_value", "answer")


for _name, _rule, _fn in (("a11_strict_warnings", STRICT, reports.strict_warnings), ("a12_tolerant_warnings", TOLERANT, reports.tolerant_warnings)):

    @query(
        _name,
        f"""WITH p AS (SELECT candidate_id, {PAGED} AS page_number FROM v_sheet)
  SELECT r.candidate_id, r.question, {WARN.format(p='p.page_number', a='r.raw_value', q='r.question')} AS warning
  FROM v_raw r JOIN p ON p.candidate_id = r.candidate_id WHERE {_rule}""",
    )
    def _(i, fn=_fn):
        return fn(paged_raw(i)).select("candidate_id", "question", "warning")


for _name, _rule, _fn in (("a11_strict_summary", STRICT, reports.strict_warnings), ("a12_tolerant_summary", TOLERANT, reports.tolerant_warnings)):

    @query(
        _name,
        f"""WITH {COUNTS}, w AS (SELECT r.candidate_id, count(*) AS n FROM v_raw r WHERE {_rule} GROUP BY 1)
  SELECT c.submission_id, count(*) AS total_candidates, CAST(sum(c.answers) AS BIGINT) AS total_answers, CAST(sum(c.drawings) AS BIGINT) AS total_drawing_questions,
    CAST(coalesce(sum(w.n), 0) AS BIGINT) AS warnings, coalesce(sum(w.n), 0) = 0 AS is_valid FROM counts c LEFT JOIN w ON w.candidate_id = c.candidate_id GROUP BY 1""",
    )
    def _(i, fn=_fn):
        bad = fn(i.raw.withColumnRenamed("raw_value", "answer").withColumn("page_number", F.lit(1)))
        return reports.validation_summary(counts(i), bad)


# --- recognition confidence ------------------------------------------------------------------------------------

PAGE_STATS = f"""ps AS (SELECT doc_id, page, coalesce(CAST(sum(conf) FILTER (WHERE conf > 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE conf > 0), 0), 0) AS word_confidence,
    count(*) FILTER (WHERE conf > 0) AS word_count, coalesce(sum(conf) FILTER (WHERE conf >= 0), 0) AS vs, count(*) FILTER (WHERE conf >= 0) AS confidence_samples
    FROM v_tok GROUP BY 1, 2),
  pc AS (SELECT doc_id, page, word_confidence, word_count, confidence_samples, {half_even_sql('vs', 'confidence_samples', 2)} AS average_confidence FROM ps)"""


@query("a8_page_confidence", f"WITH {PAGE_STATS} SELECT * FROM pc")
def _(i):
    return reports.page_confidence(i.tok)


@query(
    "a9_run_summary",
    f"""WITH {PAGE_STATS}, h AS (SELECT doc_id, count(*) AS pages_total, CAST(count(*) FILTER (WHERE confidence_samples > 0) AS BIGINT) AS pages_ok,
    coalesce(sum(CAST(round(average_confidence * 100) AS BIGINT)) FILTER (WHERE average_confidence > 0), 0) AS s, count(*) FILTER (WHERE average_confidence > 0) AS n FROM pc GROUP BY 1)
  SELECT doc_id, pages_total, pages_ok, CAST({half_even_sql('s', 'n * 100', 2)} AS DOUBLE) AS average_confidence FROM h""",
)
def _(i):
    pages = reports.page_confidence(i.tok)
    status = F.when(F.col("confidence_samples") > 0, F.lit("ok")).otherwise(F.lit("error"))
    return reports.run_summary(pages.withColumn("status", status))


# --- output projections ----------------------------------------------------------------------------------------


@query(
    "p6_candidate_json",
    """SELECT candidate_id, CAST(json_object('candidate_name', candidate_name, 'candidate_number', candidate_number, 'country', country, 'paper_type', paper_type) AS VARCHAR) AS json FROM v_cand""",
)
def _(i):
    names = ["candidate_name", "candidate_number", "country", "paper_type", "page_number"]
    cand = i.cand.withColumn("page_number", F.lit(1))
    return listing.candidate_json(cand, names).select("candidate_id", "json")


@query(
    "p7_minimal_output",
    """WITH drawn AS (SELECT candidate_id, question - 30 AS question FROM v_draw WHERE trim(response) <> ''),
  o AS (SELECT candidate_id, question, 'DR' AS answer FROM drawn UNION ALL SELECT a.candidate_id, a.question, a.answer FROM v_ans a
    WHERE NOT EXISTS (SELECT 1 FROM drawn d WHERE d.candidate_id = a.candidate_id AND d.question = a.question)),
  m AS (SELECT candidate_id, '{' || string_agg('"' || CAST(question AS VARCHAR) || '":"' || answer || '"', ',' ORDER BY question) || '}' AS answers FROM o GROUP BY 1)
  SELECT c.candidate_id, coalesce(m.answers, '{}') AS answers, coalesce(nullif(c.candidate_number, ''), nullif(c.candidate_no, ''), '') AS candidate_number,
    coalesce(c.paper_type, '') AS paper_type FROM v_cand c LEFT JOIN m ON m.candidate_id = c.candidate_id""",
)
def _(i):
    drawn = i.draw.filter(codes.strip(F.col("response")) != "").select("candidate_id", (F.col("question") - 30).alias("question"))
    overlaid = normalize.overlay_drawings(i.ans, drawn).withColumn("question", F.col("question").cast("string"))
    out = listing.minimal_output(i.cand, overlaid, ["candidate_number", "candidate_no"])
    return out.withColumn("answers", F.to_json("answers"))


@query(
    "p8_flat_output",
    """SELECT candidate_id, concat_ws(';', 'candidate_name=' || coalesce(candidate_name, '-'), CASE WHEN candidate_no IS NOT NULL THEN 'candidate_no=' || candidate_no END,
    'candidate_number=' || coalesce(candidate_number, '-'), CASE WHEN zone IS NOT NULL THEN 'country=' || zone ELSE 'country=' || country END,
    CASE WHEN coalesce(paper_type, '') <> '' THEN 'paper_type=' || paper_type END) AS fields FROM v_cand""",
)
def _(i):
    pairs = F.array(F.struct(F.lit("country").alias("k"), F.col("zone").alias("v")), F.struct(F.lit("candidate_no").alias("k"), F.col("candidate_no").alias("v")))
    cand = i.cand.withColumn("extra_fields", F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull())))
    return listing.flat_output(cand).select("candidate_id", shown_map(F.col("fields")).alias("fields"))


@query(
    "f16_header_labels",
    """WITH b AS (SELECT candidate_id, unnest(json_keys(body)) AS k FROM v_resp WHERE candidate_id % 5 <> 3)
  SELECT k AS header_key, CASE k WHEN 'student_name' THEN 'Student Name' WHEN 'name' THEN 'Name' WHEN 'candidate_no' THEN 'Candidate No'
    WHEN 'candidate_number' THEN 'Candidate Number' WHEN 'centre' THEN 'Centre' WHEN 'zone' THEN 'Zone' WHEN 'desk_no' THEN 'Desk No'
    WHEN 'confidence' THEN 'Confidence' ELSE 'Answers' END AS label, count(*) AS n FROM b GROUP BY 1, 2""",
)
def _(i):
    obj = modeljson.object_text(F.col("response"))
    found = i.resp.select(F.explode(F.map_keys(modeljson.text_map(obj))).alias("header_key"))
    return found.groupBy("header_key").agg(F.count(F.lit(1)).alias("n")).withColumn("label", text.label_from_key(F.col("header_key")))


@query(
    "f18_text_report",
    f"""WITH {SCORES},
  al AS (SELECT candidate_id, '  Answers (' || CAST(count(*) AS VARCHAR) || '):' || chr(10) || string_agg('    Q' || CAST(question AS VARCHAR) || ': ' || answer, chr(10) ORDER BY question) AS t FROM v_ans GROUP BY 1),
  dl AS (SELECT candidate_id, '  Drawing Questions (' || CAST(count(*) AS VARCHAR) || '):' || chr(10) || string_agg('    Q' || CAST(question AS VARCHAR) || ': ' ||
    CASE WHEN length(response) > 80 THEN left(response, 80) || '...' ELSE response END, chr(10) ORDER BY question) AS t FROM v_draw GROUP BY 1),
  ml AS (SELECT candidate_id, '  Marked Answers:' || chr(10) || string_agg('    Q' || CAST(question AS VARCHAR) || ': ' || mark, chr(10) ORDER BY question) AS t FROM marks GROUP BY 1),
  sl AS (SELECT candidate_id, '  Score: ' || CAST(correct AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ' (' || CAST({PCT} AS VARCHAR) || '%)' AS t FROM scored)
  SELECT c.candidate_id, concat_ws(chr(10), '--- Candidate ' || CAST({PAGED} AS VARCHAR) || ' ---', '  Candidate Name: ' || c.candidate_name, '  Candidate Number: ' || coalesce(c.candidate_number, 'None'),
    '  Country: ' || c.country, al.t, dl.t, ml.t, sl.t) AS report FROM v_cand c LEFT JOIN al ON al.candidate_id = c.candidate_id
  LEFT JOIN dl ON dl.candidate_id = c.candidate_id LEFT JOIN ml ON ml.candidate_id = c.candidate_id LEFT JOIN sl ON sl.candidate_id = c.candidate_id""".replace("(PARTITION BY submission_id ORDER BY candidate_id)", "(PARTITION BY c.submission_id ORDER BY c.candidate_id)"),
)
def _(i):
    head = paged(i, i.cand.select("candidate_id", "submission_id", "paper_type", "candidate_name", "candidate_number", "country"))
    sheets = marking.match_keys(head, keys(i)).join(marking.sheet_maps(i.ans, i.draw), "candidate_id", "left")
    marked = marking.marked_maps(sheets, marking.key_lists(i.key, i.dkey))
    return reports.report_text(marked, ["candidate_name", "candidate_number", "country"])


STAMP = "2024-01-01T00:00:00"


@query(
    "f18_report_heads",
    f"""WITH {COUNTS} SELECT b.submission_id, '=== Exam Answer Sheet: ' || b.filename || ' ===' || chr(10) || 'Extracted at: {STAMP}' || chr(10) ||
    'Total candidates: ' || CAST(count(c.candidate_id) AS VARCHAR) AS head FROM v_sub b LEFT JOIN counts c ON c.submission_id = b.submission_id GROUP BY b.submission_id, b.filename""",
)
def _(i):
    return reports.report_heads(i.sub, counts(i), STAMP)


DOCUMENT_LINES = f"""{COUNTS}, t AS (SELECT submission_id, count(*) AS n, count(*) FILTER (WHERE answers > 0) AS pd, CAST(sum(answers) AS BIGINT) AS a, CAST(sum(drawings) AS BIGINT) AS d FROM counts GROUP BY 1),
  m AS (SELECT candidate_id, '{{' || string_agg('"' || CAST(question AS VARCHAR) || '":"' || answer || '"', ',' ORDER BY question) || '}}' AS answers FROM v_ans GROUP BY 1),
  dm AS (SELECT candidate_id, ',"drawing_questions":{{' || string_agg('"' || CAST(question AS VARCHAR) || '":' || CAST(to_json(response) AS VARCHAR), ',' ORDER BY question) || '}}' AS drawings
    FROM v_draw WHERE trim(response) <> '' GROUP BY 1),
  page AS (SELECT candidate_id, submission_id, {PAGED} AS page_number FROM v_sheet),
  p AS (SELECT c.submission_id, g.page_number AS n, '{{"candidate_name":' || to_json(c.candidate_name) || ',"candidate_number":' || coalesce(CAST(to_json(c.candidate_number) AS VARCHAR), 'null') ||
    ',"country":' || to_json(coalesce(c.zone, c.country)) || ',"answers":' || coalesce(m.answers, '{{}}') || coalesce(dm.drawings, '') ||
    CASE WHEN coalesce(c.paper_type, '') <> '' THEN ',"paper_type":' || to_json(c.paper_type) ELSE '' END || CASE WHEN c.zone IS NOT NULL THEN ',"zone":' || to_json(c.zone) ELSE '' END ||
    CASE WHEN c.candidate_no IS NOT NULL THEN ',"candidate_no":' || to_json(c.candidate_no) ELSE '' END || '}}' AS j
    FROM v_cand c JOIN page g ON g.candidate_id = c.candidate_id LEFT JOIN m ON m.candidate_id = c.candidate_id LEFT JOIN dm ON dm.candidate_id = c.candidate_id),
  w AS (SELECT g.submission_id, row_number() OVER (PARTITION BY g.submission_id ORDER BY g.page_number, r.question) AS n, {WARN.format(p='g.page_number', a='r.answer', q='r.question')} AS j
    FROM v_ans r JOIN page g ON g.candidate_id = r.candidate_id WHERE r.answer NOT IN ('A', 'B', 'C', 'D', 'E', 'BL', 'IN')),
  er AS (SELECT submission_id, CASE WHEN id % 11 <> 0 THEN id % 50 END AS page, message FROM v_log WHERE action = 'extract_error'),
  e AS (SELECT submission_id, row_number() OVER (PARTITION BY submission_id ORDER BY page NULLS FIRST, 'Page ' || coalesce(CAST(page AS VARCHAR), 'None') || ': ' || message) AS n,
    'Page ' || coalesce(CAST(page AS VARCHAR), 'None') || ': ' || message AS j FROM er),
  b AS (SELECT submission_id, filename, pages_count FROM v_sub UNION ALL SELECT -1, 'empty.pdf', 0),
  f AS (SELECT b.*, coalesce(t.n, 0) AS n, coalesce(t.pd, 0) AS pd, coalesce(t.a, 0) AS a, coalesce(t.d, 0) AS d,
    EXISTS (SELECT 1 FROM w WHERE w.submission_id = b.submission_id) AS bad, EXISTS (SELECT 1 FROM e WHERE e.submission_id = b.submission_id) AS failed FROM b LEFT JOIN t ON t.submission_id = b.submission_id),
  lines AS (
  SELECT submission_id, 0 AS section, CAST(0 AS BIGINT) AS n, '{{"document_information":{{"filename":"' || filename || '","extraction_timestamp":"{STAMP}","total_candidates":' || CAST(n AS VARCHAR) ||
    ',"pages_processed":' || CAST(pages_count AS VARCHAR) || ',"pages_with_data":' || CAST(pd AS VARCHAR) || ',"processing_time":' || CAST(pages_count * CAST(0.5 AS DOUBLE) AS VARCHAR) ||
    CASE WHEN submission_id % 3 = 0 THEN ',"detected_format":{{"mcq_range":"1-' || CAST(pages_count AS VARCHAR) || '"}}' ELSE '' END || '}},"candidates":[' AS line FROM f
  UNION ALL SELECT submission_id, 1, n, CASE WHEN n > 1 THEN ',' ELSE '' END || j FROM p
  UNION ALL SELECT submission_id, 2, 0, '],"logs":{{"validation":{{"is_valid":' || CASE WHEN bad THEN 'false' ELSE 'true' END || ',"warnings":[' FROM f
  UNION ALL SELECT submission_id, 3, n, CASE WHEN n > 1 THEN ',' ELSE '' END || to_json(j) FROM w
  UNION ALL SELECT submission_id, 4, 0, '],"total_candidates":' || CAST(n AS VARCHAR) || ',"total_answers":' || CAST(a AS VARCHAR) || ',"total_drawing_questions":' || CAST(d AS VARCHAR) || '}}' ||
    CASE WHEN failed THEN ',"extraction_errors":[' ELSE '' END FROM f
  UNION ALL SELECT submission_id, 5, n, CASE WHEN n > 1 THEN ',' ELSE '' END || to_json(j) FROM e WHERE submission_id IN (SELECT submission_id FROM f)
  UNION ALL SELECT submission_id, 6, 0, CASE WHEN failed THEN ']}}}}' ELSE '}}}}' END FROM f)"""


def document_lines(i):
    """The lines of the documents of all submissions, and of one more file without candidates."""
    drawn = i.draw.filter(codes.strip(F.col("response")) != "")
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(v).alias("v")) for k, v in (("country", "zone"), ("zone", "zone"), ("candidate_no", "candidate_no"))])
    cand = i.cand.withColumn("extra_fields", F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull())))
    numbers = written(paged(i).select("candidate_id", "page_number"), "page-numbers")
    maps = marking.sheet_maps(i.ans, drawn)
    sheets = cand.join(numbers, "candidate_id").join(maps, "candidate_id", "left")
    answers = i.ans.join(i.sheet.select("candidate_id", "submission_id"), "candidate_id").join(numbers, "candidate_id")
    page = F.when(F.col("id") % 11 != 0, F.col("id") % 50).alias("page")
    files = i.sub.select("submission_id", "filename", "pages_count")
    bare = files.groupBy().agg(F.lit(-1).cast("bigint").alias("submission_id"), F.lit("empty.pdf").alias("filename"), F.lit(0).cast("bigint").alias("pages_count"))
    files = files.unionByName(bare).withColumn("processing_time", F.col("pages_count") * F.lit(0.5))
    detected = F.when(F.col("submission_id") % 3 == 0, F.concat(F.lit('{"mcq_range":"1-'), F.col("pages_count").cast("string"), F.lit('"}')))
    log = i.log.filter("action = 'extract_error'").join(files.select("submission_id"), "submission_id", "left_semi")
    errors = events.error_rollup(log.select("submission_id", page, "message"))
    return reports.envelopes(files.withColumn("detected_format", detected), sheets, counts(i), reports.strict_warnings(answers), errors, STAMP)


@query("f19_document_envelopes", f"WITH {DOCUMENT_LINES} SELECT * FROM lines")
def _(i):
    return document_lines(i)


@query(
    "s3_source_documents",
    f"""WITH {DOCUMENT_LINES}, doc AS (SELECT submission_id, string_agg(line || chr(10), '' ORDER BY section, n) AS document, count(*) AS lines FROM lines GROUP BY 1)
  SELECT submission_id, lines, md5(document) AS digest, json_extract_string(document, '$.document_information.filename') AS filename,
    CAST(json_extract_string(document, '$.document_information.processing_time') AS DOUBLE) AS processing_time,
    CAST(json_array_length(document, '$.candidates') AS BIGINT) AS candidates, CAST(json_array_length(document, '$.logs.validation.warnings') AS BIGINT) AS warnings,
    json_extract_string(document, '$.logs.validation.is_valid') AS is_valid, json_extract_string(document, '$.candidates[0].country') AS first_country FROM doc""",
)
def _(i):
    """Documents are written, one to a source file, and read back."""
    folder = new_path(i.spark, "source-documents")
    results.write_source_documents(document_lines(i), folder, 20_000)
    parts = results.read_source_documents(i.spark, folder)
    whole = results.document_texts(parts).join(parts.groupBy("submission_id").agg(F.sum("lines").alias("lines")), "submission_id")
    parsed = results.parse_documents(whole, "document")

    def size(of, path):
        return F.json_array_length(F.get_json_object(of, path)).cast("bigint")

    info, logs = F.col("fields")["document_information"], F.col("fields")["logs"]
    return parsed.select(
        "submission_id", "lines", F.md5("document").alias("digest"), F.get_json_object(info, "$.filename").alias("filename"),
        F.get_json_object(info, "$.processing_time").cast("double").alias("processing_time"), F.json_array_length(F.col("fields")["candidates"]).cast("bigint").alias("candidates"),
        size(logs, "$.validation.warnings").alias("warnings"), F.get_json_object(logs, "$.validation.is_valid").alias("is_valid"),
        F.get_json_object(F.col("fields")["candidates"], "$[0].country").alias("first_country"),
    )
