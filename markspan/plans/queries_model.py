"""Queries that run user-supplied page functions; the functions here are deterministic stand-ins for a model."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from markspan.functions import modeljson
from markspan.operators import infer, layout, normalize
from markspan.plans import page_flow
from markspan.plans.queries_pages import CHOSEN, HASHES
from markspan.plans.registry import query, shown_map
from markspan.session import written


def answer_page(row: dict) -> str:
    """Fails for every 7th page; else two answers and a drawing."""
    page = int(row["page"])
    if page % 7 == 0:
        raise ValueError(f"page {page} is unreadable")
    answers = {"1": "ABCDE"[page % 5], "Q2": "", "3": str(page)}
    return "```json\n" + json.dumps({"candidate_no": page, "answers": answers, "drawing_questions": {"4": "curve"}}) + "\n```"


def describe_layout(row: dict) -> str:
    """Fails for every 11th page; else a format whose size depends on the page."""
    page = int(row["page"])
    if page % 11 == 0:
        raise ValueError("no format")
    spec = {"mcq_range": {"start": 1, "end": 2 + page % 3}, "total_questions": 8, "description": f"from {page}"}
    if page % 2:
        spec["drawing_range"] = "7-8"
    return json.dumps(spec)


def focus_page(row: dict) -> str:
    page = int(row["page"])
    return json.dumps({"answers": {"1": "BL", "2": "ABCDE"[(page + 1) % 5]}})


ANSWERED = """SELECT o_orderkey AS page, o_orderkey % 7 = 0 AS failed FROM orders"""


@query(
    "x1_page_extraction",
    f"""WITH p AS ({ANSWERED}) SELECT page, CASE WHEN failed THEN CAST(3 AS INTEGER) ELSE 1 END AS attempts,
    CASE WHEN failed THEN 'page ' || CAST(page AS VARCHAR) || ' is unreadable' END AS error, CASE WHEN NOT failed THEN CAST(page AS VARCHAR) END AS candidate_no,
    CASE WHEN failed THEN 0 ELSE 3 END AS n_answers FROM p""",
)
def _(i):
    pages = i.table("orders").select(F.col("o_orderkey").alias("page"))
    out = infer.call_pages(pages, answer_page, waits=(), concurrency=i.spark.sparkContext.defaultParallelism)
    obj = modeljson.text_map(modeljson.object_text(F.col("response")))
    count = F.coalesce(F.size(F.map_keys(modeljson.text_map(obj["answers"]))), F.lit(0))
    return out.select("page", "attempts", "error", obj["candidate_no"].alias("candidate_no"), F.when(F.col("response").isNull(), 0).otherwise(count).alias("n_answers"))


@query(
    "x1_page_answers",
    f"""WITH p AS ({ANSWERED}) SELECT page, q.k AS raw_key, CASE q.k WHEN '1' THEN substring('ABCDE', CAST(page % 5 + 1 AS INTEGER), 1) WHEN 'Q2' THEN '' WHEN '4' THEN 'DR' ELSE CAST(page AS VARCHAR) END AS raw_value
  FROM p CROSS JOIN (SELECT unnest(['1', 'Q2', '3', '4']) AS k) q WHERE NOT failed""",
)
def _(i):
    pages = i.table("orders").select(F.col("o_orderkey").alias("page"))
    responses = written(infer.call_pages(pages, answer_page, waits=()), "responses")
    return page_flow.response_answers(responses, drawings=True).drop("pos")


LAYOUTS = f"""{HASHES}, q AS (SELECT hs.layout_hash, hs.page, greatest(v.quality, 0) AS quality FROM hs JOIN v_quality v ON v.page = hs.page),
  rep AS (SELECT layout_hash, page FROM (SELECT *, row_number() OVER (PARTITION BY layout_hash ORDER BY quality DESC, page) AS rn FROM q) WHERE rn = 1),
  fm AS (SELECT layout_hash, page % 11 = 0 AS fb, CASE WHEN page % 11 <> 0 THEN 2 + page % 3 END AS mcq_end, page % 11 <> 0 AND page % 2 = 1 AS dr, page AS rep_page FROM rep)"""


def layout_pages(i):
    return layout.layout_hashes(i.reg).join(i.quality, "page")


@query(
    "x2_format_detection",
    f"""WITH {LAYOUTS} SELECT layout_hash AS format_id, CAST(mcq_end AS BIGINT) AS mcq_end, CASE WHEN fb THEN CAST(20 AS BIGINT) END AS numeric_end, CASE WHEN dr THEN CAST(8 AS BIGINT) END AS drawing_end,
    CASE WHEN fb THEN 'Fallback format' ELSE 'from ' || CAST(rep_page AS VARCHAR) END AS description FROM fm""",
)
def _(i):
    out = infer.detect_formats(layout_pages(i), describe_layout)
    return out.select("format_id", "mcq_end", "numeric_end", "drawing_end", "description")


@query(
    "f29_prompts",
    """SELECT format_id, 'Header fields:' || chr(10) || CASE WHEN k = 0 THEN '- Zone' WHEN k IN (3, 4) THEN '- Candidate Number' || chr(10) || '- Candidate Name' ELSE '' END || chr(10) ||
    concat_ws(chr(10), CASE WHEN k IN (0, 1, 5) THEN 'Questions 1-' || CAST(p_size AS VARCHAR) || ' are multiple choice with options ' || CASE WHEN k = 0 THEN 'A, B, C, D, E' ELSE 'A, B, C, D' END ||
      '. Give the printed letter of the marked option, BL if none, IN if several.' END,
      CASE WHEN k = 0 THEN 'Questions 31-35 are written answers. Copy what is written, BL if empty.' WHEN k IN (3, 4) THEN 'Questions 1-20 are written answers. Copy what is written, BL if empty.' END,
      CASE WHEN k = 2 THEN 'Questions 40-44 are drawings. Give DR for a drawing, the text if it is text, BL if empty.' END,
      'Return one JSON object with the keys ' || CASE WHEN k = 0 THEN 'zone' WHEN k IN (3, 4) THEN 'candidate_number, candidate_name' ELSE '' END || ' and answers.') AS prompt
  FROM (SELECT CAST(p_partkey AS VARCHAR) AS format_id, p_size, p_partkey % 6 AS k FROM part)""",
)
def _(i):
    return infer.page_prompt(normalize.parse_format_responses(i.fmtresp)).select("format_id", "prompt")


VALID = LAYOUTS.replace("ON v.page = hs.page)", "ON v.page = hs.page WHERE hs.page % 10 <> 3)")
FLOW = f"""WITH {VALID}, {CHOSEN},
  pg AS (SELECT hs.page, fm.* EXCLUDE (rep_page) FROM hs JOIN fm ON fm.layout_hash = hs.layout_hash WHERE hs.page % 10 <> 3),
  inr AS (SELECT s.page, s.question, substring('ABCD', CAST(least(s.opt, 4) AS INTEGER), 1) AS answer FROM ch s JOIN pg ON pg.page = s.page WHERE s.opt IS NOT NULL AND s.question BETWEEN 1 AND pg.mcq_end),
  c AS (SELECT page, count(*) AS m FROM inr GROUP BY 1),
  rt AS (SELECT pg.*, coalesce(c.m, 0) = 0 OR (mcq_end IS NOT NULL AND coalesce(c.m, 0) < mcq_end * 0.8) OR dr AS needs FROM pg LEFT JOIN c ON c.page = pg.page)"""


def flow(i):
    pages = written(layout_pages(i), "pages").withColumn("is_blank", F.col("page") % 10 == 3)
    return page_flow.extract(pages, i.cell, describe_layout, answer_page, focus_page, waits=())


@query(
    "x3_page_flow_answers",
    FLOW
    + """, mod AS (SELECT * FROM rt WHERE needs AND page % 7 <> 0),
  want AS (SELECT page, mcq_end, fb, unnest(range(1, CASE WHEN fb THEN 21 ELSE mcq_end + 1 END)) AS q, CASE WHEN fb THEN 'numeric' ELSE 'mcq' END AS t FROM mod
    UNION ALL SELECT page, mcq_end, fb, unnest(range(7, 9)), 'drawing' FROM mod WHERE dr),
  raw AS (SELECT m.page, k.q, CASE k.q WHEN 1 THEN substring('ABCDE', CAST(m.page % 5 + 1 AS INTEGER), 1)
      WHEN 2 THEN CASE WHEN m.mcq_end IS NOT NULL THEN substring('ABCDE', CAST((m.page + 1) % 5 + 1 AS INTEGER), 1) ELSE '' END ELSE CAST(m.page AS VARCHAR) END AS v
    FROM mod m CROSS JOIN (SELECT unnest([1, 2, 3]) AS q) k),
  mg AS (SELECT coalesce(r.page, i.page) AS page, coalesce(r.q, i.question) AS q, coalesce(i.answer, r.v) AS v FROM raw r FULL JOIN (SELECT i.* FROM inr i JOIN mod ON mod.page = i.page) i ON i.page = r.page AND i.question = r.q)
  SELECT i.page, CAST(i.question AS VARCHAR) AS question, i.answer, 'cv_only' AS method FROM inr i JOIN rt ON rt.page = i.page WHERE NOT rt.needs
  UNION ALL SELECT coalesce(w.page, mg.page), CAST(coalesce(w.q, mg.q) AS VARCHAR), CASE WHEN mg.v IS NULL OR trim(mg.v) = '' THEN 'BL' WHEN w.t = 'mcq' THEN CASE WHEN mg.v IN ('A', 'B', 'C', 'D') THEN mg.v ELSE 'IN' END ELSE mg.v END, 'llm_full'
  FROM want w FULL JOIN mg ON mg.page = w.page AND mg.q = w.q""",
)
def _(i):
    return flow(i).answers


@query(
    "x3_page_flow_records",
    FLOW
    + """ SELECT page, CASE WHEN NOT needs THEN 'cv_only' WHEN page % 7 = 0 THEN 'failed' ELSE 'llm_full' END AS method,
    CAST(CASE WHEN NOT needs THEN 0.95 WHEN page % 7 = 0 THEN 0.0 ELSE 0.9 END AS DOUBLE) AS confidence,
    CASE WHEN needs AND page % 7 <> 0 THEN CAST(page AS VARCHAR) END AS candidate_number,
    CASE WHEN needs AND page % 7 <> 0 THEN 'drawing_questions={"4":"curve"}' ELSE '' END AS extra,
    CASE WHEN needs AND page % 7 = 0 THEN 'page ' || CAST(page AS VARCHAR) || ' is unreadable' END AS error FROM rt""",
)
def _(i):
    r = flow(i).records
    return r.select("page", "method", "confidence", "candidate_number", shown_map(F.col("extra_fields")).alias("extra"), "error")
