"""Queries that match, apply and manage answer keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from markspan.operators import listing, marking, reports, requests
from markspan.plans.registry import half_even_sql, query, shown_map
from markspan.session import new_path
from markspan.sources import results, stored

KEY_TYPES = """kt AS (SELECT upper(trim(paper_type)) AS kpt, min(key_id) AS pos, max(key_id) AS key_id
    FROM (SELECT DISTINCT key_id, paper_type FROM v_key) WHERE trim(paper_type) <> '' GROUP BY 1)"""
MATCHED = f"""{KEY_TYPES},
  typed AS (SELECT candidate_id, submission_id, upper(trim(coalesce(paper_type, 'NONE'))) AS pt FROM v_sheet),
  matched AS (SELECT t.candidate_id, t.submission_id, arg_min(k.key_id, CASE WHEN k.kpt = t.pt THEN -1 ELSE k.pos END) AS key_id,
    CASE WHEN bool_or(k.kpt = t.pt) THEN 'exact' WHEN count(k.key_id) > 0 THEN 'contains' END AS match_kind
    FROM typed t LEFT JOIN kt k ON k.kpt = t.pt OR contains(t.pt, k.kpt) OR contains(k.kpt, t.pt) GROUP BY 1, 2)"""
MARK = """CASE WHEN a.answer IS NULL THEN 'BL' WHEN a.answer IN ('BL', 'IN') THEN a.answer
    WHEN upper(a.answer) = upper(k.correct) THEN 'P' ELSE a.answer END"""
DMARK = """CASE WHEN d.response IS NULL OR trim(d.response) = '' THEN 'BL' WHEN contains(lower(d.response), lower(k.expected)) THEN 'P' ELSE 'IM' END"""
MARKS = f"""marks AS (SELECT m.candidate_id, m.key_id, k.question, k.correct, a.answer, {MARK} AS mark FROM matched m
    JOIN v_key k ON k.key_id = m.key_id LEFT JOIN v_ans a ON a.candidate_id = m.candidate_id AND a.question = k.question),
  dmarks AS (SELECT m.candidate_id, m.key_id, k.question, {DMARK} AS mark FROM matched m
    JOIN v_dkey k ON k.key_id = m.key_id LEFT JOIN v_draw d ON d.candidate_id = m.candidate_id AND d.question = k.question)"""
SCORES = f"""{MATCHED},
  {MARKS},
  scored AS (SELECT candidate_id, key_id, CAST(count(*) FILTER (WHERE mark = 'P') AS BIGINT) AS correct, count(*) AS total
    FROM (SELECT candidate_id, key_id, mark FROM marks UNION ALL SELECT candidate_id, key_id, mark FROM dmarks) GROUP BY 1, 2)"""
PCT = half_even_sql("correct * 100", "total", 1)


def keys(i):
    return i.key.select("key_id", "paper_type").distinct()


def matched(i):
    return marking.match_keys(i.sheet, keys(i))


def scored(i):
    return marking.marked_candidates(i.sheet, keys(i), i.key, i.ans, i.dkey, i.draw)


@query(
    "w11_keys_by_type",
    """SELECT upper(trim(paper_type)) AS paper_type_norm, min(key_id) AS key_pos, max(key_id) AS key_id
  FROM v_keydef WHERE trim(paper_type) <> '' GROUP BY 1""",
)
def _(i):
    return marking.keys_by_type(i.keydef)


@query("j2_key_driven_marks", f"WITH {MATCHED}, {MARKS} SELECT candidate_id, key_id, question, correct, answer, mark FROM marks")
def _(i):
    asked = matched(i).select("candidate_id", "key_id").join(i.key.select("key_id", "question", "correct"), "key_id")
    return marking.mark_answers(asked, i.ans).select("candidate_id", "key_id", "question", "correct", "answer", "mark")


@query("j2_drawing_marks", f"WITH {MATCHED}, {MARKS} SELECT candidate_id, key_id, question, mark FROM dmarks")
def _(i):
    asked = matched(i).select("candidate_id", "key_id").join(i.dkey, "key_id")
    return marking.mark_drawings(asked, i.draw).select("candidate_id", "key_id", "question", "mark")


INLINE_KEY = {"1": "B", "2": "d", "3": "A", "4": "C", "20": "E"}


@query(
    "j3_inline_key",
    f"""WITH k AS (SELECT * FROM (VALUES (1, 'B'), (2, 'd'), (3, 'A'), (4, 'C'), (20, 'E')) AS t(question, correct))
  SELECT s.candidate_id, CAST(k.question AS BIGINT) AS question, {MARK} AS mark FROM v_sheet s CROSS JOIN k
  LEFT JOIN v_ans a ON a.candidate_id = s.candidate_id AND a.question = k.question""",
)
def _(i):
    asked = marking.with_inline_key(i.sheet.select("candidate_id"), INLINE_KEY)
    asked = asked.withColumn("question", F.col("question").cast("bigint"))
    return marking.mark_answers(asked, i.ans).select("candidate_id", "question", "mark")


@query(
    "j4_key_by_id",
    f"""SELECT s.candidate_id, k.key_id, k.question, {MARK} AS mark FROM v_sheet s JOIN v_key k ON k.key_id = s.submission_id % 6 + 1
  LEFT JOIN v_ans a ON a.candidate_id = s.candidate_id AND a.question = k.question""",
)
def _(i):
    chosen = i.sheet.select("candidate_id", (F.col("submission_id") % 6 + 1).alias("key_id"))
    asked = chosen.join(i.key.select("key_id", "question", "correct"), "key_id")
    return marking.mark_answers(asked, i.ans).select("candidate_id", "key_id", "question", "mark")


@query(
    "j5_exact_type_join",
    f"""WITH {KEY_TYPES} SELECT s.candidate_id, k.key_id, k.key_pos FROM (SELECT candidate_id, upper(trim(coalesce(paper_type, 'NONE'))) AS pt FROM v_sheet) s
  JOIN (SELECT kpt, key_id, pos AS key_pos FROM kt) k ON k.kpt = s.pt""",
)
def _(i):
    return marking.exact_matches(i.sheet, marking.keys_by_type(keys(i))).select("candidate_id", "key_id", "key_pos")


@query("j6_containment_match", f"WITH {MATCHED} SELECT candidate_id, key_id, match_kind FROM matched WHERE key_id IS NOT NULL")
def _(i):
    return matched(i).filter(F.col("key_id").isNotNull()).select("candidate_id", "key_id", "match_kind")


@query(
    "j6_many_key_types",
    """WITH kt AS (SELECT upper(trim(paper_type)) AS kpt, min(key_id) AS pos, max(key_id) AS key_id FROM v_keydef WHERE trim(paper_type) <> '' GROUP BY 1),
  t AS (SELECT DISTINCT upper(p_brand || CASE WHEN p_size % 4 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END) AS pt FROM part)
  SELECT t.pt AS paper_type_norm, arg_min(k.key_id, CASE WHEN k.kpt = t.pt THEN -1 ELSE k.pos END) AS key_id FROM t
  LEFT JOIN kt k ON k.kpt = t.pt OR contains(t.pt, k.kpt) OR contains(k.kpt, t.pt) GROUP BY 1""",
)
def _(i):
    size = F.when(F.col("p_size") % 4 == 0, F.lit("")).otherwise(F.col("p_size").cast("string"))
    types = i.table("part").select(F.upper(F.concat("p_brand", size)).alias("paper_type_norm")).distinct()
    return marking.type_matches(types, marking.keys_by_type(i.keydef)).select("paper_type_norm", "key_id")


@query("j7_unmatched_kept", f"WITH {MATCHED} SELECT candidate_id, submission_id, key_id FROM matched")
def _(i):
    return matched(i).select("candidate_id", "submission_id", "key_id")


@query("a6_scores", f"WITH {SCORES} SELECT candidate_id, key_id, correct, total, {PCT} AS percentage FROM scored")
def _(i):
    found = scored(i).filter(F.col("key_id").isNotNull())
    return found.select("candidate_id", "key_id", "correct", "total", "percentage")


def shown_marks(df):
    """The maps as text, in their order."""
    entries = {c: F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])) for c in ("marked_answers", "marked_drawing")}
    return df.withColumns({c: F.array_join(e, ";") for c, e in entries.items()})


@query(
    "a7_marking_report",
    f"""WITH {SCORES},
  shown AS (SELECT candidate_id, string_agg(question || '=' || mark, ';' ORDER BY question) AS t FROM marks GROUP BY 1),
  dshown AS (SELECT candidate_id, string_agg(question || '=' || mark, ';' ORDER BY question) AS t FROM dmarks GROUP BY 1)
  SELECT m.submission_id, m.candidate_id, coalesce(c.candidate_name, '') AS candidate_name, coalesce(c.candidate_number, '') AS candidate_number,
    a.t AS marked_answers, d.t AS marked_drawing, s.correct, s.total, {PCT.replace('correct', 's.correct').replace('total', 's.total')} AS percentage,
    count(*) OVER (PARTITION BY m.submission_id) AS total_candidates, row_number() OVER (PARTITION BY m.submission_id ORDER BY m.candidate_id) AS n
  FROM matched m JOIN v_cand c ON c.candidate_id = m.candidate_id LEFT JOIN scored s ON s.candidate_id = m.candidate_id
  LEFT JOIN shown a ON a.candidate_id = m.candidate_id LEFT JOIN dshown d ON d.candidate_id = m.candidate_id""",
)
def _(i):
    sheets = i.cand.select("candidate_id", "submission_id", "paper_type", "candidate_name", "candidate_number")
    return shown_marks(marking.marking_report(sheets, keys(i), i.key, i.ans, i.dkey, i.draw))


# --- marking by request ----------------------------------------------------------------------------------------

REASON = """CASE WHEN b.submission_id IS NULL THEN 'Submission not found' WHEN b.status <> 'completed' THEN 'Submission not yet completed'
    WHEN {stored} <> 0 AND NOT EXISTS (SELECT 1 FROM v_keyq k WHERE k.key_id = q.key_id) THEN 'Answer key not found'
    WHEN coalesce({stored}, 0) = 0 AND NOT {given} THEN 'Provide answer_key_id or answer_key'
    WHEN NOT EXISTS (SELECT 1 FROM v_sheet s WHERE s.submission_id = q.submission_id) THEN 'No candidate results found for this submission' END AS reason"""
GIVEN = "(q.given_id % 2 = 0 AND EXISTS (SELECT 1 FROM v_keyq k WHERE k.key_id = q.given_id))"


def by_request_sql(key_id, where, n="", stored="q.key_id"):
    """results<n>: marks and score of each candidate of the requests."""
    return f"""r{n} AS (SELECT q.request_id, q.submission_id, {key_id} AS kid, {REASON.format(given=GIVEN, stored=stored)} FROM v_req q LEFT JOIN v_sub b ON b.submission_id = q.submission_id WHERE {where}),
  asked{n} AS (SELECT r.request_id, r.submission_id, r.kid, s.candidate_id FROM r{n} r JOIN v_sheet s ON s.submission_id = r.submission_id WHERE r.reason IS NULL),
  marks{n} AS (SELECT m.request_id, m.candidate_id, k.question, {MARK} AS mark FROM asked{n} m JOIN v_keyq k ON k.key_id = m.kid
    LEFT JOIN v_ans a ON a.candidate_id = m.candidate_id AND a.question = k.question),
  dmarks{n} AS (SELECT m.request_id, m.candidate_id, k.question, {DMARK} AS mark FROM asked{n} m JOIN v_keydq k ON k.key_id = m.kid
    LEFT JOIN v_draw d ON d.candidate_id = m.candidate_id AND d.question = k.question),
  shown{n} AS (SELECT request_id, candidate_id, string_agg(question || '=' || mark, ';' ORDER BY question) AS t FROM marks{n} GROUP BY ALL),
  dshown{n} AS (SELECT request_id, candidate_id, string_agg(question || '=' || mark, ';' ORDER BY question) AS t FROM dmarks{n} GROUP BY ALL),
  scored{n} AS (SELECT request_id, candidate_id, CAST(count(*) FILTER (WHERE mark = 'P') AS BIGINT) AS correct, count(*) AS total
    FROM (SELECT * FROM marks{n} UNION ALL SELECT * FROM dmarks{n}) GROUP BY ALL),
  results{n} AS (SELECT m.request_id, m.submission_id, m.candidate_id, a.t AS marked_answers, d.t AS marked_drawing, s.correct, s.total, {PCT} AS percentage FROM asked{n} m
    JOIN scored{n} s ON s.request_id = m.request_id AND s.candidate_id = m.candidate_id LEFT JOIN shown{n} a ON a.request_id = m.request_id AND a.candidate_id = m.candidate_id
    LEFT JOIN dshown{n} d ON d.request_id = m.request_id AND d.candidate_id = m.candidate_id)"""


def given_requests(i):
    """Requests with the keys that are given with them: of every second part, where it has one."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("question").cast("string").alias("q"), F.col("v"))))

    def maps(df, value, name):
        return df.select(F.col("key_id").alias("given_id"), "question", F.col(value).alias("v")).groupBy("given_id").agg(F.map_from_entries(entries).alias(name))

    some = i.req.filter("given_id % 2 = 0").select("request_id", "given_id")
    told = some.join(maps(i.keyq, "correct", "answer_key"), "given_id", "left").join(maps(i.keydq, "expected", "drawing_key"), "given_id", "left")
    return i.req.drop("given_id").join(told.drop("given_id"), "request_id", "left")


def by_request(i, wanted):
    made = requests.marked_by_request(wanted, i.sub, i.sheet.select("candidate_id", "submission_id"), i.keyq, i.keydq, i.ans, i.draw)
    return made.select("request_id", "submission_id", "candidate_id", "marked_answers", "marked_drawing", "correct", "total", "percentage")


@query(
    "x4_requests",
    f"""WITH r AS (SELECT q.request_id, {REASON.format(given=GIVEN, stored="q.key_id")} FROM v_req q LEFT JOIN v_sub b ON b.submission_id = q.submission_id)
  SELECT request_id, reason, reason IS NULL AS ready FROM r""",
)
def _(i):
    return requests.checked_requests(given_requests(i), i.sub, i.keyq, i.sheet).select("request_id", "reason", "ready")


@query("x4_mark_by_key_id", f"WITH {by_request_sql('q.key_id', 'q.key_id <> 0')} SELECT * FROM results")
def _(i):
    wanted = i.req.filter("key_id <> 0").select("request_id", "submission_id", "key_id", *[F.lit(None).cast("map<string,string>").alias(c) for c in ("answer_key", "drawing_key")])
    return shown_marks(by_request(i, wanted))


@query("x4_mark_inline", f"WITH {by_request_sql('q.given_id', 'coalesce(q.key_id, 0) = 0')} SELECT * FROM results")
def _(i):
    return shown_marks(by_request(i, given_requests(i).filter("coalesce(key_id, 0) = 0")))


@query(
    "x4_stored_marks",
    f"""WITH {by_request_sql('q.given_id', "b.status = 'completed' AND q.given_id % 2 = 0", stored="CAST(NULL AS BIGINT)")},
  {by_request_sql('q.key_id', 'q.key_id <> 0', '2')}
  SELECT s.candidate_id, s.submission_id, s.paper_type, coalesce(n.marked_answers, o.marked_answers) AS marked_answers,
    CASE WHEN n.candidate_id IS NOT NULL THEN n.marked_drawing ELSE o.marked_drawing END AS marked_drawing,
    coalesce(n.correct, o.correct) AS correct, coalesce(n.total, o.total) AS total, coalesce(n.percentage, o.percentage) AS percentage
  FROM v_sheet s LEFT JOIN results o ON o.candidate_id = s.candidate_id LEFT JOIN results2 n ON n.candidate_id = s.candidate_id""",
)
def _(i):
    """Candidates are stored, marked against given keys, and marked again against stored ones where a request names one."""
    folder = new_path(i.spark, "marked-candidates")
    results.append_by_submission(i.sheet, folder)
    first = given_requests(i).withColumn("key_id", F.lit(None).cast("bigint")).join(listing.with_status(i.sub, listing.COMPLETED).select("submission_id"), "submission_id")
    second = i.req.filter("key_id <> 0").select("request_id", "submission_id", "key_id", *[F.lit(None).cast("map<string,string>").alias(c) for c in ("answer_key", "drawing_key")])
    for wanted in (first, second):
        stored.upsert(i.spark, folder, by_request(i, wanted).drop("request_id"))
    columns = ["candidate_id", "submission_id", "paper_type", "marked_answers", "marked_drawing", "correct", "total", "percentage"]
    return shown_marks(stored.read_stored(i.spark, folder).select(*columns))


@query(
    "x4_marked_candidates",
    f"""WITH {SCORES} SELECT m.candidate_id, m.submission_id, m.key_id, m.match_kind, s.correct, s.total, {PCT.replace('correct', 's.correct').replace('total', 's.total')} AS percentage
  FROM matched m LEFT JOIN scored s ON s.candidate_id = m.candidate_id""",
)
def _(i):
    return scored(i).select("candidate_id", "submission_id", "key_id", "match_kind", "correct", "total", "percentage")


@query(
    "x4_mark_submissions",
    f"""WITH {SCORES} SELECT x.candidate_id, s.submission_id, x.correct, x.total, {PCT} AS percentage FROM scored x JOIN v_sheet s ON s.candidate_id = x.candidate_id
  JOIN v_sub b ON b.submission_id = s.submission_id WHERE b.status = 'completed'""",
)
def _(i):
    ready = listing.completed_gate(i.sub).filter("ready").select("submission_id")
    sheets = i.sheet.join(ready, "submission_id")
    out = marking.marked_candidates(sheets, keys(i), i.key, i.ans, i.dkey, i.draw)
    return out.filter(F.col("key_id").isNotNull()).select("candidate_id", "submission_id", "correct", "total", "percentage")


@query(
    "a19_key_sizes",
    """SELECT key_id, CAST(len(json_keys(answers_json)) + coalesce(len(json_keys(drawing_json)), 0) AS BIGINT) AS total_questions FROM v_keydef""",
)
def _(i):
    return reports.key_rows(i.keydef).select("key_id", "total_questions")


@query(
    "f30_answer_key_rows",
    """SELECT key_id, name, paper_type, '1=' || substring(p_type, 1, 1) || ';2=B;' || CAST(p_size AS VARCHAR) || 'x=C' AS answers,
    CASE WHEN p_size % 3 = 0 THEN '31=circle;32=' || p_name END AS drawing_key, CAST(CASE WHEN p_size % 3 = 0 THEN 5 ELSE 3 END AS BIGINT) AS total_questions
  FROM v_keydef JOIN part ON p_partkey = key_id""",
)
def _(i):
    rows = reports.key_rows(i.keydef)
    entries = F.array_join(F.transform(F.map_entries("answers"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return rows.select("key_id", "name", "paper_type", entries.alias("answers"), shown_map(F.col("drawing_key")).alias("drawing_key"), "total_questions")
