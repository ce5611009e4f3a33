"""Queries over raw answers, headers and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from markspan.functions import codes, modeljson
from markspan.operators import listing, normalize, ordered, reports
from markspan.plans.page_flow import NO_OBJECT
from markspan.plans.registry import query, shown_map

OPTS = "('A', 'B', 'C', 'D', 'E')"
BLANKS = "('', 'BL', 'BLANK', 'EMPTY', 'NONE', 'NO ANSWER', 'N/A', 'NA', 'UNANSWERED', 'NULL')"
BAD = "('IN', 'INVALID', 'MULTIPLE', 'MULTI', 'MULTI-MARK', 'UNCLEAR', 'ILLEGIBLE', 'AMBIGUOUS')"


def _u(v: str) -> str:
    return f"upper(trim({v}))"


def _tok(v: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({_u(v)}, '[^A-Z0-9]+'), lambda t: t IN {OPTS}))"


def _let(v: str) -> str:
    return f"list_distinct(list_filter(string_split(regexp_replace({_u(v)}, '[^A-Z]', '', 'g'), ''), lambda t: t IN {OPTS}))"


def mcq_sql(v: str) -> str:
    return (
        f"CASE WHEN {v} IS NULL OR {_u(v)} IN {BLANKS} THEN 'BL' WHEN {_u(v)} IN {BAD} THEN 'IN' "
        f"WHEN len({_tok(v)}) = 1 THEN {_tok(v)}[1] WHEN len({_tok(v)}) > 1 THEN 'IN' "
        f"WHEN len({_let(v)}) = 1 THEN {_let(v)}[1] ELSE 'IN' END"
    )


def looks_sql(v: str) -> str:
    return (
        f"({v} IS NULL OR {_u(v)} IN {BLANKS} OR {_u(v)} IN {BAD} OR len({_tok(v)}) > 0 "
        f"OR regexp_full_match(regexp_replace({_u(v)}, '[^A-Z]', '', 'g'), '[A-E]+'))"
    )


def open_sql(v: str) -> str:
    return f"CASE WHEN {v} IS NULL OR {_u(v)} IN {BLANKS} THEN 'BL' WHEN {_u(v)} IN {BAD} THEN 'IN' ELSE trim({v}) END"


def drawing_sql(v: str) -> str:
    return (
        f"CASE WHEN {v} IS NULL OR {_u(v)} IN {BLANKS} THEN 'BL' WHEN {_u(v)} IN {BAD} THEN 'IN' "
        rf"WHEN regexp_matches({_u(v)}, '\b(DRAW|DRAWING|SKETCH|DIAGRAM|GRAPH|FIGURE|SHAPE|DR)\b') THEN 'DR' ELSE trim({v}) END"
    )


def key_sql(v: str) -> str:
    return (
        f"CASE WHEN regexp_extract({v}, '[0-9]+', 0) <> '' THEN CAST(CAST(regexp_extract({v}, '[0-9]+', 0) AS BIGINT) AS VARCHAR) "
        f"WHEN trim({v}) <> '' THEN trim({v}) END"
    )


# arg_max skips null values, so the last raw value is looked up by its position.
KEYED = (
    f"numbered AS (SELECT candidate_id, {key_sql('raw_key')} AS qk, raw_value, row_number() OVER (PARTITION BY candidate_id, "
    f"{key_sql('raw_key')} ORDER BY question DESC) AS rn FROM v_raw), "
    "keyed AS (SELECT candidate_id, qk AS question, raw_value AS v FROM numbered WHERE rn = 1 AND qk IS NOT NULL)"
)
RANGES = """bounds AS (SELECT format_id, q_type, TRY_CAST(trim(split_part(q_range, '-', 1)) AS BIGINT) AS a,
    TRY_CAST(trim(split_part(q_range, '-', 2)) AS BIGINT) AS b FROM {src}),
  asked AS (SELECT format_id, q_type, unnest(range(least(a, b), greatest(a, b) + 1)) AS q FROM bounds WHERE a IS NOT NULL AND b IS NOT NULL),
  expected AS (SELECT format_id, CAST(q AS VARCHAR) AS question,
    arg_max(q_type, CASE q_type WHEN 'mcq' THEN 0 WHEN 'drawing' THEN 2 ELSE 1 END) AS q_type FROM asked GROUP BY 1, 2)"""


def keyed_raw(i):
    return normalize.keyed_answers(i.raw, ["candidate_id"], "raw_key", "raw_value", "question")


def sheet_formats(i):
    return i.pagefmt.withColumnRenamed("page", "candidate_id")


@query("f1_question_key", f"SELECT candidate_id, question, {key_sql('raw_key')} AS question_key FROM v_raw")
def _(i):
    return i.raw.select("candidate_id", "question", codes.question_key(F.col("raw_key")).alias("question_key"))


@query(
    "f2_blank_invalid_tokens",
    f"SELECT candidate_id, question, coalesce({_u('raw_value')} IN {BLANKS}, FALSE) AS is_blank, "
    f"coalesce({_u('raw_value')} IN {BAD}, FALSE) AS is_invalid FROM v_raw",
)
def _(i):
    v = F.col("raw_value")
    return i.raw.select(
        "candidate_id",
        "question",
        F.coalesce(codes.is_blank_token(v), F.lit(False)).alias("is_blank"),
        F.coalesce(codes.is_invalid_token(v), F.lit(False)).alias("is_invalid"),
    )


for _name, _expr, _sql in (
    ("f3_looks_like_mcq", codes.looks_like_mcq, looks_sql),
    ("f4_mcq_answer", codes.mcq_answer, mcq_sql),
    ("f5_open_answer", codes.open_answer, open_sql),
    ("f6_drawing_answer", codes.drawing_answer, drawing_sql),
):

    @query(_name, f"SELECT candidate_id, question, {_sql('raw_value')} AS result FROM v_raw")
    def _(i, expr=_expr):
        return i.raw.select("candidate_id", "question", expr(F.col("raw_value")).alias("result"))


@query(
    "f7_normalised_answers",
    f"""WITH {KEYED}, {RANGES.format(src='v_fmt')},
  wanted AS (SELECT s.page AS candidate_id, e.question, e.q_type FROM v_pagefmt s JOIN expected e ON e.format_id = s.format_id)
  SELECT coalesce(w.candidate_id, k.candidate_id) AS candidate_id, coalesce(w.question, k.question) AS question,
    CASE WHEN w.q_type = 'mcq' THEN {mcq_sql('k.v')} WHEN w.q_type = 'drawing' THEN {drawing_sql('k.v')}
         WHEN w.q_type IS NOT NULL THEN {open_sql('k.v')} WHEN {looks_sql('k.v')} THEN {mcq_sql('k.v')} ELSE {open_sql('k.v')} END AS answer
  FROM wanted w FULL JOIN keyed k ON k.candidate_id = w.candidate_id AND k.question = w.question""",
)
def _(i):
    return normalize.normalise_answers(keyed_raw(i), sheet_formats(i), normalize.expected_questions(i.fmt)).drop("q_type")


@query(
    "f8_range_parse",
    """WITH p AS (SELECT format_id, q_type, TRY_CAST(trim(split_part(q_range, '-', 1)) AS BIGINT) AS a,
    TRY_CAST(trim(split_part(q_range, '-', 2)) AS BIGINT) AS b FROM v_fmtpart)
  SELECT format_id, q_type, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END AS range_start,
    CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END AS range_end,
    CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CAST(least(a, b) AS VARCHAR) || '-' || CAST(greatest(a, b) AS VARCHAR) END AS printed FROM p""",
)
def _(i):
    return normalize.parse_ranges(i.fmtpart).select(
        "format_id", "q_type", F.col("start").alias("range_start"), F.col("end").alias("range_end"), "printed"
    )


@query("u3_expected_questions", f"WITH {RANGES.format(src='v_fmtpart')} SELECT format_id, question, q_type FROM expected")
def _(i):
    return normalize.expected_questions(i.fmtpart)


@query(
    "u4_answers_outside_ranges",
    f"""WITH {KEYED}, {RANGES.format(src='v_fmt')}
  SELECT k.candidate_id, k.question, k.v AS raw_value FROM keyed k JOIN v_pagefmt s ON s.page = k.candidate_id
  WHERE NOT EXISTS (SELECT 1 FROM expected e WHERE e.format_id = s.format_id AND e.question = k.question)""",
)
def _(i):
    out = normalize.outside_ranges(keyed_raw(i), sheet_formats(i), normalize.expected_questions(i.fmt))
    return out.select("candidate_id", "question", F.col("value").alias("raw_value"))


@query(
    "f9_format_records",
    """SELECT CAST(p_partkey AS VARCHAR) AS format_id,
    CASE WHEN p_partkey % 6 IN (0, 1, 5) THEN CAST(1 AS BIGINT) END AS mcq_start, CASE WHEN p_partkey % 6 IN (0, 1, 5) THEN CAST(p_size AS BIGINT) END AS mcq_end,
    CASE p_partkey % 6 WHEN 0 THEN CAST(31 AS BIGINT) WHEN 3 THEN 1 WHEN 4 THEN 1 END AS numeric_start,
    CASE p_partkey % 6 WHEN 0 THEN CAST(35 AS BIGINT) WHEN 3 THEN 20 WHEN 4 THEN 20 END AS numeric_end,
    CASE p_partkey % 6 WHEN 2 THEN CAST(40 AS BIGINT) END AS drawing_start, CASE p_partkey % 6 WHEN 2 THEN CAST(44 AS BIGINT) END AS drawing_end,
    CASE p_partkey % 6 WHEN 0 THEN 'A,B,C,D,E' ELSE 'A,B,C,D' END AS answer_options,
    CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size + 5 AS BIGINT) WHEN p_partkey % 6 IN (3, 4) THEN 20 ELSE 30 END AS total_questions,
    CASE WHEN p_partkey % 6 = 0 THEN p_type WHEN p_partkey % 6 IN (3, 4) THEN 'Fallback format' ELSE 'Unknown format' END AS description,
    CASE WHEN p_partkey % 6 = 0 THEN 'zone' WHEN p_partkey % 6 IN (3, 4) THEN 'candidate_number,candidate_name' ELSE '' END AS header_keys
  FROM part""",
)
def _(i):
    f = normalize.parse_format_responses(i.fmtresp)
    return f.withColumn("answer_options", F.array_join("answer_options", ",")).withColumn(
        "header_keys", F.array_join(F.transform("header_fields", lambda h: h["key"]), ",")
    ).drop("header_fields")


@query(
    "f10_json_recovery",
    f"""SELECT candidate_id, candidate_id % 5 <> 3 AS recovered,
    CASE WHEN candidate_id % 5 <> 3 THEN json_extract_string(body, '$.name') END AS name,
    CASE WHEN candidate_id % 5 = 3 THEN '{NO_OBJECT}' END AS error FROM v_resp""",
)
def _(i):
    obj = i.resp.select("candidate_id", modeljson.object_text(F.col("response")).alias("o"))
    ok = F.col("o").isNotNull()
    return obj.select(
        "candidate_id", ok.alias("recovered"), F.get_json_object("o", "$.name").alias("name"),
        F.when(~ok, F.lit(NO_OBJECT)).alias("error"),
    )


def _fields(i):
    obj = i.resp.select("candidate_id", modeljson.object_text(F.col("response")).alias("o")).filter(F.col("o").isNotNull())
    return obj.select("candidate_id", modeljson.text_map(F.col("o")).alias("fields"))


BODY = "WITH b AS (SELECT candidate_id, body FROM v_resp WHERE candidate_id % 5 <> 3) "


@query(
    "p10_header_aliases",
    BODY
    + """SELECT candidate_id, nullif(trim(json_extract_string(body, '$.name')), '') AS candidate_name,
    coalesce(nullif(trim(json_extract_string(body, '$.candidate_number')), ''), nullif(trim(json_extract_string(body, '$.candidate_no')), '')) AS candidate_number,
    nullif(trim(json_extract_string(body, '$.centre')), '') AS country, CAST(NULL AS VARCHAR) AS paper_type FROM b""",
)
def _(i):
    return normalize.resolve_headers(_fields(i), "fields").drop("fields")


@query(
    "p11_alias_folding",
    BODY
    + """SELECT candidate_id, coalesce(nullif(json_extract_string(body, '$.student_name'), ''), json_extract_string(body, '$.name')) AS candidate_name,
    coalesce(json_extract_string(body, '$.candidate_no'), json_extract_string(body, '$.candidate_number')) AS candidate_number,
    '' AS country, '' AS paper_type FROM b""",
)
def _(i):
    return normalize.fold_aliases(_fields(i), "fields").drop("fields")


@query(
    "p12_dynamic_fields",
    BODY
    + """SELECT candidate_id, 'centre=' || json_extract_string(body, '$.centre') || ';desk_no=' || coalesce(json_extract_string(body, '$.desk_no'), '') ||
    ';zone=' || json_extract_string(body, '$.zone') AS stored_extra,
    concat_ws(';', 'confidence=0.9', 'desk_no=' || json_extract_string(body, '$.desk_no'), 'zone=' || json_extract_string(body, '$.zone')) AS read_extra FROM b""",
)
def _(i):
    return _fields(i).select(
        "candidate_id",
        shown_map(normalize.extra_fields(F.col("fields"))).alias("stored_extra"),
        shown_map(normalize.extra_after_read(F.col("fields"))).alias("read_extra"),
    )


def with_extra(cand):
    """Candidates with an overflow map holding what their sheet has."""
    pairs = [F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (
        ("zone", F.col("zone")), ("student_name", F.col("student_name")), ("candidate_no", F.col("candidate_no")),
        ("confidence", F.lit("0.9")),
    )]
    return cand.withColumn("extra_fields", F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["v"].isNotNull())))


@query(
    "p13_read_cleaning",
    """SELECT candidate_id, coalesce(nullif(candidate_name, ''), student_name, '') AS candidate_name,
    coalesce(candidate_number, candidate_no, '') AS candidate_number, country, coalesce(paper_type, '') AS paper_type,
    nullif(concat_ws(';', 'candidate_no=' || candidate_no, 'student_name=' || student_name, 'zone=' || zone), '') AS extra FROM v_cand""",
)
def _(i):
    out = normalize.clean_for_read(with_extra(i.cand))
    return out.select(
        "candidate_id", "candidate_name", "candidate_number", "country", "paper_type", shown_map(F.col("extra_fields")).alias("extra")
    )


@query(
    "p14_stored_codes",
    """WITH s AS (SELECT candidate_id, question, coalesce(trim(raw_value), '') AS t FROM v_raw),
  c AS (SELECT candidate_id, question, CASE WHEN t = '' THEN 'BL' WHEN upper(t) IN ('A', 'B', 'C', 'D', 'E', 'BL', 'IN', 'DR') THEN upper(t) ELSE t END AS answer FROM s)
  SELECT *, CASE WHEN answer = 'DR' THEN 'DR' END AS drawing FROM c""",
)
def _(i):
    return normalize.stored_answers(i.raw, "raw_value").select("candidate_id", "question", "answer", "drawing")


@query(
    "a16_ordered_answer_map",
    f"""WITH {KEYED} SELECT candidate_id, string_agg(CASE WHEN question = '6' THEN 'essay' ELSE question END || '=' || {open_sql('v')}, ','
    ORDER BY question = '6', CAST(question AS BIGINT)) AS answers FROM keyed GROUP BY 1""",
)
def _(i):
    named = F.when(F.col("question") == "6", F.lit("essay")).otherwise(F.col("question")).alias("question")
    rows = keyed_raw(i).select("candidate_id", named, codes.open_answer(F.col("value")).alias("answer"))
    maps = normalize.answer_maps(rows, ["candidate_id"])
    text = F.transform(F.map_entries("answers"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return maps.select("candidate_id", F.array_join(text, ",").alias("answers"))


@query(
    "a3_drawing_answers",
    "SELECT candidate_id, CAST(count(*) FILTER (WHERE upper(trim(raw_value)) = 'DR') AS BIGINT) AS drawings, count(*) AS answers FROM v_raw GROUP BY 1",
)
def _(i):
    is_dr = codes.folded(F.col("raw_value")) == codes.DRAWING
    return i.raw.groupBy("candidate_id").agg(F.count_if(is_dr).alias("drawings"), F.count(F.lit(1)).alias("answers"))


@query(
    "a17_quality_gauge",
    """SELECT candidate_id, CAST(count(*) FILTER (WHERE answer = 'BL') AS BIGINT) AS blank,
    CAST(count(*) FILTER (WHERE answer = 'IN') AS BIGINT) AS invalid, count(*) AS total FROM v_ans GROUP BY 1""",
)
def _(i):
    return reports.quality_gauge(i.ans, ["candidate_id"])


@query("a5_answer_distribution", "SELECT coalesce(raw_value, 'null') AS answer, count(*) AS n FROM v_raw GROUP BY 1")
def _(i):
    return reports.answer_distribution(i.raw.select(F.coalesce("raw_value", F.lit("null")).alias("answer")))


@query(
    "t4_question_order",
    """WITH k AS (SELECT candidate_id, CASE WHEN question >= 6 THEN 'part ' || answer || CAST(question AS VARCHAR)
    ELSE CAST(question * 9 AS VARCHAR) END AS question FROM v_ans)
  SELECT candidate_id, question, row_number() OVER (PARTITION BY candidate_id ORDER BY CASE WHEN regexp_full_match(question, '[0-9]+') THEN 0 ELSE 1 END,
    TRY_CAST(question AS BIGINT), question) AS position FROM k""",
)
def _(i):
    q = F.col("question")
    key = F.when(q >= 6, F.concat(F.lit("part "), F.col("answer"), q.cast("string"))).otherwise((q * 9).cast("string"))
    rows = listing.with_question_order(i.ans.select("candidate_id", key.alias("question")))
    order = [F.col("order_kind"), F.col("order_number"), F.col("question")]
    return ordered.number_rows(rows, ["candidate_id"], order, "position").select("candidate_id", "question", "position")


DRAWN = "drawn AS (SELECT candidate_id, question - 30 AS question FROM v_draw WHERE trim(response) <> '')"


def drawn(i):
    return i.draw.filter(codes.strip(F.col("response")) != "").select("candidate_id", (F.col("question") - 30).alias("question"))


@query(
    "u1_drawing_overlay",
    f"""WITH {DRAWN} SELECT candidate_id, question, 'DR' AS answer FROM drawn
  UNION ALL SELECT a.candidate_id, a.question, a.answer FROM v_ans a WHERE NOT EXISTS
    (SELECT 1 FROM drawn d WHERE d.candidate_id = a.candidate_id AND d.question = a.question)""",
)
def _(i):
    return normalize.overlay_drawings(i.ans, drawn(i))
