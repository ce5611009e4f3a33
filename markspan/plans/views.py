"""Answer-sheet shaped views over the given tables, in SQL that Spark and the second engine both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from markspan.session import spread
from markspan.sources.tables import TABLES, read_table

_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"
_CODE = (
    "CASE max({c}) % 8 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'E' "
    "WHEN 5 THEN 'BL' WHEN 6 THEN 'IN' ELSE 'DR' END"
)

VIEWS: dict[str, str] = {
    # exams, documents, outputs
    "v_exam": """SELECT p_partkey AS exam_id, p_name || ' ' || p_brand AS name FROM part""",
    "v_doc": """SELECT l_orderkey * 8 + l_linenumber AS document_id, max(l_partkey) AS exam_id, max(l_returnflag) AS country,
        'uploads/' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '.pdf' AS file_path
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_json": """SELECT o_orderkey AS json_id, o_custkey AS exam_id, 'exam_' || CAST(o_custkey AS STRING) || '_doc_' ||
        CAST(o_orderkey AS STRING) || '.json' AS filename, o_orderdate AS created_at FROM orders""",
    # submissions and candidate sheets
    "v_sub": """SELECT c.c_custkey AS submission_id, c.c_name || '.pdf' AS filename,
        CASE c.c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
        o.created_at, coalesce(o.pages_count, CAST(0 AS BIGINT)) AS pages_count
        FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at, count(*) AS pages_count
        FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""",
    "v_sheet": """SELECT o_orderkey AS candidate_id, o_custkey AS submission_id,
        CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN NULL
        WHEN o_orderkey % 3 = 0 THEN '  ' || lower(o_orderpriority) ELSE o_orderpriority END AS paper_type FROM orders""",
    "v_cand": """SELECT o.o_orderkey AS candidate_id, o.o_custkey AS submission_id,
        CASE WHEN o.o_orderkey % 9 = 0 THEN '' ELSE c.c_name END AS candidate_name,
        CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(o.o_orderkey AS STRING) END AS candidate_number,
        n.n_name AS country,
        CASE WHEN o.o_orderkey % 13 = 0 THEN '' WHEN o.o_orderkey % 17 = 0 THEN NULL
        WHEN o.o_orderkey % 3 = 0 THEN '  ' || lower(o.o_orderpriority) ELSE o.o_orderpriority END AS paper_type,
        CASE WHEN o.o_orderkey % 7 = 0 THEN 'Zone ' || o.o_orderstatus END AS zone,
        CASE WHEN o.o_orderkey % 10 = 0 THEN 'Alt ' || CAST(o.o_orderkey AS STRING) END AS student_name,
        CASE WHEN o.o_orderkey % 22 = 0 THEN 'N' || CAST(o.o_orderkey AS STRING) END AS candidate_no
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    # answers
    "v_ans": f"""SELECT l_orderkey AS candidate_id, CAST(l_linenumber AS BIGINT) AS question,
        {_CODE.format(c="l_partkey")} AS answer FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_focus": f"""SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS question,
        {_CODE.format(c="l_suppkey")} AS answer FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_draw": """SELECT l_orderkey AS candidate_id, CAST(30 + l_linenumber AS BIGINT) AS question,
        CASE max(l_suppkey) % 5 WHEN 0 THEN '' WHEN 1 THEN 'a Circle' WHEN 2 THEN 'big TRIANGLE with three corners'
        WHEN 3 THEN '   ' ELSE 'a long description of a curve that keeps rising slowly and then suddenly falls again '
        || CAST(l_orderkey AS STRING) END AS response
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_raw": """SELECT candidate_id, question,
        CASE question % 3 WHEN 0 THEN 'Q0' || CAST(question AS STRING) WHEN 1 THEN CAST(question AS STRING)
        ELSE ' question ' || CAST(question AS STRING) END AS raw_key,
        CASE (candidate_id + question) % 13 WHEN 0 THEN lower(answer) WHEN 1 THEN '(' || answer || ')' WHEN 2 THEN 'A and C'
        WHEN 3 THEN 'no answer' WHEN 4 THEN 'Unclear' WHEN 5 THEN '99990' WHEN 6 THEN 'sketch of a circle'
        WHEN 7 THEN NULL WHEN 8 THEN ' ' WHEN 9 THEN 'CORRECT: ' || answer WHEN 10 THEN answer || answer
        WHEN 11 THEN 'Black' ELSE answer END AS raw_value FROM v_ans""",
    "v_key": """SELECT * FROM (VALUES
        (CAST(1 AS BIGINT), 'URGENT', CAST(1 AS BIGINT), 'D'), (1, 'URGENT', 2, 'B'), (1, 'URGENT', 3, 'a'),
        (2, 'HIGH', 1, 'A'), (2, 'HIGH', 2, 'C'), (2, 'HIGH', 3, 'E'), (2, 'HIGH', 4, 'B'),
        (3, '3-medium ', 1, 'B'), (3, '3-medium ', 2, 'A'), (3, '3-medium ', 3, 'C'), (3, '3-medium ', 4, 'D'),
        (3, '3-medium ', 5, 'E'), (3, '3-medium ', 6, 'B'), (3, '3-medium ', 7, 'A'), (3, '3-medium ', 8, 'B'),
        (3, '3-medium ', 9, 'A'), (3, '3-medium ', 10, 'C'), (3, '3-medium ', 11, 'D'), (3, '3-medium ', 12, 'E'),
        (3, '3-medium ', 13, 'B'), (3, '3-medium ', 14, 'A'), (3, '3-medium ', 15, 'B'), (3, '3-medium ', 16, 'A'),
        (4, '4-NOT SPECIFIED', 1, 'C'), (5, '', 1, 'A'),
        (6, 'urgent', 1, 'C'), (6, 'urgent', 2, 'C'), (6, 'urgent', 3, 'B'), (6, 'urgent', 4, 'E')
        ) AS t(key_id, paper_type, question, correct)""",
    "v_dkey": """SELECT * FROM (VALUES (CAST(2 AS BIGINT), CAST(36 AS BIGINT), 'circle'), (2, 37, 'triangle'),
        (6, 36, ''), (4, 37, 'Circle')) AS t(key_id, question, expected)""",
    "v_keydef": """SELECT p_partkey AS key_id, 'Key ' || p_name AS name, p_brand AS paper_type,
        '{"1": "' || substring(p_type, 1, 1) || '", "2": "B", "' || CAST(p_size AS STRING) || 'x": "C"}' AS answers_json,
        CASE WHEN p_size % 3 = 0 THEN '{"31": "circle", "32": "' || p_name || '"}' END AS drawing_json FROM part""",
    # one key per part, and requests to mark
    "v_keyq": """SELECT l_partkey AS key_id, CAST(l_linenumber AS BIGINT) AS question, CASE (l_partkey * 7 + l_linenumber * 3) % 5 WHEN 0 THEN 'A'
        WHEN 1 THEN 'b' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'E' END AS correct FROM lineitem GROUP BY l_partkey, l_linenumber""",
    "v_keydq": """SELECT l_partkey AS key_id, CAST(30 + l_linenumber AS BIGINT) AS question, CASE l_partkey % 3 WHEN 0 THEN 'circle' WHEN 1 THEN 'Triangle'
        ELSE '' END AS expected FROM lineitem WHERE l_partkey % 4 < 2 AND l_linenumber < 4 GROUP BY l_partkey, l_linenumber""",
    "v_req": """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 50 = 6 THEN -c_custkey ELSE c_custkey END AS submission_id,
        CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS BIGINT) WHEN 2 THEN -c_custkey ELSE 1 + (c_custkey * 13) % (SELECT max(p_partkey) FROM part) END AS key_id,
        1 + (c_custkey * 17) % (SELECT max(p_partkey) FROM part) AS given_id FROM customer""",
    # formats
    "v_fmt": """SELECT * FROM (VALUES ('f0', 'mcq', '1-4'), ('f0', 'numeric', '5-6'), ('f0', 'drawing', '7-7'),
        ('f1', 'mcq', '5-1'), ('f1', 'drawing', '5-6'), ('f2', 'numeric', 'x-3'), ('f3', 'mcq', '1-2'),
        ('f3', 'numeric', '2-3')) AS t(format_id, q_type, q_range)""",
    "v_fmtpart": """SELECT CAST(p_partkey AS STRING) AS format_id, 'mcq' AS q_type,
        CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS STRING) || '-1' WHEN p_partkey % 7 = 0 THEN 'x-3'
        ELSE ' 1 - ' || CAST(p_size AS STRING) END AS q_range FROM part
        UNION ALL SELECT CAST(p_partkey AS STRING), 'numeric', CAST(p_size AS STRING) || '-' || CAST(p_size + 4 AS STRING)
        FROM part WHERE p_partkey % 3 > 0
        UNION ALL SELECT CAST(p_partkey AS STRING), 'drawing', CAST(p_size + 3 AS STRING) || '-' || CAST(p_size + 6 AS STRING)
        FROM part WHERE p_partkey % 4 = 0""",
    "v_fmtresp": """SELECT CAST(p_partkey AS STRING) AS format_id, CASE p_partkey % 6
        WHEN 0 THEN '{"header_fields": [{"key": "zone", "label": "Zone"}], "mcq_range": {"start": 1, "end": ' || CAST(p_size AS STRING) ||
          '}, "numeric_range": "31-35", "drawing_range": null, "answer_options": ["A", "B", "C", "D", "E"], "total_questions": ' ||
          CAST(p_size + 5 AS STRING) || ', "description": "' || p_type || '"}'
        WHEN 1 THEN '```json' || chr(10) || '{"mcq_range": "1-' || CAST(p_size AS STRING) || '"}' || chr(10) || '```'
        WHEN 2 THEN '{"mcq_range": {}, "numeric_range": {"end": 9}, "drawing_range": {"start": 40, "end": 44}}'
        WHEN 3 THEN '{"mcq_range": "a-b"}' WHEN 4 THEN 'I cannot see a sheet' ELSE '{"mcq_range": {"end": ' || CAST(p_size AS STRING) || '}}' END
        AS response FROM part""",
    # processing log
    "v_log": f"""SELECT event_id AS id, user_id AS submission_id,
        CASE event_type WHEN 'signup' THEN 'upload' WHEN 'click' THEN 'extract_start' WHEN 'view' THEN 'page_progress'
        WHEN 'purchase' THEN 'extract_complete' ELSE 'extract_error' END AS action,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'info' ELSE 'success' END AS status,
        CASE WHEN event_id % 10 = 0 THEN '' ELSE 'event ' || CAST(event_id AS STRING) END AS message,
        CASE event_type WHEN 'view' THEN CASE {_K} % 7
          WHEN 0 THEN '{{"page": ' || CAST({_K} AS STRING) || ', "total": 100, "progress": 0.' || lpad(CAST({_K} AS STRING), 2, '0') || ', "label": "Cand ' || CAST({_K} AS STRING) || '"}}'
          WHEN 1 THEN '{{"current": ' || CAST({_K} AS STRING) || ', "total": 80}}'
          WHEN 2 THEN '{{"page": ' || CAST({_K} AS STRING) || ', "candidate_name": "  N ' || CAST({_K} AS STRING) || ' "}}'
          WHEN 3 THEN '{{"current": ' || CAST({_K} AS STRING) || ', "progress": ' || CAST({_K} + 2 AS STRING) || '}}'
          WHEN 4 THEN '{{"page": "x", "current": "' || CAST({_K} AS STRING) || '"}}'
          WHEN 5 THEN '{{}}' ELSE '{{"page": ' || CAST({_K} AS STRING) || '}}' END
        WHEN 'purchase' THEN '{{"candidate_count": ' || CAST({_K} % 3 AS STRING) || ', "answers_count": ' || CAST({_K} AS STRING) ||
          ', "drawing_count": "' || CASE WHEN {_K} % 4 = 0 THEN 'n/a' ELSE CAST({_K} % 5 AS STRING) END || '"}}'
        ELSE props END AS extra_data, ts AS created_at FROM events""",
    # measurements
    "v_cell": """SELECT CAST(floor(l_orderkey / 10) AS BIGINT) AS page, l_orderkey % 10 + 1 AS question, CAST(l_linenumber AS BIGINT) AS opt,
        max(l_discount) + 0.0 AS ink_ratio, max(l_tax) + 0.0 AS lower_ink FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_reg": """SELECT DISTINCT l_orderkey AS page,
        CASE l_returnflag WHEN 'A' THEN 'header' WHEN 'N' THEN 'answer_grid' ELSE 'drawing_area' END AS region_type,
        CAST((l_linenumber % 3) * 300 AS INT) AS x, CAST((l_linenumber % 2) * 700 AS INT) AS y,
        CAST(100 + (l_linenumber % 3) * 300 AS INT) AS w, CAST(80 + (l_suppkey % 2) * 420 AS INT) AS h,
        1000 AS page_w, 1400 AS page_h FROM lineitem""",
    "v_quality": """SELECT o_orderkey AS page, CASE WHEN o_orderkey % 29 = 0 THEN CAST(0 AS DOUBLE)
        ELSE CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 END AS quality FROM orders""",
    "v_circ": """SELECT l_suppkey AS page, l_partkey % 1600 AS cx, CAST(l_linenumber * 50 AS BIGINT) AS cy FROM lineitem""",
    "v_stat": """SELECT event_id AS page_id, value AS std_dev, CAST(user_id % 10 AS DOUBLE) / 2000 AS ink_ratio,
        CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(event_id % 7 AS DOUBLE) / 3000 END AS edge_ratio FROM events""",
    "v_tok": """SELECT l_suppkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page,
        CASE WHEN l_suppkey % 9 = 0 AND l_linenumber = 1 THEN -1 ELSE (l_partkey % 102) - 1 END AS conf FROM lineitem""",
    "v_ocr": """SELECT t.doc_id, t.page, d.created_at, CASE WHEN t.doc_id % 7 = 0 AND t.page = 3 THEN 'unreadable' END AS error,
        'Sheet ' || CAST(t.p AS STRING) || '  lists ' || CAST(t.n AS STRING) || ' marks ' AS text
        FROM (SELECT l_suppkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page, max(l_partkey) AS p, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_linenumber) t
        JOIN (SELECT l_suppkey AS doc_id, max(l_shipdate) AS created_at FROM lineitem GROUP BY l_suppkey) d ON d.doc_id = t.doc_id""",
    "v_pagefmt": """SELECT o_orderkey AS page, CASE WHEN o_orderkey % 5 = 4 THEN 'none' ELSE 'f' || CAST(o_orderkey % 5 AS STRING) END AS format_id
        FROM orders""",
    # files and text
    "v_file": """SELECT page_id AS file_id, url || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.png'
        ELSE ' copy.pdf' END AS path, CAST(length(html) AS BIGINT) * 9000 AS size_bytes FROM pages""",
    "v_text": """SELECT candidate_id AS doc_id, concat_ws('; ',
        max(CASE WHEN question = 1 THEN 'Q1: ' || answer END), max(CASE WHEN question = 2 THEN '2) ' || lower(answer) END),
        max(CASE WHEN question = 3 THEN 'Question 3 - ' || answer END), max(CASE WHEN question = 4 THEN '4. ' || answer END),
        max(CASE WHEN question = 5 THEN '01. ' || answer || '; 1. ' || answer END),
        max(CASE WHEN question = 6 THEN 'FREE RESPONSE 6: text ' || answer END),
        max(CASE WHEN question = 7 THEN 'Essay question 7 - more ' || answer END)) AS text FROM v_ans GROUP BY candidate_id""",
    "v_resp": """SELECT c.candidate_id, CASE c.candidate_id % 5 WHEN 0 THEN '```json' || chr(10) || b.body || chr(10) || '```'
        WHEN 1 THEN b.body WHEN 2 THEN 'Here is the result: ' || b.body || ' Done.' WHEN 3 THEN substring(b.body, 1, 40)
        ELSE '  [' || b.body || ']  ' END AS response, b.body
        FROM v_sheet c JOIN (SELECT candidate_id, '{"student_name": "' || CASE WHEN candidate_id % 4 = 0 THEN '' ELSE 'S' ||
        CAST(candidate_id AS STRING) END || '", "name": "N' || CAST(candidate_id AS STRING) || '", "candidate_no": ' ||
        CASE WHEN candidate_id % 6 = 0 THEN 'null' ELSE CAST(candidate_id AS STRING) END || ', "candidate_number": "' ||
        CASE WHEN candidate_id % 3 = 0 THEN '' ELSE 'C' || CAST(candidate_id AS STRING) END || '", "centre": " K' ||
        CAST(candidate_id % 5 AS STRING) || ' ", "zone": "Z' || CAST(candidate_id % 5 AS STRING) || '", "desk_no": ' ||
        CASE WHEN candidate_id % 2 = 0 THEN 'null' ELSE '7' END || ', "confidence": 0.9, "answers": {' || concat_ws(', ',
        max(CASE WHEN question = 1 THEN '"1": "' || answer || '"' END), max(CASE WHEN question = 2 THEN '"Q2": "' || answer || '"' END),
        max(CASE WHEN question = 3 THEN '"3": null' END), max(CASE WHEN question = 4 THEN '"4": 42' END),
        max(CASE WHEN question = 5 THEN '"05": "' || answer || '"' END), max(CASE WHEN question = 6 THEN '"question 6": "' || answer || '"' END),
        max(CASE WHEN question = 7 THEN '"7": "' || answer || '"' END)) || '}}' AS body
        FROM v_ans GROUP BY candidate_id) b ON b.candidate_id = c.candidate_id""",
    "v_legacy": """SELECT candidate_id AS submission_id, '{"multiple_choice": [' || concat_ws(', ',
        max(CASE WHEN question = 1 THEN '{"question": 1, "answer": "' || answer || '"}' END),
        max(CASE WHEN question = 2 THEN '{"question": 2, "answer": "' || answer || '"}' END), max(CASE WHEN question = 3 THEN '{"question": 3, "answer": "' || answer || '"}' END),
        max(CASE WHEN question = 4 THEN '{"question": 4, "answer": "' || answer || '"}' END), max(CASE WHEN question = 5 THEN '{"question": 5, "answer": "' || answer || '"}' END)) || '], "free_response": [' || concat_ws(', ',
        max(CASE WHEN question = 6 THEN '{"question": 6, "response": "some  words ' || answer || '"}' END),
        max(CASE WHEN question = 7 THEN '{"question": 7, "response": "' || answer || '"}' END)) || ']}' AS document
        FROM v_ans GROUP BY candidate_id""",
    "v_docpage": """SELECT conv_id AS doc_id, turn AS page FROM conversations""",
}

# The pixel view needs array functions, which the two engines write differently.
PIXELS = {
    "spark": """SELECT vec_id AS page_id, label, 8 AS width, 8 AS height, transform(embedding, v -> CAST(least(255, greatest(0,
        floor(CAST(v AS DOUBLE) * CASE WHEN vec_id % 5 = 0 THEN 60 ELSE 400 END + 128))) AS INT)) AS pixels FROM embeddings""",
    "oracle": """SELECT vec_id AS page_id, label, 8 AS width, 8 AS height, list_transform(embedding, lambda v: CAST(least(255, greatest(0,
        floor(CAST(v AS DOUBLE) * CASE WHEN vec_id % 5 = 0 THEN 60 ELSE 400 END + 128))) AS INT)) AS pixels FROM embeddings""",
}


def _with(names: list[str], dialect: str) -> str:
    """A WITH clause holding the named views and the views they use."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        body = PIXELS[dialect] if name == "v_page" else VIEWS[name]
        for dep in re.findall(r"\bv_[a-z]+\b", body):
            if dep != name:
                add(dep)
        ordered.append(name)

    for n in names:
        add(n)
    bodies = {n: PIXELS[dialect] if n == "v_page" else VIEWS[n] for n in ordered}
    return "WITH " + ",\n".join(f"{n} AS ({bodies[n]})" for n in ordered) if ordered else ""


def oracle(body: str) -> str:
    """Equivalent SQL with the views its text mentions in front; the text may bring further CTEs of its own."""
    known = set(VIEWS) | {"v_page"}
    names = [n for n in dict.fromkeys(re.findall(r"\bv_[a-z]+\b", body)) if n in known]
    clause = _with(names, "oracle")
    text = body.strip()
    if not clause:
        return text
    if text[:5].upper() == "WITH ":
        return f"{clause},\n{text[5:]}"
    return f"{clause}\n{text}"


class Inputs:
    """The given tables of one folder, and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def view(self, name: str) -> DataFrame:
        clause = _with([name], "spark")
        for t in TABLES:
            if re.search(rf"\b{t}\b", clause):
                rows = self.table(t)
                # The lines of an order meet once, for the grouping of the view and all later work on the sheet.
                by_order = t == "lineitem" and "GROUP BY l_orderkey, l_linenumber" in clause
                (spread(rows, "l_orderkey") if by_order else rows).createOrReplaceTempView(t)
        return self.spark.sql(f"{clause}\nSELECT * FROM {name}")

    def stream(self, name: str) -> DataFrame:
        """A view over one table that is read as a stream of files."""
        clause = _with([name], "spark")
        for t in TABLES:
            if re.search(rf"\b{t}\b", clause):
                # a pattern, because a stream takes a table that is one plain file only that way
                path = f"{self.folder.rstrip('/')}/{t}[.]parquet"
                rows = self.spark.readStream.schema(self.table(t).schema).parquet(path)
                rows.createOrReplaceTempView(t)
        return self.spark.sql(f"{clause}\nSELECT * FROM {name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.view(f"v_{name}")
