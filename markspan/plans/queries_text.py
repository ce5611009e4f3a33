"""Queries over recognised text, documents and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from markspan.functions import text
from markspan.operators import textparse
from markspan.plans.registry import query
from markspan.session import spread
from markspan.sources import intake

# Written out, so that the SQL does not depend on the patterns under test.
_P = [
    r"(?i)Q[uestion]*\s*(\d+)\s*[:\-\)\.]*\s*([A-E])",
    r"(?i)(\d+)\s*[:\-\)\.]\s*([A-E])",
    r"(?i)Question\s+(\d+)\s*[:\-]*\s*([A-E])",
]
CHOICES = "hits AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {r} AS rank, unnest(regexp_extract_all(text, '{p}', 1)) AS digits, upper(unnest(regexp_extract_all(text, '{p}', 2))) AS answer, "
    f"unnest(range(len(regexp_extract_all(text, '{p}', 1)))) AS pos FROM {{src}}"
    for r, p in enumerate(_P)
) + """), kept AS (SELECT doc_id, CAST(digits AS BIGINT) AS question, answer FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, digits ORDER BY rank, pos) AS rn FROM hits) WHERE rn = 1)"""
RESPONSES = r"""pieces AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '(?i)(FREE\s+RESPONSE|ESSAY|SHORT\s+ANSWER)', chr(1), 'g'), chr(1))[2:]) AS piece FROM v_text),
  resp AS (SELECT doc_id, CAST(regexp_extract(piece, '(?is)^\s+(?:QUESTION\s+)?(\d+)\s*[:\-]?\s*(.*)$', 1) AS BIGINT) AS question,
    trim(regexp_extract(piece, '(?is)^\s+(?:QUESTION\s+)?(\d+)\s*[:\-]?\s*(.*)$', 2)) AS response FROM pieces WHERE regexp_matches(piece, '(?is)^\s+(?:QUESTION\s+)?\d+'))"""


@query("f11_choice_extraction", "WITH " + CHOICES.format(src="v_text") + " SELECT doc_id, question, answer FROM kept")
def _(i):
    return textparse.choices(i.text)


@query("f11_choices_in_documents", "WITH " + CHOICES.format(src="documents") + " SELECT doc_id, question, answer FROM kept")
def _(i):
    return textparse.choices(i.table("documents"))


@query(
    "w8_keep_first",
    "WITH " + CHOICES.format(src="v_text") + """ SELECT doc_id, digits, answer FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, digits ORDER BY rank, pos) AS rn FROM hits) WHERE rn = 1""",
)
def _(i):
    found = []
    for rank, pattern in enumerate(_P):
        pairs = F.arrays_zip(
            F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("digits"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("answer"),
        )
        rows = i.text.select("doc_id", F.lit(rank).alias("rank"), F.posexplode(pairs).alias("pos", "p"))
        found.append(rows.select("doc_id", "rank", "pos", "p.digits", F.upper("p.answer").alias("answer")))
    hits = found[0].unionByName(found[1]).unionByName(found[2])
    return textparse.keep_first(hits, ["doc_id", "digits"], ["rank", "pos"], "answer")


@query("f12_response_sections", f"WITH {RESPONSES} SELECT doc_id, question, response FROM resp WHERE response <> ''")
def _(i):
    return textparse.responses(i.text)


@query(
    "u5_all_answers",
    "WITH " + CHOICES.format(src="v_text") + f""", {RESPONSES} SELECT doc_id, question, answer AS value, 'multiple_choice' AS kind FROM kept
  UNION ALL SELECT doc_id, question, response, 'free_response' FROM resp WHERE response <> ''""",
)
def _(i):
    return textparse.all_answers(i.text)


@query(
    "p16_legacy_rows",
    """SELECT candidate_id AS submission_id, 'multiple_choice' AS kind, question, answer AS value, CAST(NULL AS INTEGER) AS word_count FROM v_ans WHERE question <= 5
  UNION ALL SELECT candidate_id, 'free_response', question, CASE question WHEN 6 THEN 'some  words ' || answer ELSE answer END, CASE question WHEN 6 THEN 3 ELSE 1 END FROM v_ans WHERE question IN (6, 7)""",
)
def _(i):
    return textparse.legacy_rows(i.legacy, "submission_id", "document")


@query(
    "u6_distinct_in_order",
    r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents)
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(word) ORDER BY pos) AS rn FROM w) WHERE rn = 1""",
)
def _(i):
    # Texts are dealt out whole, once; their words take many times the room.
    words = spread(i.table("documents").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return textparse.distinct_in_order(words, ["doc_id"], "word", "pos")


@query(
    "f13_word_count",
    r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '')) AS INTEGER) AS words FROM documents",
)
def _(i):
    return i.table("documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query(
    "f17_preview",
    """SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview,
    CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS short_preview FROM documents""",
)
def _(i):
    return i.table("documents").select(
        "doc_id", text.preview(F.col("text")).alias("preview"), text.preview(F.col("text"), text.SHORT_PREVIEW_CHARS).alias("short_preview")
    )


# --- files -----------------------------------------------------------------------------------------------------


@query(
    "s1_intake_manifest",
    """SELECT file_id, path, size_bytes, lower(path) LIKE '%.pdf' AND size_bytes <= 52428800 AS accepted,
    CASE WHEN NOT lower(path) LIKE '%.pdf' THEN 'Only PDF files are allowed' WHEN size_bytes > 52428800 THEN 'File size must be less than 50MB' END AS reject_reason FROM v_file""",
)
def _(i):
    return intake.check_files(i.file)


@query("s6_files_under_prefix", "SELECT file_id, path FROM v_file WHERE path LIKE 'https://%'")
def _(i):
    return intake.under_prefix(i.file, "https://").select("file_id", "path")


NAME = "regexp_extract(rtrim(path, '/'), '[^/]*$', 0)"
STEM = f"CASE WHEN regexp_matches({NAME}, '.\\.[^.]+$') THEN regexp_replace({NAME}, '\\.[^.]+$', '') ELSE {NAME} END"


@query(
    "f14_safe_tokens",
    """WITH t AS (SELECT file_id, trim(regexp_replace(trim(path), '[^A-Za-z0-9._-]+', '_', 'g'), '._-') AS x FROM v_file)
  SELECT file_id, left(CASE WHEN x = '' THEN 'unknown' ELSE x END, 80) AS token FROM t""",
)
def _(i):
    return i.file.select("file_id", text.safe_token(F.col("path")).alias("token"))


@query(
    "f15_file_names",
    f"""SELECT file_id, replace({NAME}, ' ', '_') AS safe_name, {STEM} AS stem,
    'run' || CAST(file_id AS VARCHAR) || '_' || replace({STEM}, ' ', '_') || '.json' AS stored_name FROM v_file""",
)
def _(i):
    run = F.concat(F.lit("run"), F.col("file_id").cast("string"))
    return i.file.select(
        "file_id",
        text.safe_name(F.col("path")).alias("safe_name"),
        text.stem(F.col("path")).alias("stem"),
        text.stored_name(F.col("path"), run, "json").alias("stored_name"),
    )


@query(
    "s7_archive_keys",
    f"""SELECT s.submission_id, 'archive/' || strftime(s.created_at, '%Y/%m/%d') || '/submission_' || CAST(s.submission_id AS VARCHAR) || '/' ||
    replace(s.filename, '.pdf', '') || '/' || {NAME.replace('path', 'f.path')} AS archive_key FROM v_sub s JOIN v_file f ON f.file_id = s.submission_id WHERE s.created_at IS NOT NULL""",
)
def _(i):
    joined = i.sub.filter(F.col("created_at").isNotNull()).join(i.file, F.col("file_id") == F.col("submission_id"))
    key = intake.archive_key("archive", F.col("created_at"), F.col("submission_id"), F.col("filename"), F.col("path"))
    return joined.select("submission_id", key.alias("archive_key"))
