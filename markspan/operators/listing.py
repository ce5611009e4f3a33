"""Lookups, listings, searches, joins of stored tables and output projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.functions import codes
from markspan.functions.text import first_text
from markspan.operators.normalize import answer_maps
from markspan.operators.ordered import number_rows

COMPLETED = "completed"


def by_ids(df: DataFrame, **ids: int) -> DataFrame:
    for column, value in ids.items():
        df = df.filter(F.col(column) == value)
    return df


def by_id_pairs(df: DataFrame, wanted: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The rows whose ids, taken together, occur among the wanted ones."""
    return df.join(wanted.select(*ids).distinct(), list(ids), "left_semi")


def with_status(submissions: DataFrame, status: str | None) -> DataFrame:
    return submissions.filter(F.col("status") == status) if status else submissions


def newest_first(df: DataFrame, id_col: str, at: str = "created_at", limit: int | None = None) -> DataFrame:
    out = df.orderBy(F.col(at).desc(), F.col(id_col).desc())
    return out if limit is None else out.limit(limit)


def page_of(df: DataFrame, id_col: str, skip: int = 0, limit: int = 100, status: str | None = None) -> DataFrame:
    """One page of the newest-first listing."""
    return with_status(df, status).orderBy(F.col("created_at").desc(), F.col(id_col).desc()).offset(skip).limit(limit)


def completed() -> Column:
    return F.coalesce(F.col("status") == COMPLETED, F.lit(False))


def completed_gate(submissions: DataFrame) -> DataFrame:
    """Whether each submission can be marked or shown, and why not."""
    ready = completed()
    reason = F.concat(F.lit("Submission is "), F.coalesce("status", F.lit("None")), F.lit(", not completed"))
    return submissions.withColumn("ready", ready).withColumn("reason", F.when(~ready, reason))


def candidates_of_submissions(candidates: DataFrame, submissions: DataFrame) -> DataFrame:
    """Candidates with their submission's columns; those whose submission is gone are flagged."""
    known = submissions.withColumn("__known", F.lit(True))
    joined = candidates.join(known, "submission_id", "left")
    return joined.withColumn("submission_missing", F.col("__known").isNull()).drop("__known")


def without_deleted(children: DataFrame, deleted: DataFrame, on: str) -> DataFrame:
    return children.join(deleted.select(on), on, "left_anti")


def deleted_children(children: DataFrame, deleted: DataFrame, on: str) -> DataFrame:
    return children.join(deleted.select(on), on, "left_semi")


def exam_details(exams: DataFrame, documents: DataFrame, jsons: DataFrame) -> DataFrame:
    """Exams with their documents and JSON outputs, in order: rows (exam_id, name, kind, n, id, label, place).

    kind is "document" or "json" and n counts from 1 within it; an exam without either has one row of kind null. Each child is
    one row, so that an exam of any size stays spread."""
    def children(df: DataFrame, kind: str, key: str, label: str, place: Column) -> DataFrame:
        return df.select("exam_id", F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(label).alias("label"), place.alias("place"))

    both = children(documents, "document", "document_id", "country", F.col("file_path")).unionByName(
        children(jsons, "json", "json_id", "filename", F.lit(None).cast("string"))
    )
    numbered = number_rows(both, ["exam_id", "kind"], [F.col("id")], "n")
    return exams.join(numbered, "exam_id", "left").select(*exams.columns, "kind", "n", "id", "label", "place")


def search(candidates: DataFrame, term: str, columns: Sequence[str], extra: str | None = "extra_fields") -> DataFrame:
    """Candidates with the term in any column or overflow value, ignoring case; a blank term keeps all."""
    if not term.strip():
        return candidates
    needle = F.lit(term.lower())
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), needle)
    if extra:
        values = F.coalesce(F.map_values(extra), F.array().cast("array<string>"))
        hit = hit | F.exists(values, lambda v: F.contains(F.lower(F.coalesce(v, F.lit("null"))), needle))
    return candidates.filter(hit)


def with_question_order(answers: DataFrame, key: str = "question") -> DataFrame:
    """Columns to sort by: numbers first in number order, then text."""
    kind, number, _ = codes.order_columns(F.col(key))
    return answers.withColumn("order_kind", kind).withColumn("order_number", number)


def candidate_json(candidates: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The candidate object without its page number, nulls written out."""
    kept = [c for c in columns if c != "page_number"]
    return candidates.withColumn("json", F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}))


def minimal_output(candidates: DataFrame, answers: DataFrame, aliases: Sequence[str] = ("candidate_number",)) -> DataFrame:
    """Answers (drawings already overlaid), candidate number and paper type only."""
    maps = answer_maps(answers, ["candidate_id"], everyone=candidates.select("candidate_id"))
    joined = candidates.select("candidate_id", "paper_type", *aliases).join(maps, "candidate_id")
    return joined.select(
        "candidate_id",
        "answers",
        F.coalesce(first_text(*[F.col(a) for a in aliases]), F.lit("")).alias("candidate_number"),
        F.coalesce("paper_type", F.lit("")).alias("paper_type"),
    )


def flat_output(candidates: DataFrame, extra: str = "extra_fields") -> DataFrame:
    """Header fields and overflow fields in one map; an overflow field replaces a header field of the same name and
    an empty paper type is left out."""
    base = F.map_from_entries(
        F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in ("candidate_name", "candidate_number", "country", "paper_type")])
    )
    over = F.coalesce(F.col(extra), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(
        base,
        lambda k, v: ~F.array_contains(F.map_keys(over), k) & ((k != "paper_type") | (F.coalesce(v, F.lit("")) != "")),
    )
    return candidates.withColumn("fields", F.map_concat(kept, over))
