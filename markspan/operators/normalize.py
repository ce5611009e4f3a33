"""From raw answer and header maps to canonical long rows and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.functions import codes
from markspan.functions.modeljson import format_struct, format_text
from markspan.functions.text import first_text, json_text
from markspan.session import spread

# Header keys that mean the same column, in order of preference, and keys that are not header data.
READ_ALIASES = {
    "candidate_name": ("candidate_name", "name", "student_name"),
    "candidate_number": ("candidate_number", "candidate_id", "candidate_no", "student_number", "id"),
    "country": ("country", "centre", "center"),
    "paper_type": ("paper_type", "paper"),
}
WRITE_ALIASES = {
    "candidate_no": "candidate_number",
    "candidate_id": "candidate_number",
    "name": "candidate_name",
    "student_name": "candidate_name",
    "student_number": "candidate_number",
}
HEADER_COLUMNS = ("candidate_name", "candidate_number", "country", "paper_type")
INTERNAL_KEYS = ("page_number", "answers", "drawing_questions", "extra_fields", "confidence", "is_blank")

# Later types override earlier ones where ranges overlap.
TYPE_PRIORITY = {"mcq": 0, "numeric": 1, "drawing": 2}


# --- question ranges -------------------------------------------------------------------------------------------


def range_bounds(text: Column) -> tuple[Column, Column]:
    """Repaired (start, end) of "a-b" text; both null unless both parse."""
    a = codes.strip(F.split_part(text, F.lit("-"), F.lit(1))).try_cast("bigint")
    b = codes.strip(F.split_part(text, F.lit("-"), F.lit(2))).try_cast("bigint")
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.least(a, b)), F.when(both, F.greatest(a, b))


def parse_ranges(formats: DataFrame) -> DataFrame:
    """Add start, end and the printed form to rows of (format_id, q_type, q_range)."""
    start, end = range_bounds(F.col("q_range"))
    return formats.withColumn("start", start).withColumn("end", end).withColumn(
        "printed", F.when(F.col("start").isNotNull(), F.concat_ws("-", "start", "end"))
    )


def expected_questions(formats: DataFrame) -> DataFrame:
    """One row per (format_id, question) with the type that wins where typed ranges overlap.

    Only ranges are shuffled: each one gives its questions but for those that a stronger range of its format holds, so that no
    two rows meet again."""
    ranges = parse_ranges(formats).filter(F.col("start").isNotNull())
    rank = F.when(F.col("q_type") == "mcq", 0).when(F.col("q_type") == "drawing", 2).otherwise(1)
    held = ranges.select("format_id", F.struct(rank.alias("rank"), "q_type", "start", "end").alias("r"))
    sets = spread(held, "format_id").groupBy("format_id").agg(F.collect_set("r").alias("all"))
    one = sets.select("format_id", "all", F.explode("all").alias("r"))
    stronger = F.filter("all", lambda o: (o > F.col("r")) & (o["start"] <= F.col("r.end")) & (o["end"] >= F.col("r.start")))
    rows = one.select("format_id", "r", stronger.alias("stronger")).select(
        "format_id", "r.q_type", "stronger", F.explode(F.sequence("r.start", "r.end")).alias("q")
    )
    mine = ~F.exists("stronger", lambda o: F.col("q").between(o["start"], o["end"]))
    return rows.filter(mine).select("format_id", F.col("q").cast("string").alias("question"), "q_type")


def parse_format_responses(df: DataFrame, response: str = "response", format_id: str = "format_id") -> DataFrame:
    """Typed format rows from model responses; what cannot be parsed becomes the fallback format."""
    spec = df.withColumn("__f", format_struct(format_text(F.col(response))))

    def bounds(field: str, start_default: int | None, end_default: int | None):
        raw = F.col(f"__f.{field}")
        is_obj = raw.startswith("{")
        start, end = json_text(raw, "start"), json_text(raw, "end")
        usable = F.lit(True) if start_default is not None else (F.coalesce(start, F.lit("0")) != "0")
        texts = F.when(is_obj, F.struct(F.coalesce(start, F.lit(start_default).cast("string")).alias("s"),
                                        F.coalesce(end, F.lit(end_default).cast("string")).alias("e"))).when(
            F.contains(raw, F.lit("-")),
            F.struct(F.split_part(raw, F.lit("-"), F.lit(1)).alias("s"), F.split_part(raw, F.lit("-"), F.lit(2)).alias("e")),
        )
        present = raw.isNotNull() & (raw != "") & (raw != "{}") & texts.isNotNull() & F.when(is_obj, usable).otherwise(F.lit(True))
        s = codes.strip(texts["s"]).try_cast("bigint")
        e = codes.strip(texts["e"]).try_cast("bigint")
        broken = present & ~is_obj & (s.isNull() | e.isNull())
        return F.when(present, s), F.when(present, e), F.coalesce(broken, F.lit(False))

    mcq, numeric, drawing = bounds("mcq_range", 1, 30), bounds("numeric_range", None, None), bounds("drawing_range", None, None)
    parsed = F.coalesce(F.col("__f").isNotNull() & format_text(F.col(response)).endswith("}"), F.lit(False))
    ok = parsed & ~mcq[2] & ~numeric[2] & ~drawing[2]
    fallback = fallback_format()
    pick = {
        "header_fields": F.coalesce(F.col("__f.header_fields"), F.array().cast("array<struct<key:string,label:string>>")),
        "mcq_start": mcq[0], "mcq_end": mcq[1],
        "numeric_start": numeric[0], "numeric_end": numeric[1],
        "drawing_start": drawing[0], "drawing_end": drawing[1],
        "answer_options": F.coalesce(F.col("__f.answer_options"), F.array(*[F.lit(o) for o in "ABCD"])),
        "total_questions": F.coalesce(F.col("__f.total_questions"), F.lit(30).cast("bigint")),
        "description": F.coalesce(F.col("__f.description"), F.lit("Unknown format")),
    }
    return spec.select(format_id, *[F.when(ok, v).otherwise(fallback[k]).alias(k) for k, v in pick.items()])


# The format of pages whose layout could not be described.
def fallback_format() -> dict[str, Column]:
    """The format used when detection fails: written answers 1-20."""
    none = F.lit(None).cast("bigint")
    return {
        "header_fields": F.array(
            F.struct(F.lit("candidate_number").alias("key"), F.lit("Candidate Number").alias("label")),
            F.struct(F.lit("candidate_name").alias("key"), F.lit("Candidate Name").alias("label")),
        ),
        "mcq_start": none, "mcq_end": none,
        "numeric_start": F.lit(1).cast("bigint"), "numeric_end": F.lit(20).cast("bigint"),
        "drawing_start": none, "drawing_end": none,
        "answer_options": F.array(*[F.lit(o) for o in "ABCD"]),
        "total_questions": F.lit(20).cast("bigint"),
        "description": F.lit("Fallback format"),
    }


def format_ranges(formats: DataFrame) -> DataFrame:
    """Wide format rows as long (format_id, q_type, q_range)."""
    texts = [
        F.struct(F.lit(t).alias("q_type"), F.concat_ws("-", f"{t}_start", f"{t}_end").alias("q_range"))
        for t in TYPE_PRIORITY
    ]
    return formats.select("format_id", F.inline(F.array(*texts))).filter(F.col("q_range") != "")


# --- answers ---------------------------------------------------------------------------------------------------


def keyed_answers(raw: DataFrame, ids: Sequence[str], key: str, value: str, order: str) -> DataFrame:
    """Canonical question keys; of several raw keys with one meaning the last in source order is kept."""
    keyed = raw.withColumn("question", codes.question_key(F.col(key))).filter(F.col("question").isNotNull())
    return keyed.groupBy(*ids, "question").agg(F.max_by(value, order).alias("value"))


def normalise_answers(keyed: DataFrame, sheets: DataFrame, expected: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """Every expected question of each sheet, missing ones blank, plus the answers outside all ranges.

    `sheets` holds (id, format_id) and optionally `options`; `expected` comes from `expected_questions`. The work is
    spread by (id, question), so one huge sheet or format does not end up in one task."""
    options = F.col("options") if "options" in sheets.columns else None
    carried = [id_col, "options"] if options is not None else [id_col]
    wanted = sheets.join(expected, "format_id").select(*carried, "question", "q_type")
    if options is not None:
        keyed = keyed.join(sheets.select(*carried), id_col, "left").withColumnRenamed("options", "__options")
    joined = wanted.join(keyed, [id_col, "question"], "full_outer")
    if options is not None:
        options = F.coalesce("options", "__options")
    answer = codes.typed_answer(F.col("value"), F.col("q_type"), options)
    return joined.select(id_col, "question", answer.alias("answer"), F.col("q_type"))


def outside_ranges(keyed: DataFrame, sheets: DataFrame, expected: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """Answers whose question is in none of the sheet's ranges."""
    return keyed.join(sheets.select(id_col, "format_id"), id_col).join(expected, ["format_id", "question"], "left_anti")


def answer_maps(answers: DataFrame, ids: Sequence[str], everyone: DataFrame | None = None) -> DataFrame:
    """One ordered map per sheet, of rows with unique questions: numbers first in number order, then other keys as text.

    With `everyone` (the ids of all sheets) a sheet without answers has an empty map."""
    rows = answers.select(*ids, "question", "answer")
    if everyone is not None:
        nothing = F.lit(None).cast("string")
        rows = rows.unionByName(everyone.select(*ids, nothing.alias("question"), nothing.alias("answer")))
    number = F.when(F.col("question").rlike("^[0-9]+$"), F.col("question").try_cast("decimal(38,0)"))
    entry = F.struct(number.isNull().alias("text"), number.alias("n"), F.col("question").alias("key"), F.col("answer").alias("value"))
    nested = rows.groupBy(*ids).agg(F.array_sort(F.collect_list(F.when(F.col("question").isNotNull(), entry))).alias("__e"))
    entries = F.transform("__e", lambda e: F.struct(e["key"], e["value"]))
    return nested.select(*ids, F.map_from_entries(entries).alias("answers"))


def stored_answers(answers: DataFrame, value: str) -> DataFrame:
    """Codes as stored, with drawings mirrored to their own column."""
    code = codes.stored_answer(F.col(value))
    return answers.withColumn("answer", code).withColumn("drawing", F.when(F.col("answer") == codes.DRAWING, F.lit(codes.DRAWING)))


def overlay_drawings(answers: DataFrame, drawings: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """Answers with every drawing question set to DR; drawings win."""
    rows = answers.select(id_col, "question", "answer", F.lit(0).alias("rank")).unionByName(
        drawings.select(id_col, "question", F.lit(codes.DRAWING).alias("answer"), F.lit(1).alias("rank"))
    )
    return rows.groupBy(id_col, "question").agg(F.max_by("answer", "rank").alias("answer"))


# --- header fields ---------------------------------------------------------------------------------------------


def resolve_headers(df: DataFrame, fields: str) -> DataFrame:
    """The four header columns from a field map, first non-blank alias wins."""
    def resolved(names: Sequence[str]) -> Column:
        return F.coalesce(*[F.nullif(codes.strip(F.col(fields)[n]), F.lit("")) for n in names])

    return df.select("*", *[resolved(names).alias(c) for c, names in READ_ALIASES.items()])


def extra_after_read(fields: Column) -> Column:
    known = ["answers", *[n for names in READ_ALIASES.values() for n in names]]
    return F.map_filter(fields, lambda k, v: ~k.isin(*known) & v.isNotNull())


def fold_aliases(df: DataFrame, fields: str) -> DataFrame:
    """Header columns as written: in field order the first non-empty value wins, else the last empty one."""
    def folded(column: str) -> Column:
        names = [column, *[a for a, c in WRITE_ALIASES.items() if c == column]]
        values = F.transform(F.filter(F.map_entries(F.col(fields)), lambda e: e["key"].isin(*names)), lambda e: e["value"])
        full = F.filter(values, lambda v: v.isNotNull() & (v != ""))
        return (
            F.when(F.size(full) > 0, F.element_at(full, 1))
            .when(F.size(values) > 0, F.element_at(values, -1))
            .otherwise(F.lit(""))
        )

    return df.select("*", *[folded(c).alias(c) for c in HEADER_COLUMNS])


def extra_fields(fields: Column) -> Column:
    """What goes to the overflow map: neither header columns, their aliases nor internal keys; null becomes ''."""
    skip = [*HEADER_COLUMNS, *WRITE_ALIASES, *INTERNAL_KEYS]
    kept = F.map_filter(fields, lambda k, v: ~k.isin(*skip))
    return F.transform_values(kept, lambda k, v: F.coalesce(v, F.lit("")))


def clean_for_read(df: DataFrame, extra: str = "extra_fields") -> DataFrame:
    """Columns as shown: nulls are '', empty names fall back to aliases left in the overflow map."""
    m = F.col(extra)
    shown = F.map_filter(m, lambda k, v: ~k.isin("extra_fields", "confidence", "is_blank") & v.isNotNull() & (v != "{}"))
    return df.withColumns(
        {
            "candidate_name": F.coalesce(first_text(F.col("candidate_name"), m["name"], m["student_name"]), F.lit("")),
            "candidate_number": F.coalesce(
                first_text(F.col("candidate_number"), m["candidate_no"], m["candidate_id"], m["student_number"]), F.lit("")
            ),
            "country": F.coalesce("country", F.lit("")),
            "paper_type": F.coalesce("paper_type", F.lit("")),
            extra: F.when(F.size(shown) > 0, shown),
        }
    )
