"""The answer-code vocabulary and the expressions that fold messy text into it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes and their accepted spellings.
BLANK, INVALID, DRAWING, CORRECT, INCORRECT = "BL", "IN", "DR", "P", "IM"
BLANK_TOKENS = ("", "BL", "BLANK", "EMPTY", "NONE", "NO ANSWER", "N/A", "NA", "UNANSWERED", "NULL")
INVALID_TOKENS = ("IN", "INVALID", "MULTIPLE", "MULTI", "MULTI-MARK", "UNCLEAR", "ILLEGIBLE", "AMBIGUOUS")
DRAWING_WORDS = ("DRAW", "DRAWING", "SKETCH", "DIAGRAM", "GRAPH", "FIGURE", "SHAPE", "DR")
DEFAULT_OPTIONS = ("A", "B", "C", "D", "E")

# Every character that counts as white space at the ends of a value.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

Options = Sequence[str] | Column | None


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def folded(c: Column) -> Column:
    return F.upper(strip(c))


def option_array(options: Options = None) -> Column:
    """Upper-cased options; an empty set falls back to A..E."""
    default = F.array(*[F.lit(o) for o in DEFAULT_OPTIONS])
    if options is None:
        return default
    if isinstance(options, Column):
        kept = F.transform(F.filter(options, lambda o: o != ""), lambda o: F.upper(o))
        return F.when(F.size(kept) > 0, kept).otherwise(default)
    kept = [o.upper() for o in options if o]
    return F.array(*[F.lit(o) for o in kept]) if kept else default


def is_blank_token(c: Column) -> Column:
    return folded(c).isin(*BLANK_TOKENS)


def is_invalid_token(c: Column) -> Column:
    return folded(c).isin(*INVALID_TOKENS)


def _whole_tokens(c: Column) -> Column:
    return F.split(folded(c), "[^A-Z0-9]+")


def _letters(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(folded(c), "[^A-Z]", ""), ""), lambda x: x != "")


def question_key(c: Column) -> Column:
    """First digit run without leading zeros, else the trimmed text; null when nothing is left."""
    digits = F.regexp_extract(c, r"[0-9]+", 0)
    text = strip(c)
    return F.when(digits != "", F.regexp_replace(digits, "^0+(?=[0-9])", "")).when(text != "", text)


def looks_like_mcq(c: Column, options: Options = None) -> Column:
    opts = option_array(options)
    letters = _letters(c)
    return (
        c.isNull()
        | is_blank_token(c)
        | is_invalid_token(c)
        | F.array_contains(opts, folded(c))
        | F.arrays_overlap(_whole_tokens(c), opts)
        | ((F.size(letters) > 0) & (F.size(F.array_except(letters, opts)) == 0))
    )


def mcq_answer(c: Column, options: Options = None) -> Column:
    """One option, BL or IN."""
    opts = option_array(options)
    by_token = F.array_intersect(_whole_tokens(c), opts)
    by_letter = F.array_intersect(_letters(c), opts)
    return (
        F.when(c.isNull() | is_blank_token(c), F.lit(BLANK))
        .when(is_invalid_token(c), F.lit(INVALID))
        .when(F.size(by_token) == 1, F.element_at(by_token, 1))
        .when(F.size(by_token) > 1, F.lit(INVALID))
        .when(F.size(by_letter) == 1, F.element_at(by_letter, 1))
        .otherwise(F.lit(INVALID))
    )


def open_answer(c: Column) -> Column:
    return (
        F.when(c.isNull() | is_blank_token(c), F.lit(BLANK)).when(is_invalid_token(c), F.lit(INVALID)).otherwise(strip(c))
    )


def drawing_answer(c: Column) -> Column:
    value = open_answer(c)
    words = "|".join(DRAWING_WORDS)
    return (
        F.when(value.isin(BLANK, INVALID), value)
        .when(F.upper(value).rlike(rf"\b({words})\b"), F.lit(DRAWING))
        .otherwise(value)
    )


def typed_answer(c: Column, q_type: Column, options: Options = None) -> Column:
    """Normalise by question type; without a type the value itself decides."""
    return (
        F.when(q_type == "mcq", mcq_answer(c, options))
        .when(q_type == "drawing", drawing_answer(c))
        .when(q_type.isNotNull(), open_answer(c))
        .when(looks_like_mcq(c, options), mcq_answer(c, options))
        .otherwise(open_answer(c))
    )


def stored_answer(c: Column) -> Column:
    """The code as stored after extraction: empty is BL, known codes are upper-cased, other text is kept."""
    text = F.coalesce(strip(c), F.lit(""))
    upper = F.upper(text)
    return (
        F.when(text == "", F.lit(BLANK))
        .when(upper.isin(*DEFAULT_OPTIONS, BLANK, INVALID, DRAWING), upper)
        .otherwise(text)
    )


def mark(answer: Column, correct: Column) -> Column:
    """Mark one answer against its key entry."""
    return (
        F.when(answer.isNull(), F.lit(BLANK))
        .when(answer.isin(BLANK, INVALID), answer)
        .when(F.upper(answer) == F.upper(correct), F.lit(CORRECT))
        .otherwise(answer)
    )


def mark_drawing(response: Column, expected: Column) -> Column:
    return (
        F.when(response.isNull() | (strip(response) == ""), F.lit(BLANK))
        .when(F.contains(F.lower(response), F.lower(expected)), F.lit(CORRECT))
        .otherwise(F.lit(INCORRECT))
    )


def percentage(correct: Column, total: Column) -> Column:
    """Half-even to one decimal, 0 when nothing was asked."""
    return F.when(total > 0, F.bround(correct / total * 100, 1)).otherwise(F.lit(0.0))


def order_columns(key: Column) -> list[Column]:
    """Sort keys that put numbers first in number order, then other keys in text order."""
    numeric = key.rlike("^[0-9]+$")
    return [
        F.when(numeric, F.lit(0)).otherwise(F.lit(1)),
        F.when(numeric, key.try_cast("decimal(38,0)")),
        key,
    ]
