"""Personal data in texts: patterns propose spans, checksums confirm them, context words move the score.

Column expressions only. Positions come from the text between the matches: splitting by a pattern and extracting its
matches walk over the text alike, so running sums of both lengths give each match its place in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.llm.common import let, running_sums


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _count_between(c: Column, low: int, high: int) -> Column:
    return F.length(_digits(c)).between(low, high)


def luhn(c: Column) -> Column:
    return F.call_function("luhn_check", _digits(c))


def mod97(c: Column) -> Column:
    """The ISO 13616 check: first four characters last, letters as 10 to 35, remainder 1."""
    plain = F.regexp_replace(c, "[^0-9A-Z]", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(step(acc, ch))) == 1


# Octets up to 255 with any leading zeros.
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """`pattern` must not match the empty text. `hint` is a text that every match contains, `needs` a cheap pattern that
    every text with a match has. A base kind keeps every confirmed span; others need a score of THRESHOLD."""

    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    score: float
    context: str
    needs: str
    base: bool = True
    mask: str = ""


THRESHOLD = 0.7
CONTEXT_GAIN = 0.3
BEFORE, AFTER = 48, 24  # code points of context

# Possessive runs that start where a run starts (or where the last match ended) propose the same spans as the plain
# patterns, in time linear in the text.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda c: F.lit(True),
        0.9,
        r"mail|contact|kontakt|correo|courriel",
        "@",
        mask="[EMAIL]",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda c: c.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        0.6,
        r"\bip\b|address|host|server|adresse",
        r"[0-9]\.[0-9]",
        mask="[IP]",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda c: _count_between(c, 12, 19) & luhn(c),
        0.7,
        r"card|visa|credit|debit|karte|tarjeta|carte",
        r"[0-9][\x20-]?[0-9]",
        mask="[CARD]",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda c: _count_between(c, 9, 15),
        0.6,
        r"phone|call|mobile|fax|\btel|telefon",
        r"\+[0-9]",
        mask="[PHONE]",
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
        mod97,
        0.6,
        r"iban|account|konto|cuenta|compte",
        r"[A-Z]{2}[0-9]{2}",
        base=False,
        mask="[IBAN]",
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        lambda c: ~c.rlike(r"^(?:000|666|9)|-00-|-0000$"),
        0.4,
        r"ssn|social security",
        r"[0-9]-[0-9]{2}-[0-9]",
        base=False,
        mask="[SSN]",
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)

# Characters of an IBAN by country, ISO 13616.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|TL",
    24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "PT|ST", 26: "IS|TR", 27: "FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU",
    31: "MT|SC", 32: "LC",
}


def _iban(size: int, countries: str) -> str:
    groups, rest = divmod(size - 4, 4)
    return rf"(?:{countries})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}" + (rf"\x20?[A-Z0-9]{{{rest}}}" if rest else "")


def _whole(kind: Kind) -> Kind:
    """An IBAN has its country's length, whatever follows it, and a passed checksum is enough; context only moves the score."""
    if kind.name != "iban":
        return kind
    return replace(kind, pattern="|".join([*(_iban(n, c) for n, c in IBAN_COUNTRIES.items()), kind.pattern]), score=THRESHOLD)


# What is found and masked. The report's spans are those of KINDS, by its SQL.
FOUND = tuple(map(_whole, KINDS))
NO_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _only_if(text: Column, kind: Kind, found: Column, otherwise: Column) -> Column:
    likely = F.contains(text, F.lit(kind.needs)) if kind.needs == "@" else text.rlike(kind.needs)
    return F.when(likely, found).otherwise(otherwise)


def _around(text: Column, start: Column, hit: Column) -> Column:
    """The text before and after a match, other matches included."""
    size = F.lit(BEFORE).cast("long")
    before = F.substring(text, (F.greatest(start - size, F.lit(0)) + 1).cast("int"), F.least(start, size).cast("int"))
    return F.concat_ws(" ", before, F.substring(text, (start + F.length(hit) + 1).cast("int"), F.lit(AFTER)))


def _starts(hits: Column, gaps: Column) -> Column:
    gap = F.transform(F.slice(gaps, 1, F.size(hits)), lambda g: F.length(g))
    size = F.transform(hits, lambda h: F.length(h))
    return F.zip_with(running_sums(F.zip_with(gap, size, lambda g, s: g + s)), gap, lambda a, g: a + g)


def _gain(near: Column, kind: Kind) -> Column:
    return F.when(F.lower(near).rlike(kind.context), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))


def kind_spans(text: Column, kind: Kind, gaps_only: bool = False) -> Column:
    """Spans of one kind as array of (kind, start, end, score), end exclusive, in code points. Context is the text around a match,
    or with `gaps_only` that up to the next matches of the kind."""
    none = F.array().cast(NO_SPANS)
    one = lambda start, end, score: F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))

    def placed(hits: Column, gaps: Column) -> Column:
        near = F.zip_with(
            F.slice(gaps, 1, F.size(hits)), F.slice(gaps, 2, F.size(hits)), lambda a, b: F.concat_ws(" ", F.right(a, F.lit(BEFORE)), F.left(b, F.lit(AFTER)))
        )
        parts = F.arrays_zip(hits.alias("hit"), _starts(hits, gaps).alias("start"), *([near.alias("near")] if gaps_only else []))
        good = F.filter(parts, lambda p: kind.confirm(p["hit"]))
        gain = lambda p: _gain(p["near"] if gaps_only else _around(text, p["start"], p["hit"]), kind)
        spans = F.transform(good, lambda p: one(p["start"], p["start"] + F.length(p["hit"]), F.least(F.lit(1.0), F.lit(kind.score) + gain(p))))
        return spans if kind.base else F.filter(spans, lambda s: s["score"] >= THRESHOLD)

    def searched(hits: Column) -> Column:
        return F.when(F.size(hits) == 0, none).otherwise(let(F.split(text, kind.pattern, -1), lambda gaps: placed(hits, gaps)))

    return _only_if(text, kind, let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), searched), none)


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column) -> Column:
    """By start, then by the place of the kind in KINDS."""
    places = F.array(*[F.lit(k.name) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(places, s["kind"]).alias("b"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def find_pii(docs: DataFrame) -> DataFrame:
    """Adds `pii`: all spans of the text in order, with scores. A null text has none; other columns stay.

    Each row is handled where it is read: no shuffle, whole texts. A column of the name pii is replaced."""
    return docs.withColumn("pii", let(F.coalesce(F.col("text"), F.lit("")), lambda t: in_order(F.concat(*[kind_spans(t, k) for k in FOUND]))))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, base_sha256, spans (all kinds) and scores, one row per row of docs.

    Its SQL fixes the spans: an IBAN or SSN counts with a context word between it and the next matches of its kind only."""
    found = docs.select("doc_id", let(F.coalesce(F.col("text"), F.lit("")), lambda t: in_order(F.concat(*[kind_spans(t, k, True) for k in KINDS]))).alias("pii"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))

    def of_kind(name: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    return found.select("doc_id", *map(of_kind, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def mask_pii(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind's mask; columns stay, n_chars (if there) follows the new text.

    Kinds are masked one after another in the order of KINDS, each in the text that the ones before have left. A text
    without personal data, a null text included, stays as it is."""

    def masked(text: Column, kind: Kind) -> Column:
        sure = kind.base or kind.score >= THRESHOLD

        def confirmed(row: Column) -> Column:
            near = F.lit(True) if sure else F.lit(kind.score) + _gain(_around(text, row["start"], row["hit"]), kind) >= THRESHOLD
            return kind.confirm(row["hit"]) & near

        def rebuilt(hits: Column, gaps: Column) -> Column:
            rows = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("before"), hits.alias("hit"), *([] if sure else [_starts(hits, gaps).alias("start")]))
            put = F.transform(rows, lambda r: F.concat(r["before"], F.when(confirmed(r), F.lit(kind.mask)).otherwise(r["hit"])))
            return F.concat(F.array_join(put, ""), F.element_at(gaps, -1))

        def searched(hits: Column) -> Column:
            return F.when(F.size(hits) == 0, text).otherwise(let(F.split(text, kind.pattern, -1), lambda gaps: rebuilt(hits, gaps)))

        return _only_if(text, kind, let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), searched), text)

    out = docs
    for kind in FOUND:
        out = out.withColumn("text", masked(F.col("text"), kind))
    if "n_chars" in docs.columns:
        count = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(count, F.col("n_chars")))
    return out.select(*docs.columns)
