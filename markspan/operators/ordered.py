"""Ordered calculations within a group that stay spread over many tasks.

A window over (submission) puts a whole submission into one task. Groups of up to `rows` rows are calculated that way. The rows of
larger groups are range-partitioned by group, order and a tie-break, so that a part holds about `rows` of them however
dense, sparse or equal their orders are; windows run inside the parts, and one row per part and group carries sums, maxima or last
values on. Keys and orders may be null: a null key is a group, a null order comes first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markspan.session import written

ROWS_PER_TASK = 1 << 20

_PART, _VALUE, _BEFORE, _SIZE, _TIE = "__part", "__value", "__before", "__size", "__tie"


def _met(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Equal on all pairs of columns, null equal to null."""
    return reduce(lambda x, y: x & y, [a[left].eqNullSafe(b[right]) for left, right in pairs], F.lit(True))


def _renamed(keys: Sequence[str]) -> list[Column]:
    return [F.col(c).alias(f"__k{k}") for k, c in enumerate(keys)]


def _pairs(keys: Sequence[str]) -> list[tuple[str, str]]:
    return [(c, f"__k{k}") for k, c in enumerate(keys)]


def large_groups(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame | None:
    """(__k0, __k1, ..., __size) of the groups with more than `rows` rows, at most a `rows`th of the rows; None if there are none."""
    found = df.groupBy(*_renamed(keys)).agg(F.count(F.lit(1)).alias(_SIZE)).filter(F.col(_SIZE) > rows)
    found = written(found, "large-groups")
    return None if found.isEmpty() else found


def in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, total: int) -> DataFrame:
    """Rows with __part, which grows along (keys, order) and holds about `rows` of the `total` rows.

    Rows that are equal in all columns share a part. The parts are written, so that each later step sees the same ones."""
    whole = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    told = df.withColumn(_TIE, F.xxhash64(*whole))
    parts = max(2, -(-total // rows))
    ranged = told.repartitionByRange(parts, *[F.asc_nulls_first(c) for c in [*keys, *order]], _TIE)
    return written(ranged.withColumn(_PART, F.spark_partition_id()).drop(_TIE), "parts")


_FOLDS = {"sum": F.sum, "max": F.max, "last": F.last}


def _earlier(kind: str, by: Sequence[str], order: Sequence[str]) -> Column:
    """The sum, maximum or last of _VALUE over the rows before."""
    window = Window.partitionBy(*by).orderBy(*[F.asc_nulls_first(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return _FOLDS[kind](_VALUE).over(window)


def _across(df: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str) -> DataFrame:
    """Add _BEFORE to rows in parts: windows inside (keys, part), and what the parts before hold of the group."""
    inside = df.withColumn("__inside", _earlier(kind, [*keys, _PART], order))
    # The last of a part is that of its largest row; a tie is between equal rows.
    whole = F.max_by(_VALUE, F.struct(*order)) if kind == "last" else _FOLDS[kind](_VALUE)
    totals = df.groupBy(*keys, _PART).agg(whole.alias(_VALUE)).withColumn("__carry", _earlier(kind, keys, [_PART]))
    carried = written(totals.filter(F.col("__carry").isNotNull()).select(*_renamed([*keys, _PART]), "__carry"), "carried")
    both = inside.join(carried, _met(inside, carried, _pairs([*keys, _PART])), "left")
    a, b = F.col("__inside"), F.col("__carry")
    value = {"sum": F.coalesce(a + b, a, b), "max": F.greatest(a, b), "last": F.coalesce(a, b)}[kind]
    return both.withColumn(_BEFORE, value).drop("__inside", "__carry", *[f"__k{k}" for k in range(len(keys) + 1)])


def _fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, kind: str, name: str, result: Column, rows: int, sized: bool = False
) -> DataFrame:
    """Rows with `name`, an expression over _VALUE, _BEFORE and, if `sized`, the group's number of rows _SIZE."""
    orders = [f"__o{k}" for k in range(len(order))]
    told = df.select("*", *[c.alias(n) for c, n in zip(order, orders, strict=True)], value.alias(_VALUE))
    large = large_groups(df, keys, rows)
    small = told if large is None else told.join(large, _met(told, large, _pairs(keys)), "left_anti")
    out = small.withColumn(_BEFORE, _earlier(kind, keys, orders))
    if sized:
        out = out.withColumn(_SIZE, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    if large is not None:
        many = told.join(large, _met(told, large, _pairs(keys))).drop(*[f"__k{k}" for k in range(len(keys))])
        total = large.agg(F.sum(_SIZE)).first()[0]
        out = out.unionByName(_across(in_parts(many, keys, orders, rows, total), keys, orders, kind).select(*out.columns))
    return out.withColumn(name, result).drop(*orders, _VALUE, _BEFORE)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "n", total: str | None = None, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Number the rows of each group from 1; with `total` also the group size."""
    number = F.coalesce(_BEFORE, F.lit(0).cast("long")) + 1
    out = _fold(df, keys, order, F.lit(1).cast("long"), "sum", name, number, rows, sized=total is not None)
    return out.select(*[c for c in out.columns if c != _SIZE], F.col(_SIZE).alias(total)) if total else out


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """The sum of the values of the rows before, 0 at the first."""
    return _fold(df, keys, order, value, "sum", name, F.coalesce(_BEFORE, F.lit(0).cast("long")), rows)


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    return _fold(df, keys, order, value, "max", name, F.greatest(_VALUE, _BEFORE), rows)


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """The value of the row before, also when that row is in an earlier part or its value is null."""
    return _fold(df, keys, order, F.struct(value.alias("v")), "last", name, F.col(f"{_BEFORE}.v"), rows)


def newest_rows_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, name: str, split: int = 64) -> DataFrame:
    """The first `limit` rows of each group by `order`, numbered from 1.

    A group is cut by a hash of its rows first, so that at most `split` times `limit` rows of it meet in one task."""
    dealt = df.withColumn(_PART, F.pmod(F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t and "variant" not in t]), F.lit(split)))
    for by in ([*keys, _PART], keys):
        dealt = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= limit)
    return dealt.drop(_PART)
