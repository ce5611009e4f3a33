"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column, block: int = 512) -> Column:
    """Sums of the values before each element, for arrays of any length: array appends stay within blocks."""
    zero = F.lit(0).cast("long")

    def append(start: Column, items: Column) -> Column:
        grown = F.aggregate(items, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(grown, 1, F.size(items))

    def blocks(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(block))
        return F.transform(starts, lambda s: F.slice(a, s, F.lit(block)))

    def joined(cut: Column) -> Column:
        totals = F.transform(cut, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x))
        return F.flatten(F.zip_with(cut, append(zero, totals), lambda b, start: append(start, b)))

    longs = F.transform(values, lambda v: v.cast("long"))
    return let(longs, lambda a: let(blocks(a), joined))


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def giving_back(work: Batches) -> Batches:
    """`work` for mapInArrow. A worker lives on after its task, so what Arrow's allocator keeps for later goes back to the system."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return run
