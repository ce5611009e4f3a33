"""Comparing the members of buckets of any size, in blocks, without sending out their pairs.

A bucket of m members is cut into m / size blocks by a hash of the member; every pair of blocks is one group of bounded size
that a task compares in memory. What a group sends on is at most a spanning forest of the links that it found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspan.llm.common import giving_back

EDGES = "a long, b long"


class Forest:
    """Union-find over the places 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (bucket, i, j) of batches in that order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mark = tuple(marks[:, a])
            if last is not None and mark != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = mark
    if held:
        yield pa.Table.from_batches(held)


Compare = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], list[tuple[int, int]]]


def _linking(compare: Compare) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for group in _groups(batches):
            left = group.column("left").to_numpy()
            far = group.column("far").to_numpy()
            ours, theirs = (np.flatnonzero(left), np.flatnonzero(~left)) if left.any() else (np.flatnonzero(far), np.arange(len(far)))
            nodes = group.column("node").to_numpy()
            for x, y in compare(group, ours, theirs, far) if len(ours) else ():
                if nodes[x] != nodes[y]:
                    a.append(int(nodes[x]))
                    b.append(int(nodes[y]))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def bucket_links(rows: DataFrame, compare: Compare, size: int) -> DataFrame:
    """Links (a, b) that `compare` finds between the far members of a bucket and all of its members.

    `rows` is (bucket long, node long, far boolean, ...). compare(group, ours, theirs, far) gets the rows of a group and the
    places to compare with each other, and returns the places of links."""
    counts = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    cut = rows.join(counts, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    # A bucket of one block is there once; in a larger one far members also stand on the left of every block.
    right = F.transform(every, lambda k: F.struct(k.alias("i"), F.col("own").alias("j"), F.lit(False).alias("left")))
    left = F.transform(F.when(F.col("far") & (F.col("parts") > 1), every).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.col("own").alias("i"), k.alias("j"), F.lit(True).alias("left")))
    names = [c for c in rows.columns if c != "bucket"]
    dealt = cut.select("bucket", *names, F.explode(F.concat(right, left)).alias("at")).select("bucket", "at.*", *names)
    keys = ["bucket", "i", "j"]
    # A fixed number of partitions: rows are few, but comparing them is work that should stay spread.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(giving_back(_linking(compare)), EDGES).distinct()
