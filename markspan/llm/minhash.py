"""Near-duplicate texts by b-bit MinHash.

1. Arrow batches turn each text into its set of word shingles, the minima of BANDS x ROWS permutations, a key for each
   band, and a packed signature that holds only the low BITS bits of each minimum.
2. Equal sets are one node from here on, so a large group of copies is one row.
3. Nodes that share a band key are candidates. Bit counts of the packed signatures estimate their similarity, corrected for
   chance collisions of b bits. Members of a bucket that are far below the threshold from its hub are compared with all its
   other members, in blocks. Candidates near the threshold or above it form families.
4. Within families, in blocks again, full sets confirm the links; confirmed links form components. Neither step sends out
   pairs: a block yields a spanning forest, and pairs within one tree need no test.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.llm.blocks import Forest, bucket_links
from markspan.llm.common import giving_back
from markspan.llm.components import components
from markspan.llm.shingles import constants, mix, set_key, shingle_sets
from markspan.session import written

BITS = 4  # kept of each minimum
PER_LONG = 64 // BITS
LOW = 0x1111111111111111  # the lowest bit of each group of BITS bits
BLOCK, SURE_BLOCK = 1024, 512  # members of a block that are compared in memory
SMALL_SIDE = 32 << 20  # bytes; larger sides of a semi-join are shuffled


@dataclass(frozen=True)
class Settings:
    """Links need den * |A & B| >= num * |A | B| over sets of `width`-word shingles.

    With 28 bands of 4 rows a pair at 0.85 is missed with a chance of 1e-9, a pair at 0.8 with 4e-7. `slack` is how far the
    estimate of 112 minima may lie below the threshold: six standard deviations."""

    width: int = 3
    num: int = 85
    den: int = 100
    bands: int = 28
    rows: int = 4
    slack: float = 0.2

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def longs(self) -> int:
        return -(-self.minima // PER_LONG)


def _signature(s: np.ndarray, cfg: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(packed low bits, band keys) of a set."""
    flips = (constants(cfg.minima, 11) >> np.uint64(32)).astype(np.uint32)[:, None]
    factors = (constants(cfg.minima, 13) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
    short = (s >> np.uint64(32)).astype(np.uint32)
    minima = np.full(cfg.minima, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(short), 2048):
        part = np.bitwise_xor(short[None, k : k + 2048], flips)
        part *= factors
        np.minimum(minima, part.min(axis=1), out=minima)
    low = np.zeros(cfg.longs * PER_LONG, dtype=np.uint64)
    low[: cfg.minima] = minima & np.uint32((1 << BITS) - 1)
    shifts = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    packed = (low.reshape(cfg.longs, PER_LONG) << shifts).sum(axis=1, dtype=np.uint64)
    rows = minima.reshape(cfg.bands, cfg.rows).astype(np.uint64)
    keys = np.arange(1, cfg.bands + 1, dtype=np.uint64)
    for k in range(cfg.rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return packed.view(np.int64), keys.view(np.int64)


SIGNED = "doc_id long, n_shingles long, node long, sig array<long>, bands array<long>"
SETS = "node long, members array<long>"


def _signed(cfg: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for _, s in shingle_sets(batch.column("text"), cfg.width):
                sig, bands = _signature(s, cfg) if len(s) else (np.zeros(0, np.int64),) * 2
                for values, v in zip(out, (len(s), set_key(s), sig, bands), strict=True):
                    values.append(v)
            columns = [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), _lists(out[2]), _lists(out[3])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "sig", "bands"])

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int64, copy=False), pa.int64()))


def _with_sets(cfg: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets, held = [], [], 0
            for _, s in shingle_sets(batch.column("text"), cfg.width):
                if len(s):
                    keys.append(set_key(s))
                    sets.append(s.view(np.int64))
                    held += len(s)
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), _lists(sets)], names=["node", "members"])
                    keys, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), _lists(sets)], names=["node", "members"])

    return run


def only(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Semi-join with a written table of distinct long keys: sent to all tasks up to SMALL_SIDE bytes, else shuffled."""
    small = keys.count() * 16 <= SMALL_SIDE
    return df.join(F.broadcast(keys) if small else keys, key, "left_semi")


def estimate(a: Column, b: Column, cfg: Settings) -> Column:
    """Similarity from the packed signatures: groups of equal bits, less the share that agrees by chance."""
    differing = F.lit(0)
    for k in range(cfg.longs):
        x = a[k].bitwiseXOR(b[k])
        folded = x
        for shift in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, shift))
        differing = differing + F.bit_count(folded.bitwiseAND(F.lit(LOW)))
    chance = 1.0 / (1 << BITS)
    return ((1 - differing / F.lit(float(cfg.minima))) - chance) / (1 - chance)


def _linked(pairs: DataFrame, nodes: DataFrame, cfg: Settings) -> DataFrame:
    """Candidates (a, b) whose sizes and signatures allow a link."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    sized = pairs.join(one, "a").join(two, "b")
    possible = F.least("na", "nb") * cfg.den >= F.greatest("na", "nb") * cfg.num
    alike = estimate(F.col("sa"), F.col("sb"), cfg) >= cfg.num / cfg.den - cfg.slack
    return sized.filter(possible & alike).select("a", "b")


def _fixed(group: pa.Table, name: str, width: int) -> np.ndarray:
    return group.column(name).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, width)


def _estimates(sig: np.ndarray, x: int, ys: np.ndarray, cfg: Settings) -> np.ndarray:
    """As `estimate`, of row x with the rows ys."""
    folded = sig[ys] ^ sig[x]
    folded |= folded >> np.uint64(2)
    folded |= folded >> np.uint64(1)
    equal = 1 - np.bitwise_count(folded & np.uint64(LOW)).sum(axis=1) / cfg.minima
    chance = 1.0 / (1 << BITS)
    return (equal - chance) / (1 - chance)


def _alike(group: pa.Table, x: int, ys: np.ndarray, n: np.ndarray, sig: np.ndarray, cfg: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The rows among ys that may be linked with x by size and estimate, with their estimates."""
    ys = ys[(np.minimum(n[ys], n[x]) * cfg.den >= np.maximum(n[ys], n[x]) * cfg.num) & (ys != x)]
    guess = _estimates(sig, x, ys, cfg)
    good = guess >= cfg.num / cfg.den - cfg.slack
    return ys[good], guess[good]


def _candidates(cfg: Settings):
    """Candidate links of far members, as a spanning forest; members that are not far are one tree already."""

    def compare(group: pa.Table, ours: np.ndarray, theirs: np.ndarray, far: np.ndarray) -> list[tuple[int, int]]:
        n, sig = group.column("n").to_numpy(), _fixed(group, "sig", cfg.longs)
        trees = Forest(len(n))
        near = np.flatnonzero(~far)
        for k in near[1:].tolist():
            trees.join(int(near[0]), k)
        links = []
        for x in ours.tolist():
            for y in _alike(group, x, theirs, n, sig, cfg)[0].tolist():
                if trees.join(x, y):
                    links.append((x, y))
        return links

    return compare


def _sure(cfg: Settings):
    """Links confirmed on full sets, as a spanning forest: likeliest pairs first, pairs of one tree are passed over."""

    def compare(group: pa.Table, ours: np.ndarray, theirs: np.ndarray, far: np.ndarray) -> list[tuple[int, int]]:
        n, sig = group.column("n").to_numpy(), _fixed(group, "sig", cfg.longs)
        nodes, lists = group.column("node").to_numpy(), group.column("members").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        trees = Forest(len(n))
        pairs = []
        for x in ours.tolist():
            ys, guess = _alike(group, x, theirs[nodes[theirs] > nodes[x]], n, sig, cfg)
            pairs.append((np.full(len(ys), x), ys, guess))
        x, y, guess = (np.concatenate(c) for c in zip(*pairs, strict=True))
        order = np.argsort(-guess, kind="stable")
        links = []
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            if trees.find(i) == trees.find(j):
                continue
            shared = len(np.intersect1d(flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]], assume_unique=True))
            if shared * cfg.den >= (n[i] + n[j] - shared) * cfg.num:
                trees.join(i, j)
                links.append((i, j))
        return links

    return compare


def near_duplicates(docs: DataFrame, cfg: Settings) -> DataFrame:
    """One row per document row: doc_id, n_shingles, node (equal sets share it), root (the component's smallest node).

    A node is a 64-bit key of the whole set; the chance that two of n different sets share one is n^2 / 2^65. Texts without
    words and rows without id have no links."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(plain.mapInArrow(giving_back(_signed(cfg)), SIGNED), "signed")
    nodes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node").agg(
        F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.min("doc_id").alias("holder")
    )
    nodes = written(nodes, "nodes")
    entries = nodes.select(F.explode("bands").alias("key"), "node")
    buckets = entries.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last")
    members = written(entries.join(buckets, "key").select("key", "node", "hub"), "members")

    # Members like their hub are its family. Buckets with others in them are compared in blocks.
    sketches = nodes.select("node", "n", "sig")
    pairs = members.filter("hub < node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    near = written(_linked(pairs, nodes, cfg), "near")
    beside = near.select(F.col("a").alias("hub"), F.col("b").alias("node"))
    far = members.filter("hub < node").join(beside, ["hub", "node"], "left_anti").select("key", "node", F.lit(True).alias("far"))
    far = written(far, "far")
    mixed = members.join(far.select("key").distinct(), "key", "left_semi").select("key", "node")
    rows = mixed.join(far, ["key", "node"], "left").select(F.col("key").alias("bucket"), "node", F.coalesce("far", F.lit(False)).alias("far"))
    more = bucket_links(rows.join(sketches, "node"), _candidates(cfg), BLOCK)

    # The families of all candidate links are disjoint; their full sets confirm the links.
    families = written(components(near.union(more)), "families")
    holders = written(nodes.join(families, "node", "left_semi").select(F.col("holder").alias("doc_id")).distinct(), "holders")
    sets = only(plain, holders, "doc_id").mapInArrow(giving_back(_with_sets(cfg)), SETS)
    sets = written(only(sets, families.select("node"), "node").dropDuplicates(["node"]), "sets")
    rows = families.select(F.col("component").alias("bucket"), "node", F.lit(True).alias("far"))
    links = written(bucket_links(rows.join(sketches, "node").join(sets, "node"), _sure(cfg), SURE_BLOCK), "sure")
    root = components(links).select("node", F.col("component").alias("root"))
    return signed.select("doc_id", "n_shingles", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))


def document_classes(docs: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept, class_id.

    class_id is the component's key. Null, empty and wordless texts have no shingles and are linked with nothing. Rows
    that share an id or a text are rows of their own; each finds the component of its own text. A row without id is linked
    with nothing: its component_id is null and it is kept."""
    rows = written(near_duplicates(docs, cfg or Settings()), "classes")
    names = rows.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    named = rows.join(names, "root", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    named = named.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    return named.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("root").alias("class_id")
    )


def keep_one(docs: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """The documents that document_classes keeps, with all their columns. An id goes if none of its rows is kept, so that no
    group of near duplicates loses its last document."""
    rows = document_classes(docs, cfg).filter("doc_id IS NOT NULL")
    gone = rows.groupBy(F.col("doc_id").alias("__id")).agg(F.bool_or("kept").alias("any")).filter("NOT any").select("__id")
    gone = written(gone, "gone")
    small = gone.count() * 16 <= SMALL_SIDE
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"] == F.col("__id"), "left_anti").select(*docs.columns)
