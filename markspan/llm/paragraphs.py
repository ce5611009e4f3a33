"""Passages that repeat across documents, from sampled word runs that are extended to the true ends of the passages.

1. Arrow batches hash every run of SEED words and keep the least hash of every WINDOW neighbouring runs. Two texts that share
   RUN = SEED + WINDOW - 1 words in sequence share a kept run, whatever stands around: no chance is in it.
2. Occurrences of a run that stands in several documents are paired with its first occurrence (the first one's further
   occurrences in the same document with the last); both texts meet in one row for each pair of documents.
3. There each pair is extended word by word in both directions, over edits of up to EDIT words that are followed by a shingle of
   equal words, to the widest span whose full shingle sets are alike. From MIN_WORDS words on it is a passage.
4. Runs with a pair that does not extend far enough are taken again by every RUN words around them, so that occurrences whose first one
   is a stranger find each other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspan.llm.common import Batches, giving_back
from markspan.llm.components import components
from markspan.llm.shingles import constants, mix, slices, words_at
from markspan.session import new_path, written

WIDTH = 5  # words of a shingle
NUM, DEN = 8, 10  # least similarity of a passage's two shingle sets
SEED, WINDOW = 12, 8
RUN = SEED + WINDOW - 1
EDIT = 5  # words of one edit on either side
MIN_WORDS = 20

SPOT = ("doc_id", "part", "pos")
HELD = 1 << 18  # spots that a task deals out at a time
PASSED = 1 << 12  # spots of a row that passes by
DEALT = "bucket int, passing boolean, n int, spots binary"
MET = "kind int, doc_id long, part long, pos long, key long, with_doc long, with_part long, with_pos long"
PAIR, SPARE, HUB = 0, 1, 2  # kinds of MET
SPANS = "doc_id long, part long, a long, b long, begin long, end long, with_doc long, with_part long, c long, d long, with_begin long, with_end long, short array<long>"
PIECES = "doc_id long, part long, begin long, end long, n_words long, kept boolean, first_doc_id long, node long, a long, b long"


def _runs(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash for each run of `length` words."""
    factors = constants(length, seed, odd=True)
    n = max(0, len(words) - length + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for k in range(length):
            out += words[k : k + n] * factors[k]
        return mix(out)


def _sampled(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the last least hash of every WINDOW neighbouring runs of a row, and of a row with fewer."""
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    least, place = hashes.copy(), np.arange(n)
    for k in range(1, WINDOW):
        better = np.zeros(n, dtype=bool)
        better[: n - k] = (rows[k:] == rows[: n - k]) & (hashes[k:] <= least[: n - k])
        at = np.flatnonzero(better)
        least[at], place[at] = hashes[at + k], at + k
    return np.unique(place)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, parts = batch.column("doc_id").to_numpy(), batch.column("part").to_numpy()
        for first, data, offsets in slices(batch.column("text")):
            words, counts, _, _ = words_at(data, offsets)
            hashes = _runs(words, SEED, 29)
            row = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
            inside = np.flatnonzero(row[: len(hashes)] == row[SEED - 1 :]) if len(hashes) else np.zeros(0, dtype=np.int64)
            at = inside[_sampled(hashes[inside], row[inside])]
            columns = [ids[row[at] + first], parts[row[at] + first], at - counts[row[at]], hashes[at].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*SPOT, "key"])


def _row_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row its word hashes and where each word begins and ends, in code points."""
    for _, data, offsets in slices(column):
        words, counts, begins, ends = words_at(data, offsets)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        for k, (i, j) in enumerate(zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True)):
            base = points[offsets[k]]
            yield words[i:j], points[begins[i:j]] - base, points[ends[i:j]] - base


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """The number of equal words from the start on."""
    n, done, step = min(len(x), len(y)), 0, 32
    while done < n:
        other = x[done : min(n, done + step)] != y[done : min(n, done + step)]
        first = int(other.argmax())
        if other[first]:
            return done + first
        done, step = min(n, done + step), 2 * step
    return n


SHIFTS = sorted(((i, j) for i in range(EDIT + 1) for j in range(EDIT + 1) if i + j), key=lambda s: (sum(s), abs(s[0] - s[1])))
SIZE = 8 * WIDTH  # bytes of a shingle's words


def _stretches(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Equal stretches (place in x, place in y, words) from the start on, each after an edit of up to EDIT words."""
    n = _equal(x, y)
    out, i, j = [(0, 0, n)], n, n
    while True:
        a, b = x[i : i + EDIT + WIDTH].tobytes(), y[j : j + EDIT + WIDTH].tobytes()
        ours = [a[k : k + SIZE] for k in range(0, len(a) - SIZE + 1, 8)]
        theirs = [b[k : k + SIZE] for k in range(0, len(b) - SIZE + 1, 8)]
        if set(ours).isdisjoint(theirs):
            return out
        for di, dj in SHIFTS:
            if di < len(ours) and dj < len(theirs) and ours[di] == theirs[dj]:
                break
        else:
            return out
        i, j = i + di, j + dj
        n = _equal(x[i:], y[j:])
        out.append((i, j, n))
        i, j = i + n, j + n


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two passages have like shingle sets."""
    one, other = np.unique(_runs(x, WIDTH, 7)), np.unique(_runs(y, WIDTH, 7))
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return shared * DEN >= (len(one) + len(other) - shared) * NUM


def extended(x: np.ndarray, y: np.ndarray, p: int, q: int) -> tuple[int, int, int, int]:
    """The widest alike spans x[a:b], y[c:d] around x[p:p + SEED] == y[q:q + SEED]."""
    right = _stretches(x[p:], y[q:])
    left = _stretches(x[:p][::-1], y[:q][::-1])
    middle = right[0][2] + left[0][2]
    if len(left) == len(right) == 1:
        n, m = left[0][2], right[0][2]
        return p - n, p + m, q - n, q + m
    ahead = np.array([(i + n, j + n) for i, j, n in right])
    back = np.array([(i + n, j + n) for i, j, n in left])
    gain = lambda found: np.array([0, *accumulate(n - WIDTH + 1 for _, _, n in found[1:])])
    shared = middle - WIDTH + 1 + gain(left)[:, None] + gain(right)
    sizes = back.sum(axis=1)[:, None] + ahead.sum(axis=1) - 2 * (WIDTH - 1)
    wide = np.where(shared * DEN >= (sizes - shared) * NUM, sizes, -1)
    # From the widest on; repeated shingles may make sets less alike than their counts, and the equal stretch always is.
    for place in np.argsort(-wide, axis=None, kind="stable").tolist():
        k, m = divmod(place, len(right))
        a, b, c, d = p - int(back[k, 0]), p + int(ahead[m, 0]), q - int(back[k, 1]), q + int(ahead[m, 1])
        if wide[k, m] >= 0 and (k + m == 0 or _alike(x[a:b], y[c:d])):
            return a, b, c, d
    raise AssertionError("an equal stretch is alike")


def _outermost(spans: list[tuple[int, int, int, int]], most: int = 64) -> list[int]:
    """Places of the spans that none of the `most` widest holds on both sides: what lies in another span adds nothing to it."""
    if len(spans) < 2:
        return list(range(len(spans)))
    at = np.array(spans)
    inner = np.zeros(len(at), dtype=bool)
    for k in np.argsort(at[:, 0] - at[:, 1], kind="stable")[:most].tolist():
        if not inner[k]:
            a, b, c, d = spans[k]
            inside = (at[:, 0] >= a) & (at[:, 1] <= b) & (at[:, 2] >= c) & (at[:, 3] <= d)
            inside[k] = False
            inner |= inside
    return np.flatnonzero(~inner).tolist()


def _extend(min_words: int) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(n, pa.int64()) for n in SPANS.replace(" long", "").split(", ")[:-1]] + [("short", pa.list_(pa.int64()))])
        for batch in batches:
            out: list[tuple] = []
            heads = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "with_doc", "with_part", "spots")), strict=True)
            for (doc, part, other, other_part, spots), (x, begins, ends), (y, with_begins, with_ends) in zip(heads, _row_words(batch.column("text")), _row_words(batch.column("with_text")), strict=True):
                short: list[int] = []
                done: list[tuple[int, int, int, int]] = []
                for p, q in sorted((s["pos"], s["with_pos"]) for s in spots):
                    # A pair inside an earlier span, near its diagonal, belongs to it.
                    if any(a <= p and p + SEED <= b and c <= q and q + SEED <= d and abs((p - a) - (q - c)) <= abs((b - a) - (d - c)) for a, b, c, d in done[-4:]):
                        continue
                    a, b, c, d = extended(x, y, p, q)
                    if min(b - a, d - c) < min_words:
                        short.append(p)
                        continue
                    done.append((a, b, c, d))
                for k in _outermost(done):
                    a, b, c, d = done[k]
                    out.append((doc, part, a, b, int(begins[a]), int(ends[b - 1]), other, other_part, c, d, int(with_begins[c]), int(with_ends[d - 1]), None))
                if short:
                    out.append((doc, part, None, None, None, None, other, other_part, None, None, None, None, short))
            for k in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 50_000], strict=True), kind.types, strict=True)], schema=kind)

    return run


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every RUN words that hold a run at one of the row's places: their place, hash, and the run's place in them."""
    for batch in batches:
        for doc, part, places, (words, _, _) in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "places")), _row_words(batch.column("text")), strict=True):
            hashes = _runs(words, RUN, 37)
            at = np.unique(np.asarray(places)[:, None] - np.arange(WINDOW))
            at = at[(at >= 0) & (at < len(hashes))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (np.full(len(at), doc), np.full(len(at), part), at, hashes[at].view(np.int64))], names=[*SPOT, "key"])


def _packed(spots: np.ndarray) -> bytes:
    """Columns of numbers, those of one byte's place side by side: shared high bytes compress."""
    return np.ascontiguousarray(spots, dtype=np.int64).view(np.uint8).reshape(len(spots), -1, 8).transpose(0, 2, 1).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(-1, 8, n).transpose(0, 2, 1).copy().view(np.int64)[:, :, 0]


def _ordered(spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spots (rows of doc_id, part, pos, key, ...) by key and place, and whether each is its key's first and last."""
    spots = spots[:, np.lexsort((spots[2], spots[1], spots[0], spots[3]))]
    first = np.ones(spots.shape[1], dtype=bool)
    first[1:] = spots[3, 1:] != spots[3, :-1]
    return spots, first, np.append(first[1:], True)[: len(first)]


def _deal(spots: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    spots, first, last = _ordered(spots)
    between = ~(first | last)
    # Whether spots of the key pass by.
    more = np.maximum.reduceat(between, np.flatnonzero(first)) if len(first) else between
    more = more[np.cumsum(first) - 1]
    ends = np.vstack([spots, more])[:, ~between]
    bucket = ((ends[3].view(np.uint64) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends, bucket = ends[:, order], bucket[order]
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else [0]
    rows = [(int(bucket[i]), False, j - i, _packed(ends[:, i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    spare = spots[:, between]
    spare = spare[:, np.argsort(spare[0], kind="stable")]
    for i in range(0, spare.shape[1], PASSED):
        some = spare[:, i : i + PASSED]
        rows.append((int(mix(some[:1, 0].view(np.uint64) + np.uint64(i))[0] % np.uint64(parts)), True, some.shape[1], _packed(some)))
    kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.binary()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "passing", "n", "spots"])


def _dealt(spots: Batches, parts: int) -> Batches:
    """The spots by buckets of keys, packed. Of a key that a task has often, the first and the last go to its bucket; those between pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in spots(batches):
            held.append(np.stack([batch.column(c).to_numpy() for c in (*SPOT, "key")]))
            n += batch.num_rows
            if n >= HELD:
                yield from _deal(np.hstack(held), parts)
                held, n = [], 0
        if n:
            yield from _deal(np.hstack(held), parts)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All spots of the keys that several documents hold: with those they are paired with (PAIR), or as they passed by (SPARE), besides
    the first and last spots of such keys (HUB)."""
    names = [c.split()[0] for c in MET.split(", ")]

    def rows(kind: int, spots: np.ndarray, others: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for i in range(0, spots.shape[1], 50_000):
            some = spots[:4, i : i + 50_000]
            n = some.shape[1]
            theirs = [pa.nulls(n, pa.int64())] * 3 if others is None else [pa.array(np.ascontiguousarray(c)) for c in others[:3, i : i + 50_000]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in some), *theirs], names=names)

    held: list[np.ndarray] = []
    for batch in batches:
        for passing, n, data in zip(*(batch.column(c).to_pylist() for c in ("passing", "n", "spots")), strict=True):
            if passing:
                yield from rows(SPARE, _unpacked(data, n), None)
            else:
                held.append(_unpacked(data, n))
    if not held:
        return
    spots, first, last = _ordered(np.hstack(held))
    held.clear()
    group = np.cumsum(first) - 1
    hubs, lasts = spots[:, first], spots[:, last]
    several = hubs[0] < lasts[0]
    more = np.logical_or.reduceat(spots[4] > 0, np.flatnonzero(first)) & several
    yield from rows(HUB, hubs[:, more], lasts[:, more])
    keep = several[group]
    spots, group = spots[:, keep], group[keep]
    hub, end = hubs[:, group], lasts[:, group]
    other = (spots[:3] != hub[:3]).any(axis=0)
    spots, hub, end = spots[:, other], hub[:, other], end[:, other]
    yield from rows(PAIR, spots, np.where(spots[0] == hub[0], end, hub))


def _pairs(rows: DataFrame, spots: Batches, name: str) -> DataFrame:
    """(doc_id, part, pos, key, with_doc, with_part, with_pos) of the spots, found in `rows`, whose key several documents hold: with is the
    first spot of the key, or the last one for further spots of the first document."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(giving_back(_dealt(spots, 4 * parts)), DEALT)
    met = written(dealt.repartition(parts, "bucket").mapInArrow(giving_back(_met), MET), name)
    hubs = met.filter(F.col("kind") == HUB).select("key", F.struct(*SPOT).alias("hub"), F.struct(F.col("with_doc").alias("doc_id"), F.col("with_part").alias("part"), F.col("with_pos").alias("pos")).alias("last"))
    spare = met.filter(F.col("kind") == SPARE).select(*SPOT, "key").join(hubs, "key").filter(F.struct(*SPOT) != F.col("hub"))
    spare = spare.select(*SPOT, "key", F.when(F.col("doc_id") == F.col("hub.doc_id"), F.col("last")).otherwise(F.col("hub")).alias("with"))
    spare = spare.select(*SPOT, "key", F.col("with.doc_id").alias("with_doc"), F.col("with.part").alias("with_part"), F.col("with.pos").alias("with_pos"))
    return met.filter(F.col("kind") == PAIR).drop("kind").union(spare)


def _grouped(pairs: DataFrame, name: str) -> DataFrame:
    """The spots of each pair of documents."""
    keys = ["doc_id", "part", "with_doc", "with_part"]
    return written(pairs.groupBy(*keys).agg(F.collect_set(F.struct("pos", "with_pos")).alias("spots")), name)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, part, text), once for each wanted (doc_id, part)."""
    return docs.join(wanted.select("doc_id", "part").distinct(), ["doc_id", "part"], "left_semi").groupBy("doc_id", "part").agg(F.first("text").alias("text"))


def _others(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("with_doc").alias("doc_id"), F.col("with_part").alias("part"))


def _bucketed(texts: DataFrame, name: str) -> DataFrame:
    """The texts as table `name` of the session, bucketed by document, so that later joins do not move them again."""
    spark = texts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.bucketBy(buckets, "doc_id", "part").option("path", new_path(spark, "texts")).format("parquet").saveAsTable(name)
    return spark.table(name)


def _spans(texts: DataFrame, grouped: DataFrame, min_words: int) -> DataFrame:
    others = _texts(texts, _others(grouped)).toDF("with_doc", "with_part", "with_text")
    rows = grouped.join(texts, ["doc_id", "part"]).join(others, ["with_doc", "with_part"])
    rows = rows.select("doc_id", "part", "with_doc", "with_part", "spots", "text", "with_text")
    return written(rows.mapInArrow(giving_back(_extend(min_words)), SPANS), "spans")


def passage_pairs(docs: DataFrame, min_words: int) -> DataFrame:
    """The passages of pairs of documents: words a to b of one, c to d of the other, with code points; `docs` has a part (a hash of
    the text)."""
    pairs = _pairs(docs, _seeds, "seed-pairs")
    grouped = _grouped(pairs, "pairs")
    # Texts without a common run move no further; those with one hold all later spots.
    name = f"passage_texts_{uuid.uuid4().hex}"
    texts = _bucketed(_texts(docs, grouped.select("doc_id", "part").union(_others(grouped))), name)
    first = _spans(texts, grouped, min_words)
    short = first.filter("short IS NOT NULL").select("doc_id", "part", F.explode("short").alias("pos"))
    keys = written(pairs.join(short, [*SPOT], "left_semi").select("key").distinct(), "short-keys")
    again = pairs.join(keys, "key", "left_semi")
    again = again.select(*SPOT).union(again.select("with_doc", "with_part", "with_pos"))
    again = again.groupBy("doc_id", "part").agg(F.collect_set("pos").alias("places"))
    around = _pairs(again.join(texts, ["doc_id", "part"]), _around, "around-pairs")
    second = _spans(texts, _grouped(around, "around"), min_words)
    docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")  # the name; its files stay
    return first.filter("a IS NOT NULL").drop("short").union(second.filter("a IS NOT NULL").drop("short"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of each text as passages that do not overlap: those that an earlier one replaces, and what is left of the others."""
    kind = pa.schema([(n, pa.bool_() if n == "kept" else pa.int64()) for n in (c.split()[0] for c in PIECES.split(", "))])
    for batch in batches:
        for doc, part, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "spans")), strict=True):
            pieces: list[list] = []
            for gone in (True, False):
                union: list[list] = []
                for s in sorted((s for s in spans if s["gone"] == gone), key=lambda s: (s["a"], s["b"])):
                    if union and s["a"] <= union[-1][1]:
                        last = union[-1]
                        if s["b"] > last[1]:
                            last[1], last[3] = s["b"], s["end"]
                        last[4] = min(last[4], s["first"])
                    else:
                        union.append([s["a"], s["b"], s["begin"], s["end"], s["first"]])
                if gone:
                    removed = union
                    pieces += [[*u, False] for u in union]
                    continue
                for a, b, begin, end, _ in union:
                    for ga, gb, gbegin, gend, _ in removed:
                        if gb > a and ga < b:
                            if ga > a:
                                pieces.append([a, ga, begin, gbegin, doc, True])
                            a, begin = gb, gend
                    if a < b:
                        pieces.append([a, b, begin, end, doc, True])
            rows = [(doc, part, begin, end, b - a, kept, first, a, b) for a, b, begin, end, first, kept in sorted(pieces)]
            columns = list(zip(*rows, strict=True))
            with np.errstate(over="ignore"):
                seed = np.uint64(doc & (2**64 - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part & (2**64 - 1))
                node = mix(mix(np.atleast_1d(seed)) + np.array(columns[7], dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)
            columns.insert(7, node)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types, strict=True)], schema=kind)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, begin, end (code points of the text, end exclusive), n_words, kept, first_doc_id, class_id: one row for each
    passage that repeats across documents, the occurrences that stay included.

    Passages that overlap or touch are one, cut where its first occurrence changes from this document to another.
    class_id is shared by passages that are linked. Documents without repeats have no row, nor have rows without id or text;
    rows that share an id are one document. A repeat within one document alone is none."""
    plain = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("part"), "text")
    found = written(passage_pairs(plain, min_words), "passage-pairs")
    one = found.select("doc_id", "part", "a", "b", "begin", "end", F.lit(True).alias("gone"), F.col("with_doc").alias("first"))
    names = [F.col(c).alias(n) for c, n in (("with_doc", "doc_id"), ("with_part", "part"), ("c", "a"), ("d", "b"), ("with_begin", "begin"), ("with_end", "end"))]
    sides = one.union(found.select(*names, F.lit(False).alias("gone"), F.col("with_doc").alias("first")))
    place = ["doc_id", "part", "a", "b", "begin", "end", "gone"]
    sides = sides.groupBy(*place).agg(F.min("first").alias("first"))
    grouped = sides.groupBy("doc_id", "part").agg(F.collect_list(F.struct(*place[2:], "first")).alias("spans"))
    pieces = written(grouped.mapInArrow(_merged, PIECES), "pieces")

    # Linked passages are a class. A span links all the passages that it meets to the first of them.
    ends = sides.select("doc_id", "part", F.col("a").alias("from"), F.col("b").alias("to")).distinct()
    meets = ends.join(pieces, ["doc_id", "part"]).filter("a < to AND b > from").groupBy("doc_id", "part", "from", "to").agg(F.min("node").alias("node"), F.collect_set("node").alias("nodes"))
    meets = written(meets, "meets")
    ours = meets.select("doc_id", "part", F.col("from").alias("a"), F.col("to").alias("b"), F.col("node").alias("x"))
    theirs = meets.select(F.col("doc_id").alias("with_doc"), F.col("part").alias("with_part"), F.col("from").alias("c"), F.col("to").alias("d"), F.col("node").alias("y"))
    links = found.join(ours, ["doc_id", "part", "a", "b"]).join(theirs, ["with_doc", "with_part", "c", "d"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    links = links.union(meets.select(F.col("node").alias("a"), F.explode("nodes").alias("b")))
    classes = pieces.join(components(links).withColumnRenamed("component", "class_id"), "node", "left")
    return classes.select("doc_id", "begin", "end", "n_words", "kept", "first_doc_id", F.coalesce("class_id", "node").alias("class_id")).distinct()


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with every passage cut out that an earlier document (by id) holds. Columns stay."""
    gone = repeated_passages(docs, min_words).filter(~F.col("kept")).groupBy(F.col("doc_id").alias("__id"))
    gone = gone.agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("__gone"))
    joined = docs.join(gone, docs["doc_id"] == F.col("__id"), "left")
    opens = F.concat(F.transform("__gone", lambda g: g["end"]), F.array().cast("array<bigint>"))
    starts = F.concat(F.array(F.lit(0).cast("long")), opens)
    stops = F.concat(F.transform("__gone", lambda g: g["begin"]), F.array(F.length("text").cast("long")))
    pieces = F.zip_with(starts, stops, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")))
    return joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))).select(*docs.columns)
