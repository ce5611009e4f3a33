"""Quality by the perplexity of an interpolated modified Kneser-Ney model of character n-grams.

One model per language is counted over the trained half of all trusted documents. Documents are stored once in compressed blocks; each block
names its distinct n-grams, the model's probabilities for them come from joins of sharded count tables, and go back to the
block as one row. So the texts are never shuffled, and what moves grows with the blocks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import ipc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.llm.common import giving_back
from markspan.llm.shingles import constants, mix
from markspan.session import new_path, written

ORDER = 4
PAD = "\n"  # stands before the first character
BLOCK_BYTES = 32 << 20  # of text in a block; its n-grams and answers are as many as it has distinct ones
PART_BYTES = 512 << 10  # of text that a task takes apart at a time: about 100 times as much in arrays
SMALL_SIDE = 32 << 20  # bytes of trusted ids that are sent to all tasks; more are joined by shuffle
QUANTILE, MARGIN = 0.995, 1.2  # a document may have MARGIN times this quantile of the perplexities of held-out trusted ones


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in blocks of compressed record batches; a text above the bounds is a part, or a block, of its own."""
    number = TaskContext.get().partitionId() << 32
    options = ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
    sink = out = None
    held = 0

    def packed() -> pa.RecordBatch:
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column("text")).fill_null(0)).astype(np.int64)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin] - sizes[begin]
            take = max(1, int(np.searchsorted(ends, before + PART_BYTES, "right")) - begin)
            part = batch.slice(begin, take)
            if out is not None and held + int(ends[begin + part.num_rows - 1] - before) > BLOCK_BYTES:
                yield packed()
                number, sink, out, held = number + 1, None, None, 0
            if out is None:
                sink = pa.BufferOutputStream()
                out = ipc.new_stream(sink, batch.schema, options=options)
            out.write_batch(part)
            held += int(ends[begin + part.num_rows - 1] - before)
            begin += part.num_rows
    if out is not None:
        yield packed()


def _opened(payload: pa.BinaryScalar) -> Iterator[pa.Table]:
    """The parts of a block."""
    with ipc.open_stream(payload.as_buffer()) as parts:
        for part in parts:
            yield pa.Table.from_batches([part])


def _code(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def gram_hashes(points: np.ndarray, code: np.uint64, order: int) -> np.ndarray:
    """A hash for each run of `order` code points and a language."""
    factors = constants(order, 17, odd=True)
    n = len(points) - order + 1
    with np.errstate(over="ignore"):
        h = np.full(n, code, dtype=np.uint64)
        for k in range(order):
            h += points[k : k + n].astype(np.uint64) * factors[k]
        return mix(h)


def _texts(table: pa.Table, order: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """For each language of a block: its rows, the padded code points of their texts, and where each row's grams begin."""
    langs = np.array([x or "" for x in table.column("lang").to_pylist()], dtype=object)
    texts = table.column("text").to_pylist()
    for lang in sorted(set(langs)):
        rows = np.flatnonzero(langs == lang)
        joined = "".join(PAD * (order - 1) + (texts[r] or "").replace("\0", "�") for r in rows)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(texts[r] or "") + order - 1 for r in rows])
        yield lang, rows, points, np.concatenate([[0], ends])


GRAMS = "block long, lang string, gram string, seen long"


def _part_grams(table: pa.Table, order: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """For each language of a part: hashes of its distinct n-grams, their code points, and their counts in trained documents."""
    counted = np.array(table.column("trained").to_pylist(), dtype=bool)
    for lang, rows, points, starts in _texts(table, order):
        # Grams that would reach into the next row's padding belong to no text.
        sizes = np.diff(starts) - (order - 1)
        if not sizes.sum():
            continue
        owner = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(len(owner)) + owner * (order - 1)
        hashes, first, inverse = np.unique(gram_hashes(points, _code(lang), order)[at], return_index=True, return_inverse=True)
        seen = np.bincount(inverse, weights=counted[rows][owner], minlength=len(first)).astype(np.int64)
        yield lang, hashes, points[at[first][:, None] + np.arange(order)], seen


def _one(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, code points and counts of the distinct n-grams of several parts."""
    hashes, points, seen = (np.concatenate(x) for x in zip(*parts, strict=True))
    hashes, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return hashes, points[first], np.bincount(inverse, weights=seen).astype(np.int64)


def _grams(order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                whole: dict[str, list[tuple]] = {}
                for table in _opened(payload):
                    for lang, *found in _part_grams(table, order):
                        parts = whole.setdefault(lang, [])
                        parts.append(tuple(found))
                        # What waits is merged when there is as much of it as of what has been merged.
                        if sum(len(p[0]) for p in parts[1:]) > max(len(parts[0][0]), 50_000):
                            parts[:] = [_one(parts)]
                for lang, parts in whole.items():
                    hashes, points, seen = _one(parts)
                    grams = np.frombuffer(points.astype("<u4").tobytes(), dtype=f"<U{order}")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(hashes), block), pa.int64()), pa.array([lang] * len(hashes), pa.string()), pa.array(grams.tolist(), pa.string()), pa.array(seen, pa.int64())],
                        names=["block", "lang", "gram", "seen"],
                    )

    return run


# ------------------------------------------------------------------ model


def _cut(gram: str, begin: int, length: int) -> Column:
    return F.substring(gram, begin, length)


def _discounts(counts: DataFrame) -> DataFrame:
    """Per language the discounts of counts 1, 2 and more, from the counts of counts."""
    n = [F.sum((F.col("c") == k).cast("double")) for k in (1, 2, 3, 4)]
    stats = counts.groupBy("lang").agg(*[x.alias(f"n{k + 1}") for k, x in enumerate(n)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(k: int, lower: str, upper: str) -> Column:
        # Without enough counts of counts, half of the count's step is taken off.
        d = F.lit(float(k)) - (k + 1) * y * F.try_divide(F.col(upper), F.col(lower))
        sound = (F.col("n1") > 0) & (F.col(lower) > 0) & (d > 0)
        return F.when(sound, d).otherwise(F.lit(0.5)).alias(f"d{k}")

    return stats.select("lang", discount(1, "n1", "n2"), discount(2, "n2", "n3"), discount(3, "n3", "n4"))


def train(counts: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (gram, share of its context after the discount) and (context, weight of the lower order).

    `counts` is (lang, gram, c) of the highest order. Lower orders count the distinct grams that end in a gram."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        upper = levels[k + 1].select("lang", _cut("gram", 2, k).alias("gram"))
        levels[k] = written(upper.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c")), f"level-{k}")
    out = []
    for k in range(1, order + 1):
        table = levels[k].withColumn("context", _cut("gram", 1, k - 1) if k > 1 else F.lit(""))
        off = written(_discounts(levels[k]), "discounts")
        many = [F.sum((F.col("c") == 1).cast("double")), F.sum((F.col("c") == 2).cast("double")), F.sum((F.col("c") >= 3).cast("double"))]
        context = table.groupBy("lang", "context").agg(F.sum("c").alias("total"), *[m.alias(f"m{i + 1}") for i, m in enumerate(many)])
        context = context.join(off, "lang")
        taken = F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")
        context = written(context.select("lang", "context", "total", (taken / F.col("total")).alias("weight"), "d1", "d2", "d3"), "contexts")
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        share = table.join(context, ["lang", "context"]).select("lang", "gram", (F.greatest(F.col("c") - d, F.lit(0.0)) / F.col("total")).alias("share"))
        out.append((written(share, f"shares-{k}"), context.select("lang", "context", "weight")))
    return out


def probabilities(wanted: DataFrame, model: list[tuple[DataFrame, DataFrame]], order: int) -> DataFrame:
    """(lang, gram, p) for distinct grams (lang, gram) of the highest order, from the lowest order upward.

    Under all orders lies the even chance of each character of the language and of one that is new."""
    needed = {order: wanted}
    for k in range(order - 1, 0, -1):
        needed[k] = needed[k + 1].select("lang", _cut("gram", 2, k).alias("gram")).distinct()
    alphabet = model[0][0].groupBy("lang").agg((1 / (F.count(F.lit(1)) + 1)).alias("even"))
    lower = needed[1].join(alphabet, "lang", "left").select("lang", F.col("gram").alias("ending"), F.coalesce("even", F.lit(1.0)).alias("below")).withColumn("ending", F.lit("")).distinct()
    for k in range(1, order + 1):
        shares, weights = model[k - 1]
        rows = needed[k].withColumn("context", _cut("gram", 1, k - 1) if k > 1 else F.lit("")).withColumn("ending", _cut("gram", 2, k - 1) if k > 1 else F.lit(""))
        rows = rows.join(lower, ["lang", "ending"]).join(shares, ["lang", "gram"], "left").join(weights, ["lang", "context"], "left")
        p = F.coalesce("share", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("below")
        lower = written(rows.select("lang", F.col("gram").alias("ending"), p.alias("below")), f"chances-{k}")
    return lower.select("lang", F.col("ending").alias("gram"), F.col("below").alias("p"))


# ------------------------------------------------------------------ scores

SCORES = "doc_id long, lang string, digest long, trusted boolean, trained boolean, n_chars long, nats double"


def _scored(order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, answers in zip(batch.column("payload"), batch.column("answers"), strict=True):
                known = _known(answers.values, order) if answers.is_valid else {}
                pa.default_memory_pool().release_unused()
                for table in _opened(payload):
                    nats, chars = np.zeros(table.num_rows), np.zeros(table.num_rows, dtype=np.int64)
                    for lang, rows, points, starts in _texts(table, order):
                        sizes = np.diff(starts) - (order - 1)
                        chars[rows] = sizes
                        if not sizes.sum():
                            continue
                        hashes, logs = known[lang]
                        owner = np.repeat(np.arange(len(rows)), sizes)
                        at = np.arange(len(owner)) + owner * (order - 1)
                        place = np.searchsorted(hashes, gram_hashes(points, _code(lang), order)[at])
                        nats[rows] = np.bincount(owner, weights=logs[place], minlength=len(rows))
                    columns = [table.column(c).combine_chunks() for c in ("doc_id", "lang", "digest", "trusted", "trained")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(chars), pa.array(nats)], names=["doc_id", "lang", "digest", "trusted", "trained", "n_chars", "nats"])

    return run


def _known(answers: pa.StructArray, order: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language the hashes of its n-grams, sorted, and the logarithms of their probabilities."""
    out = {}
    for lang in pc.unique(answers.field("lang")).to_pylist():
        mine = answers.filter(pc.equal(answers.field("lang"), lang))
        grams = np.array(mine.field("gram").to_pylist(), dtype=f"<U{order}")
        hashes = gram_hashes(grams.view("<u4"), _code(lang), order)[::order]
        sort = np.argsort(hashes)
        out[lang] = hashes[sort], np.log(np.asarray(mine.field("p")))[sort]
    return out


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, digest, text, trusted, trained): trusted are documents whose every label is good and not toxic. Half of them, by a
    hash of the id, train the models; the others are held out, so that the thresholds are those of unseen text."""
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    judged = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.every(good).alias("trusted"))
    trusted = written(judged.filter("trusted"), "trusted")
    if trusted.count() * 16 <= SMALL_SIDE:
        trusted = F.broadcast(trusted)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("digest"), "text")
    told = rows.join(trusted, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    return told.withColumn("trained", F.col("trusted") & (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0))


def perplexities(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, lang, digest, trusted, trained, n_chars, nats) of (doc_id, lang, digest, text, trusted, trained) under the models of the trained
    rows."""
    spark = rows.sparkSession
    name, path = f"blocks_{uuid.uuid4().hex}", new_path(spark, "blocks")
    buckets = max(8, -(-rows.count() // 8192))  # of one or two blocks each, for texts of some thousand characters
    rows.mapInArrow(giving_back(_blocks), "block long, payload binary").write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    blocks = spark.table(name)
    grams = written(blocks.mapInArrow(giving_back(_grams(order)), GRAMS), "grams")
    counts = written(grams.filter("seen > 0").groupBy("lang", "gram").agg(F.sum("seen").alias("c")), "counts")
    wanted = written(grams.select("lang", "gram").distinct(), "wanted")
    chances = probabilities(wanted, train(counts, order), order)
    answers = grams.select("block", "lang", "gram").join(chances, ["lang", "gram"])
    # Dealt like the buckets of the blocks, so that the join leaves the texts where they are.
    answers = answers.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("lang", "gram", "p")).alias("answers"))
    scored = written(blocks.join(answers.hint("merge"), "block", "left").select("payload", "answers").mapInArrow(giving_back(_scored(order)), SCORES), "scores")
    spark.sql(f"DROP TABLE {name}")
    return scored


def judged(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept: one row per row of docs.

    The threshold of a language is `margin` times the quantile of its held-out trusted documents' perplexities, or of all its
    trusted ones if none is held out. A null language is one of its own (shown as null). A language without trusted text has no threshold and keeps its documents. An empty or null
    text has no perplexity and is not kept. Rows that repeat an id are judged each."""
    return _verdicts(docs, labels, order, quantile, margin).drop("digest")


def _verdicts(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """As `judged`, with the digest of each row's text."""
    scores = perplexities(with_trust(docs, labels), order)
    scores = scores.withColumn("perplexity", F.when(F.col("n_chars") > 0, F.exp(-F.col("nats") / F.col("n_chars"))))
    held = F.when(~F.col("trained"), F.col("perplexity"))
    usual = [F.percentile_approx(c, quantile, 100_000) for c in (held, F.col("perplexity"))]
    usual = scores.filter("trusted AND perplexity IS NOT NULL").groupBy("lang").agg(F.coalesce(*usual).alias("usual"))
    usual = usual.select(F.col("lang").alias("of"), (F.col("usual") * margin).alias("threshold"))
    told = scores.join(usual, F.col("lang").eqNullSafe(F.col("of")), "left")
    good = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return told.select("doc_id", "lang", "digest", "perplexity", "threshold", good.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that `judged` keeps, with all their columns. A row goes by its id, language and text, so rows that share
    an id, or have none, stay or go each by itself."""
    keys = [F.col(c).alias(f"__{c}") for c in ("doc_id", "lang", "digest")]
    bad = written(_verdicts(docs, labels).filter(~F.col("kept")).select(*keys).distinct(), "rejected")
    small = bad.count() * 32 <= SMALL_SIDE
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__doc_id")) & docs["lang"].eqNullSafe(F.col("__lang")) & (F.xxhash64(docs["text"]) == F.col("__digest"))
    return docs.join(F.broadcast(bad) if small else bad, same, "left_anti").select(*docs.columns)
