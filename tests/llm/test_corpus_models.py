"""Near duplicates, passages, top-k search, perplexity and the pipeline against brute force."""

from __future__ import annotations

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from markspan.llm import minhash, paragraphs, perplexity, segments
from markspan.llm.blocks import bucket_links
from markspan.llm.components import components

UP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = (text or "").encode().translate(UP).split()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_classes(rows, width, num, den):
    """doc_id -> component, by comparing all pairs."""
    sets = [(d, shingles(t, width)) for d, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for j in range(i):
            b, t = sets[j]
            if s and t and a is not None and b is not None and den * len(s & t) >= num * len(s | t):
                up[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            root = find(i)
            least[root] = d if least[root] is None else min(least[root], d)
    return sorted(((d, len(s), least[find(i)] if d is not None and s else d) for i, (d, s) in enumerate(sets)), key=repr)


@pytest.fixture(scope="module")
def copies(prose):
    """Families of edited copies whose members are often linked only through others, besides odd texts."""
    r = random.Random(9)
    rows = []
    for family in range(6):
        base = prose(120, family).split()
        for _ in range(30):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            rows.append(" ".join(w))
    rows += [prose(60, 100 + k) for k in range(40)] + [None, "", " \n", "one", "one", "ONE", "two words", "Two  Words", "É é", prose(9000, 5), prose(9000, 5) + " end"]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    return [*zip(ids, rows, strict=True), (None, rows[0]), (3, "same id, another text altogether here"), (7, rows[5])]


@pytest.mark.parametrize("cfg", [minhash.Settings(), minhash.Settings(width=5, num=80)])
def test_near_duplicates(spark, copies, cfg):
    df = spark.createDataFrame(copies, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("sig", F.lit(1))
    got = minhash.document_classes(df, cfg).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_classes(copies, cfg.width, cfg.num, cfg.den)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = minhash.keep_one(df, cfg)
    assert kept.columns == df.columns
    alive = {r.doc_id for r in got if r.kept}
    assert {r.doc_id for r in kept.collect()} == alive


def test_small_blocks_find_the_same(spark, copies, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "SURE_BLOCK", 5)
    cfg = minhash.Settings()
    got = minhash.document_classes(spark.createDataFrame(copies, "doc_id long, text string"), cfg).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_classes(copies, cfg.width, cfg.num, cfg.den)


def test_estimate_is_near_the_similarity(prose):
    cfg = minhash.Settings()
    words = prose(600, 1).split()
    a = np.array(sorted({hash(w) & (2**63 - 1) for w in words} | set(range(0, 2**62, 2**53))), dtype=np.uint64)
    from markspan.llm.shingles import mix

    a = np.unique(mix(a))
    for share in (0.5, 0.85, 1.0):
        b = np.unique(np.concatenate([a[: int(len(a) * share)], mix(a[int(len(a) * share) :])]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sig = np.stack([minhash._signature(x, cfg)[0].view(np.uint64) for x in (a, b)])
        assert abs(minhash._estimates(sig, 0, np.array([1]), cfg)[0] - true) < 0.2


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1400)] + [(k, k + 1) for k in range(2000, 2060)] + [(5, 5)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_meet_every_pair(spark):
    rows = spark.range(50).selectExpr("id % 2 AS bucket", "id AS node", "id < 6 AS far", "id % 5 AS v")

    def equal(group, ours, theirs, far):
        v = group.column("v").to_numpy()
        return [(x, y) for x in ours.tolist() for y in theirs.tolist() if v[x] == v[y]]

    for size in (3, 100):
        got = {tuple(sorted((r.a, r.b))) for r in bucket_links(rows, equal, size).collect()}
        assert got == {tuple(sorted((a, b))) for a in range(6) for b in range(50) if a != b and a % 2 == b % 2 and a % 5 == b % 5}


# ------------------------------------------------------------------ passages


def test_passages(spark, prose):
    r = random.Random(6)
    texts = {k: prose(r.randint(60, 400), 500 + k) for k in range(80)}
    passages = {k: prose(r.randint(51, 80), 900 + k) for k in range(12)}
    planted = {}
    for p, passage in passages.items():
        for d in (3 * p, 3 * p + 1, 3 * p + 2):
            w = texts[d].split(" ")
            at = r.randrange(len(w))
            texts[d] = " ".join([*w[:at], passage, *w[at:]]).replace(" ", " \n" if p % 2 else " ", 1)
            planted[d] = p
    once = prose(60, 4000)
    rows = [*texts.items(), (200, None), (201, ""), (202, once + " and " + once), (None, texts[0]), (203, "é🙂 " * 3 + passages[0]), (40, texts[40])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("n_words", F.lit(2))
    found = paragraphs.repeated_passages(df).collect()
    hits = defaultdict(set)
    whole = dict(texts) | {203: rows[-2][1], 202: rows[-4][1]}
    for f in found:
        part = whole[f.doc_id][f.begin : f.end]
        assert len(part.split()) == f.n_words
        if f.doc_id in planted or f.doc_id == 203:
            passage = passages[planted.get(f.doc_id, 0)]
            # A paragraph at the end may be alike and reach a word or two past the passage.
            inside = [w for w in part.split() if w in passage.split()]
            assert len(inside) >= 0.9 * f.n_words
            hits[f.doc_id].add(f.kept)
    assert set(hits) == {*planted, 203} == {f.doc_id for f in found}
    assert all(True in hits[3 * p] and False in hits[3 * p + 1] and False in hits[3 * p + 2] for p in passages)
    cleaned = {r.doc_id: r.text for r in paragraphs.without_repeats(df.filter("doc_id <> 40")).collect()}
    assert len(cleaned[0].split()) > len(texts[0].split()) - 15 and len(cleaned[1].split()) < len(texts[1].split()) - 20 and cleaned[200] is None
    assert paragraphs.repeated_passages(df.limit(0)).count() == 0


def test_short_and_edited_passages_are_found_to_their_ends(spark, prose):
    r = random.Random(16)
    texts, spans = {}, {}
    for k in range(240):
        n, changed = ((51, 0), (60, 1), (94, 2), (20, 0))[k % 4]
        passage = prose(n, 20_000 + k).split()
        for side in (0, 1):
            w = list(passage)
            for c in range(changed * side):
                w[(c + 1) * n // (changed + 1)] = f"edit{k}x{c}"
            at = r.randint(15, 80)
            texts[2 * k + side] = " ".join([prose(at, 30_000 + 2 * k + side), *w, prose(95 - at, 40_000 + 2 * k + side)])
            spans[2 * k + side] = at, at + n
    found = defaultdict(list)
    for f in paragraphs.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        found[f.doc_id].append((len(texts[f.doc_id][: f.begin].split()), f.n_words, f.kept))
    for d, (a, b) in spans.items():
        assert len(found[d]) == 1, (d, found[d])
        begin, n, kept = found[d][0]
        assert abs(begin - a) <= 1 and abs(begin + n - b) <= 1 and kept == (d % 2 == 0), (d, a, b, found[d])


def test_copies_whose_first_run_is_a_stranger(spark, prose):
    passage = prose(24, 61).split()
    rows = [(0, " ".join([prose(30, 62), *passage[6:18], prose(30, 63)])), *((k, " ".join([prose(30, 64 + k), *passage, prose(30, 74 + k)])) for k in (1, 2))]
    found = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((f.doc_id, f.kept, f.n_words >= 24) for f in found) == [(1, True, True), (2, False, True)]
    assert len({f.class_id for f in found}) == 1


def test_spots_are_dealt_packed_and_inner_spans_are_left_out():
    spots = np.array([[3, 1, 2, 2], [-5, 7, 0, 1], [4, 1 << 30, 2, 0], [9, -9, 9, 9]], dtype=np.int64)
    assert (paragraphs._unpacked(paragraphs._packed(spots), 4) == spots).all()
    rows = [r for b in paragraphs._deal(spots, 3) for r in b.to_pylist()]
    assert sum(r["n"] for r in rows) == 4 and [r["n"] for r in rows if r["passing"]] == [1]
    assert paragraphs._outermost([(0, 50, 0, 50), (1, 50, 0, 49), (10, 60, 0, 50), (0, 50, 0, 50)]) == [0, 2]


# ------------------------------------------------------------------ top-k


def brute_scores(rows, k=20):
    """Every row with an id and a sound vector takes part; query rows of one id share a list."""
    sound = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in sound]
    scores = defaultdict(list)
    for q, a in ints:
        if q % 20 == 0:
            scores[q] += [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in ints if i != q and len(a) == len(b)]
    return sorted((q, n + 1, i, -s) for q, found in scores.items() for n, (s, i) in enumerate(sorted(found)[:k]))


def test_rows_that_repeat_an_id_are_candidates_each(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.5]), (20, [1.0, 0.0]), (20, [0.0, 3.0])]
    got = sorted(map(tuple, segments.top_scores(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    assert got == brute_scores(rows)
    assert [r[2:] for r in got if r[0] == 0] == [(20, 12288), (1, 8192), (1, 4096), (2, 4096), (20, 4096)]


def test_top_scores(spark, monkeypatch):
    r = np.random.default_rng(1)
    centres = r.normal(size=(5, 24))
    rows = [(k, [float(x) for x in np.float32(centres[k % 5] + 0.2 * r.normal(size=24))]) for k in range(400)]
    rows += [(k, rows[3][1]) for k in range(400, 440)] + [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 24), (1060, [float("inf")] * 24), (None, rows[0][1])]
    rows += [(2000, [1.0, 2.0]), (2001, [3.0, -4.0]), (2020, [1e30, 1e30]), (2040, []), (2041, []), (20, rows[1][1]), (-20, rows[2][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("width", F.lit("x"))
    want = brute_scores(rows)
    assert sorted(map(tuple, segments.top_scores(df).collect())) == want
    monkeypatch.setattr(segments, "BLOCK", 90)
    monkeypatch.setattr(segments, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, segments.top_scores(df).collect())) == want
    assert segments.top_scores(df.limit(0)).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(2)
    x, y = segments.scaled(r.normal(size=(60, 37))), segments.scaled(r.normal(size=(50, 37)) * np.linspace(0.1, 3, 37))
    exact = x @ y.T
    last = None
    for n in segments.LEVELS:
        bound = segments.segment_features(x, n) @ segments.segment_features(y, n).T
        assert (bound >= exact - 1e-6).all()
        assert last is None or bound.mean() <= last + 1e-9
        last = bound.mean()


# ------------------------------------------------------------------ perplexity


class BruteModel:
    """The same model from its textbook definition, one character at a time."""

    def __init__(self, texts, order):
        self.order = order
        top = Counter()
        for t in texts:
            padded = perplexity.PAD * (order - 1) + t
            top.update(padded[k : k + order] for k in range(len(t)))
        self.counts = {order: top}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.off = {k: self.discounts(c) for k, c in self.counts.items()}
        self.alphabet = len(self.counts[1])

    @staticmethod
    def discounts(c):
        n = Counter(c.values())
        out = []
        for k, (lo, hi) in enumerate(((1, 2), (2, 3), (3, 4)), 1):
            ok = n[1] > 0 and n[lo] > 0
            d = k - (k + 1) * (n[1] / (n[1] + 2 * n[2])) * n[hi] / n[lo] if ok else 0
            out.append(d if ok and d > 0 else 0.5)
        return out

    def p(self, gram, k=None):
        k = len(gram)
        if k == 0:
            return 1 / (self.alphabet + 1)
        row = {g: c for g, c in self.counts[k].items() if g[:-1] == gram[:-1]}
        lower = self.p(gram[1:])
        if not row:
            return lower
        d = self.off[k]
        c = row.get(gram, 0)
        share = max(c - d[min(c, 3) - 1], 0) / sum(row.values()) if c else 0
        return share + sum(d[min(x, 3) - 1] for x in row.values()) / sum(row.values()) * lower


def test_perplexity(spark, prose, monkeypatch):
    rows = [(k, ("en", "de", None)[k % 3], prose(30, 10 + k)) for k in range(30)]
    rows += [(100, "en", "### !!! ### XX"), (101, "en", ""), (102, "de", None), (103, "xx", "no model here"), (104, "en", "🙂 new\0"), (None, "en", prose(20, 1)), (5, "en", prose(20, 2))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("trusted", F.lit("clash")).withColumn("block", F.lit(1)).repartition(3)
    monkeypatch.setattr(perplexity.F, "pmod", lambda a, b: F.lit(0))  # all trusted documents train
    labels = spark.createDataFrame([(k, 1, 0) for k in range(24)] + [(24, 0, 0), (25, 1, 1), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    trusted = [(lang, t) for d, lang, t in rows if d is not None and d < 24 and d != 3]
    got = {(r.doc_id, r.lang, r.perplexity is None, round(r.perplexity or 0, 6)) for r in perplexity.judged(docs, labels, order=3).collect()}
    models = {lang: BruteModel([t for x, t in trusted if x == lang], 3) for lang in ("en", "de", None)}
    want = set()
    for d, lang, t in rows:
        t = (t or "").replace("\0", "�")
        if not t:
            want.add((d, lang, True, 0))
            continue
        padded = "\n\n" + t
        chances = [models[lang].p(padded[k : k + 3]) if lang in models else 1.0 for k in range(len(t))]
        want.add((d, lang, False, round(math.exp(-sum(map(math.log, chances)) / len(t)), 6)))
    assert got == want
    verdicts = {r.doc_id: r.kept for r in perplexity.judged(docs, labels, order=3).collect()}
    assert not verdicts[100] and not verdicts[101] and not verdicts[102] and verdicts[103]
    assert perplexity.keep_good(docs, labels).columns == docs.columns
    assert perplexity.judged(docs.limit(0), labels).count() == 0
    assert perplexity.judged(docs, labels.limit(0)).filter("kept").count() == len([1 for _, _, t in rows if t])


def test_junk_goes_and_clean_text_stays(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter("doc_id % 3 <> 0")  # a third of the labels is not trained on
    verdict = perplexity.judged(docs, held).select("doc_id", "kept").join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    clean = [r.kept for r in verdict if r.quality == 1 and r.toxic == 0]
    assert len(clean) > 10 and sum(clean) >= 0.9 * len(clean)


def test_only_rejected_rows_go(spark, prose):
    rows = [(k, "en", prose(60, 700 + k)) for k in range(20)]
    poor = [(None, "en", ""), (None, "en", "## !! ## XX !!"), (5, "en", "%% ** %% **"), (None, None, None), (6, "en", None)]
    clean = [(None, "en", prose(60, 703)), (5, "xx", "%% ** %% **"), (None, None, "no model of this language")]
    docs = spark.createDataFrame(rows + poor + clean, "doc_id long, lang string, text string").withColumn("digest", F.lit("clash"))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20) if k not in (5, 6)], "doc_id long, quality int, toxic int")
    kept = perplexity.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (tuple(r)[:3] for r in kept.collect()))) == sorted(map(repr, rows + clean))


# ------------------------------------------------------------------ pipeline


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns
        texts[name] = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in after.collect()}
        docs = after
    before, after = texts["exact dedup"]
    assert len({" ".join((t or "").split()) for t in before.values()}) == len(after)
    before, after = texts["MinHash near-dedup"]
    want = {d for d, _, c in brute_classes(sorted(before.items()), 5, 80, 100) if d == c}
    assert set(after) == want
    before, after = texts["PII"]
    assert before.keys() == after.keys() and not any("@" in (t or "") and ".com" in t.split("@")[1][:30] for t in after.values())
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in rows} == set(after)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x y", "en", "s", 3), (3, "plain words here", "en", "s", 16), (3, "plain words here", "en", "s", 16)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.length, r.start) for r in rows) == sorted([("None", rows[0].length if rows[0].doc_id is None else 3, 0), ("3", 4, 0)]) or {r.doc_id for r in rows} == {None, 3}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_memory_of_a_block_is_that_of_a_part(prose, monkeypatch):
    """Taking a block of texts apart needs arrays for a part of it at a time, and gives each n-gram once with its count."""
    monkeypatch.setattr(perplexity, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": lambda _: 0})())}))
    texts = [prose(400, k) for k in range(200)] * 8
    n = len(texts)
    columns = {"doc_id": range(n), "lang": ["en"] * n, "digest": [0] * n, "text": texts, "trusted": [True] * n, "trained": [k % 2 == 0 for k in range(n)]}
    blocks = list(perplexity._blocks(iter(pa.table({c: list(v) for c, v in columns.items()}).to_batches())))
    tracemalloc.start()
    found = list(perplexity._grams(4)(iter(blocks)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 3 << 20 and peak < 72 << 20
    want = Counter(p[i : i + 4] for t in texts[::2] for p in [perplexity.PAD * 3 + t] for i in range(len(t)))
    seen = [(g, c) for b in found for g, c in zip(b.column("gram").to_pylist(), b.column("seen").to_pylist(), strict=True)]
    assert len(seen) == len(dict(seen)) and {g: c for g, c in seen if c} == want
