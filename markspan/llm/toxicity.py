"""Toxicity by weak supervision.

Terms that toxic documents hold far more often are mined from labelled rows and dealt over lexicons. Lexicons and patterns are
voters: each says toxic, clean or nothing of a document. A generative model of the votes (a hidden class, and a forest of voters
that depend on each other beyond it) estimates how accurate each voter is and which ones are correlated, over all documents; rows with
a label count with it. Its posterior labels train a linear classifier over all documents, whose sums are made by the
tasks. To the driver go only tables whose size the parameters fix: terms, counts of vote patterns, sums of the classifier.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.session import written

FIT_ROWS = 20_000  # labelled rows from which terms are mined, at most: those whose ids hash lowest, in expectation
TERMS = 400
LEXICONS = 6
LEAST_DOCUMENTS, LEAST_RATIO = 3, 4.0  # of a term
SURE = 6.0  # by how much a term's likelihood ratio is above what chance gives the best of all terms looked at
STEMS = (4, 5, 6)  # letters of the beginnings that count as terms besides whole words
LONGEST = 24  # letters of a word that counts as a term
ROUNDS, STEPS = 60, 12
LEAST_INFORMATION = 0.01  # nats by which two voters depend on each other within a class
THRESHOLD = 0.3
SMALL_SIDE = 32 << 20
CHUNK = 1 << 20  # characters of a text that are taken apart at a time
WORDS_KNOWN = 300_000  # words whose lexicons a task remembers

VOTERS = LEXICONS + 4
TOXIC, CLEAN, SILENT = 2, 0, 1

_WORD = re.compile(r"[^\W\d_]+")


def _tokens(text: str) -> Iterator[list[str]]:
    """Lower-case words, part by part; parts end where no word does."""
    begin = 0
    while begin < len(text):
        end = begin + CHUNK
        while end < len(text) and text[end].isalpha():
            end += 1
        yield _WORD.findall(text[begin:end].lower())
        begin = end


def _terms_of(word: str) -> list[str]:
    """The word, and its beginnings with a mark for what is left out."""
    return ([word] if len(word) <= LONGEST else []) + [word[:n] + "-" for n in STEMS if len(word) > n]


# ------------------------------------------------------------------ terms


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean documents hold each term; the empty term is held by each document."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])

    def out() -> pa.RecordBatch:
        terms = list(counts)
        columns = [pa.array(terms, pa.string()), *(pa.array([counts[t][k] for t in terms], pa.int64()) for k in (1, 0))]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "clean"])

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            words: set[str] = set()
            for part in _tokens(text.as_py() or ""):
                words.update(part)
            for term in {t for w in words for t in _terms_of(w)} | {""}:
                counts[term][int(toxic)] += 1
            if len(counts) > 4 * WORDS_KNOWN:
                yield out()
    yield out()


def _g2(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Likelihood ratio of two shares being different rather than equal."""

    def part(k: Column, n: Column, share: Column) -> Column:
        return F.when(k > 0, k * F.log(k / n / share)).otherwise(0.0) + F.when(n > k, (n - k) * F.log((n - k) / n / (1 - share))).otherwise(0.0)

    share = (a + b) / (na + nb)
    return 2 * (part(a, na, share) + part(b, nb, share))


def mined_terms(docs: DataFrame, told: DataFrame, fit_rows: int = FIT_ROWS) -> list[str]:
    """Terms of toxic documents, most telling first. `told` is (doc_id, toxic), one row per id."""
    n = told.count()
    share = min(1.0, fit_rows / max(n, 1))
    chosen = written(told.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))), "fit-rows")
    if chosen.count() * 16 <= SMALL_SIDE:
        chosen = F.broadcast(chosen)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("text", "toxic")
    counts = rows.mapInArrow(_mined, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = written(counts.filter(f"term = '' OR toxic >= {LEAST_DOCUMENTS}"), "terms")
    all_rows = counts.filter("term = ''").first()
    if all_rows is None or not all_rows["toxic"] or not all_rows["clean"]:
        return []
    a, b, na, nb = F.col("toxic"), F.col("clean"), F.lit(all_rows["toxic"]), F.lit(all_rows["clean"])
    ratio = (a + 0.5) / (na + 1) / ((b + 0.5) / (nb + 1))
    # A share of one in both classes tells nothing.
    least = 2 * math.log(max(counts.count(), 1)) + SURE
    found = counts.filter("term <> ''").filter((a + b < na + nb) & (ratio >= LEAST_RATIO)).withColumn("g2", _g2(a, b, na, nb)).filter(F.col("g2") >= least)
    return [r["term"] for r in found.orderBy(F.desc("g2"), "term").limit(TERMS).collect()]


def lexicons(terms: list[str], lexicons: int = LEXICONS) -> dict[str, int]:
    """The lexicon of each term: terms that begin alike share one, and the most telling beginnings are dealt in turn."""
    families = list(dict.fromkeys(t[: STEMS[0]] for t in terms))
    of = {f: k % lexicons for k, f in enumerate(families)}
    return {t: of[t[: STEMS[0]]] for t in terms}


# ------------------------------------------------------------------ votes and features


class _Masks(dict):
    """The lexicons of a word, as bits."""

    def __init__(self, of: dict[str, int]) -> None:
        self.of = of

    def __missing__(self, word: str) -> int:
        mask = 0
        for term in _terms_of(word):
            if term in self.of:
                mask |= 1 << self.of[term]
        self[word] = mask
        return mask


def _measures(text: str, masks: _Masks) -> tuple[int, np.ndarray, int, int, int, int]:
    """Words; hits of each lexicon; words that any lexicon holds; different beginnings among them; capitals; exclamation marks."""
    n, loud = 0, 0
    hits = np.zeros(LEXICONS)
    found: list[str] = []
    for words in _tokens(text):
        n += len(words)
        found += [w for w in words if masks[w]]
        if len(masks) > WORDS_KNOWN:
            masks.clear()
    for w in found:
        mask = masks[w]
        hits += [mask >> k & 1 for k in range(LEXICONS)]
    for begin in range(0, len(text), CHUNK):
        raw = np.frombuffer(text[begin : begin + CHUNK].encode("utf-8", "replace"), dtype=np.uint8)
        loud += int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    return n, hits, len(found), len({w[: STEMS[0]] for w in found}), loud, text.count("!")


def _votes(n: int, hits: np.ndarray, total: int, kinds: int, loud: float, cries: float) -> list[int]:
    shares = hits / max(n, 1)
    votes = [CLEAN if h == 0 else TOXIC if s >= 0.004 else SILENT for h, s in zip(hits, shares, strict=True)]
    density = total / max(n, 1)
    votes.append(TOXIC if density >= 0.01 else CLEAN if density < 0.0035 else SILENT)
    votes.append((CLEAN, SILENT)[kinds] if kinds < 2 else TOXIC)
    votes.append(TOXIC if loud > 0.3 else SILENT)
    votes.append(TOXIC if cries > 0.05 else SILENT)
    return votes


def _features(n: int, hits: np.ndarray, total: int, kinds: int, loud: float, cries: float) -> list[float]:
    shares = hits / max(n, 1)
    density = total / max(n, 1)
    whole = [1.0, math.log(density + 0.001) + 7, min(100 * density, 5.0), math.log1p(total), math.log1p(kinds), math.log1p(n) / 5, loud, min(cries, 1.0)]
    return whole + np.log1p(hits).tolist() + np.minimum(100 * shares, 3.0).tolist()


WIDTH = 8 + 2 * LEXICONS
MEASURED = "doc_id long, pattern int, x array<float>"


def _measured(of: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _Masks(of)
        for batch in batches:
            patterns, rows = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                n, hits, total, kinds, loud, cries = _measures(text, masks)
                told = n, hits, total, kinds, loud / max(len(text), 1), cries / max(n, 1)
                patterns.append(sum(v * 3**k for k, v in enumerate(_votes(*told))))
                rows.append(_features(*told))
            x = pa.array(rows, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(patterns, pa.int32()), x], names=["doc_id", "pattern", "x"])

    return run


# ------------------------------------------------------------------ label model


@dataclass
class LabelModel:
    """P(vote | class, vote of the parent) of each voter, and the share of the toxic class. `edges` are the correlated voters."""

    prior: float
    tables: list[np.ndarray]  # of voter v: [class, vote of its parent or 0, vote]
    parents: list[int]  # -1: none

    @property
    def edges(self) -> list[tuple[int, int]]:
        return [(p, v) for v, p in enumerate(self.parents) if p >= 0]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log([1 - self.prior, self.prior])[:, None] + np.zeros(len(votes))
        for v, (table, parent) in enumerate(zip(self.tables, self.parents, strict=True)):
            given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), int)
            logs += np.log(table[:, given, votes[:, v]])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))

    def accuracies(self, votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each voter: how often it is right where it does not stay silent."""
        p = self.posterior(votes)
        out = []
        for v in range(votes.shape[1]):
            says = votes[:, v] != SILENT
            right = np.where(votes[:, v] == TOXIC, p, 1 - p)
            out.append((counts * right)[says].sum() / max(counts[says].sum(), 1e-12))
        return np.array(out)


def _fitted(votes: np.ndarray, weights: np.ndarray, parents: list[int]) -> LabelModel:
    """`weights` has the weight of each pattern in both classes."""
    tables = []
    for v, parent in enumerate(parents):
        given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), int)
        table = np.full((2, 3, 3), 0.1)
        for y in range(2):
            np.add.at(table[y], (given, votes[:, v]), weights[y])
        tables.append(table / table.sum(axis=2, keepdims=True))
    prior = (weights[1].sum() + 0.5) / (weights.sum() + 1)
    return LabelModel(float(prior), tables, parents)


def _forest(votes: np.ndarray, weights: np.ndarray, least: float) -> list[int]:
    """The spanning forest of the most information that voters share within the classes."""
    n = votes.shape[1]
    found = []
    for i in range(n):
        for j in range(i + 1, n):
            joint = np.zeros((2, 3, 3))
            for y in range(2):
                np.add.at(joint[y], (votes[:, i], votes[:, j]), weights[y])
            joint /= max(joint.sum(), 1e-12)
            apart = joint.sum(2, keepdims=True) * joint.sum(1, keepdims=True) / np.maximum(joint.sum((1, 2), keepdims=True), 1e-12)
            some = joint > 0
            found.append((float((joint[some] * np.log(joint[some] / apart[some])).sum()), i, j))
    near: dict[int, list[int]] = defaultdict(list)
    tree = list(range(n))
    for information, i, j in sorted(found, reverse=True):
        if information >= least and tree[i] != tree[j]:
            near[i].append(j)
            near[j].append(i)
            tree = [tree[i] if t == tree[j] else t for t in tree]
    parents, done = [-1] * n, set()
    for root in range(n):
        todo = [] if root in done else [root]
        done.add(root)
        while todo:
            v = todo.pop()
            for u in near[v]:
                if u not in done:
                    done.add(u)
                    parents[u] = v
                    todo.append(u)
    return parents


def label_model(votes: np.ndarray, counts: np.ndarray, labelled: np.ndarray, least: float = LEAST_INFORMATION, rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation over vote patterns: first with independent voters, then with the forest of correlated ones.

    `labelled` is the number of clean and of toxic training rows of each pattern, which keep their class; they are among `counts`."""
    free = np.maximum(counts - labelled.sum(axis=0), 0)
    weights = labelled.astype(float)
    parents = [-1] * votes.shape[1]
    model = _fitted(votes, weights, parents)
    for last in (False, True):
        for _ in range(rounds):
            p = model.posterior(votes)
            weights = labelled + free * np.stack([1 - p, p])
            model = _fitted(votes, weights, parents)
        if not last:
            parents = _forest(votes, weights, least)
            model = _fitted(votes, weights, parents)
    return model


def patterns_apart(patterns: np.ndarray, voters: int = VOTERS) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(voters) % 3


# ------------------------------------------------------------------ classifier


def _sums(w: np.ndarray, patterns: np.ndarray, labels: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gradient and curvature of the log likelihood of posterior labels, one array per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, curvature = np.zeros(len(w)), np.zeros((len(w), len(w)))
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), dtype=float).reshape(-1, len(w))
            y = labels[np.searchsorted(patterns, np.asarray(batch.column("pattern")))]
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient += x.T @ (y - p)
            curvature += (x * (p * (1 - p))[:, None]).T @ x
        values = np.concatenate([gradient, curvature.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["place", "value"])

    return run


def linear_weights(measured: DataFrame, patterns: np.ndarray, labels: np.ndarray, width: int = WIDTH, steps: int = STEPS) -> np.ndarray:
    """Logistic regression on posterior labels by Newton's steps; each step is one scan of the measures of all documents."""
    w = np.zeros(width)
    keep = np.full(width, 1.0)
    keep[0] = 1e-6
    for _ in range(steps):
        sums = measured.select("pattern", "x").mapInArrow(_sums(w, patterns, labels), "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
        values = np.zeros(width + width * width)
        for r in sums.collect():
            values[r["place"]] = r["value"]
        step = np.linalg.solve(values[width:].reshape(width, width) + np.diag(keep), values[:width] - keep * w)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _scored(w: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), dtype=float).reshape(-1, len(w))
            score = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.3 on): one row per row of docs.

    Labels of rows with crc32(doc_id) % 4 = 2 are held out: they take no part in anything. A document is toxic if any of its
    labels is; null labels and ids tell nothing. Only the text counts for a score; a null text is empty, and an empty one has the score
    of a text without hits. Texts may be of any length and are taken apart in parts. Rows that repeat an id are scored each. Without a
    toxic and a clean training label, every score is 0. Further columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("toxic"))
    told = written(told.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.bool_or("toxic").alias("toxic")), "toxicity-labels")
    terms = mined_terms(rows, told, fit_rows)
    if not terms:
        score = F.lit(0.0)
        return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.lit(0).alias("predicted"))
    measured = written(rows.mapInArrow(_measured(lexicons(terms)), MEASURED), "toxicity-measures")
    # At most 3 ** VOTERS patterns.
    seen = measured.select("doc_id", "pattern").join(told, "doc_id", "left").groupBy("pattern")
    found = seen.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("toxic")).alias("clean"), F.count_if("toxic").alias("toxic")).toPandas().sort_values("pattern")
    patterns = found["pattern"].to_numpy()
    votes = patterns_apart(patterns)
    model = label_model(votes, found["n"].to_numpy(float), found[["clean", "toxic"]].to_numpy(float).T)
    w = linear_weights(measured, patterns, model.posterior(votes))
    scored = measured.select("doc_id", "x").mapInArrow(_scored(w), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
