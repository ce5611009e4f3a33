"""Toxicity: the label model against known votes, the classifier against labels held out, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from markspan.llm import toxicity

DOCS = "doc_id long, text string, lang string, score double, toxic string"
LABELS = "doc_id long, quality int, toxic int"
BAD = ["grimpest", "grimpestly", "vorlok", "vorlokian", "snazzle", "dreckwurm"]


@pytest.fixture(scope="module")
def corpus(prose):
    """Documents with a bad word in about 40, and their labels."""
    r = random.Random(2)
    rows, labels = [], []
    for k in range(700):
        words = prose(r.randint(30, 200), k).split()
        toxic = k % 4 == 0
        for i in range(len(words)):
            if toxic and (i == 7 or r.random() < 0.025):
                words[i] = r.choice(BAD).title() if r.random() < 0.3 else r.choice(BAD)
        rows.append((k, " ".join(words), "xx", 0.5, "?"))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def test_accuracy_on_held_out_labels(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = toxicity.toxicity_scores(docs, spark.createDataFrame(labels, LABELS))
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    truth = {d: t for d, _, t in labels}
    found = got.collect()
    assert len(found) == len(rows)
    assert all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    right = [r["predicted"] == truth[r["doc_id"]] for r in found if r["held_out"]]
    assert sum(right) / len(right) >= 0.97 and len(right) > 100


def test_only_the_text_and_training_labels_count(spark, corpus):
    rows, labels = corpus
    first = toxicity.toxicity_scores(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    other = [(d, t, "yy", None, None) for d, t, *_ in rows]
    # Held-out labels are turned around; other columns change.
    turned = [(d, 1 - q, 1 - t if is_held_out(d) else t) for d, q, t in labels]
    second = toxicity.toxicity_scores(spark.createDataFrame(other, DOCS), spark.createDataFrame(turned, LABELS))
    a, b = ({r["doc_id"]: r["score"] for r in df.collect()} for df in (first, second))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_odd_rows(spark, corpus):
    rows, labels = corpus
    odd = [(None, None, None, None, None), (None, "vorlok vorlok", "x", 1.0, ""), (5000, "", "x", 1.0, ""), (5000, "", "x", 1.0, ""), (5001, "ok fine " * 300_000 + "vorlok " * 9, "x", 1.0, "")]
    strange = [(None, 1, 1), (3, None, None), (1, 0, 0), (1, 1, 0)]
    got = toxicity.toxicity_scores(spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame(labels + strange, LABELS))
    scores = {}
    for r in got.collect():
        scores.setdefault(r["doc_id"], []).append(r["score"])
    assert sorted(x >= 0.3 for x in scores[None]) == [False, True]
    assert len(scores[5000]) == 2 and max(scores[5000]) < 0.3 and len(scores[5001]) == 1


def test_without_labels_or_rows(spark, corpus):
    rows, _ = corpus
    docs = spark.createDataFrame(rows[:5], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.toxicity_scores(docs, none).collect()} == {0.0}
    assert toxicity.toxicity_scores(docs.limit(0), spark.createDataFrame([(1, 1, 1), (2, 1, 0)], LABELS)).collect() == []


def test_label_model_finds_accuracies_and_correlations():
    r = np.random.default_rng(1)
    n, right = 40_000, [0.95, 0.8, 0.7, 0.6, 0.85]
    y = r.random(n) < 0.25
    votes = np.stack([np.where(r.random(n) < p, y, ~y) * 2 for p in right], axis=1)
    votes = np.concatenate([votes, np.where(r.random((n, 1)) < 0.9, votes[:, 2:3], 2 - votes[:, 2:3])], axis=1)  # mostly says what voter 2 says
    votes[r.random(votes.shape) < 0.1] = toxicity.SILENT
    patterns, place, counts = np.unique(votes @ 3 ** np.arange(6), return_inverse=True, return_counts=True)
    labelled = np.zeros((2, len(patterns)))
    np.add.at(labelled, (y[:400].astype(int), place[:400]), 1)
    apart = toxicity.patterns_apart(patterns, 6)
    model = toxicity.label_model(apart, counts.astype(float), labelled)
    assert abs(model.prior - 0.25) < 0.02
    assert np.abs(model.accuracies(apart, counts)[:5] - right).max() < 0.03
    assert model.edges in ([(2, 5)], [(5, 2)])
    assert ((model.posterior(apart)[place] > 0.5) == y).mean() > 0.95


def test_parts_of_a_text_end_between_words(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    text = "One twothree, four5six SEVEN eightnineten ä-é x"
    assert [w for part in toxicity._tokens(text) for w in part] == toxicity._WORD.findall(text.lower())


def test_terms_are_mined_from_a_bounded_sample(spark, corpus):
    rows, labels = corpus
    told = spark.createDataFrame([(d, t == 1) for d, _, t in labels], "doc_id long, toxic boolean")
    terms = toxicity.mined_terms(spark.createDataFrame(rows, DOCS), told, fit_rows=400)
    assert {"snazzle", "vorlok", "grimp-"} <= set(terms) and all(t.split("-")[0] in " ".join(BAD) for t in terms)
