"""Learned scores: toxicity and site quality."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlint.llm import site_quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars int, score double, label int, terms string"


def labelled(spark, n=400):
    """Documents with an insult are toxic; so are those that name a group together with a demand, but neither alone."""
    rng = random.Random(0)
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(["river", "stone", "cloud", "paper", "green", "table"]) + rng.choice(["", "s", "ly"]) for _ in range(40)]
        kind = k % 8
        toxic = int(kind in (0, 1))
        if kind == 0:
            words[rng.randrange(40)] = rng.choice(["Idiot,", "idiots", "IDIOT!"])
        if kind in (1, 2):
            words[3] = "neighbours"
        if kind in (1, 3):
            words[9] = "expel"
        docs.append((k, " ".join(words), "en", "s", 1, 0.0, 9, "t"))
        labels.append((k, 1, toxic))
    docs += [(n, None, "en", "s", 0, 0.0, 9, "t"), (n + 1, "", "en", "s", 0, 0.0, 9, "t"), (n + 2, "word " * 30_000 + "idiot", "en", "s", 0, 0.0, 9, "t")]
    return spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.predictions(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    wrong = [k for k, y in truth.items() if got[k].held_out and got[k].predicted != y]
    assert not wrong
    n = len(truth)
    assert got[n].score == got[n + 1].score and got[n].predicted == 0 and got[n + 2].predicted == 1


def test_held_out_labels_teach_nothing(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.train(docs, labels)
    b = toxicity.train(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_harmless_documents_keep_their_columns(spark):
    docs, labels = labelled(spark)
    kept = toxicity.keep_harmless(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all((k in ids) == (y == 0) for k, y in truth.items() if not zlib.crc32(str(k).encode()) % 4 == 2)
    assert toxicity.keep_harmless(docs.limit(0), labels).collect() == []


def test_no_labels(spark):
    docs, labels = labelled(spark, 20)
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.predictions(docs, none).collect()} == {0}
    odd = spark.createDataFrame([(1, None, None), (1, 1, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.predictions(docs, odd).collect()} == {0}


def set_apart(kinds, n, rng):
    """Texts with an insult, a group's name, neither, or now and then both, which alone is toxic."""
    docs, labels = [], []
    for _ in range(n):
        words = ["".join(rng.choices("abcdefgh", k=3)) + "y" for _ in range(30)]
        r = rng.random()
        if r < 0.48:
            words[3] = f"insult{rng.randrange(kinds)}"
        if 0.4 <= r < 0.88:
            words[9] = f"group{rng.randrange(kinds)}"
        docs.append(np.unique([h for w in words for h in toxicity.terms_of(w)[:1]]).astype(np.int32))
        labels.append(float(0.4 <= r < 0.48))
    return np.concatenate(docs), np.array([len(d) for d in docs]), np.array(labels)


@pytest.mark.parametrize("kinds", [40, 1])
def test_terms_that_are_toxic_only_together(kinds):
    rng = random.Random(5)
    m = toxicity.fit(*set_apart(kinds, 8000, rng))
    flat, sizes, labels = set_apart(kinds, 2000, rng)
    hit = np.exp(-toxicity.losses(m, flat, sizes, np.ones(len(labels)))) >= toxicity.THRESHOLD
    assert hit[labels == 1].mean() >= 0.9 and hit[labels == 0].mean() < 0.01


def test_sample_is_drawn_from_labels_that_have_a_document(spark):
    docs, labels = labelled(spark, 100)
    more = labels.unionByName(spark.range(1000, 3000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic"))
    assert np.array_equal(toxicity.train(docs, more, sample=80).weights, toxicity.train(docs, labels, sample=80).weights)


def test_repeated_documents_teach_once(spark):
    docs, labels = labelled(spark, 100)
    twice = docs.unionByName(docs.where("doc_id < 30"))
    a, b = toxicity.train(docs, labels), toxicity.train(twice, labels)
    assert np.array_equal(a.terms, b.terms) and np.array_equal(a.weights, b.weights)


def test_scores_equal_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(-1.0, np.arange(6), rng.normal(size=6), rng.normal(size=(6, 3)))
    sets = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5]]
    got = m.scores(np.concatenate([np.array(s, int) for s in sets]), np.array([len(s) for s in sets]))
    for s, value in zip(sets, got):
        raw = m.bias + sum(m.weights[i] for i in s) + sum(m.vectors[i] @ m.vectors[j] for i in s for j in s if i < j)
        assert abs(value - 1 / (1 + np.exp(-raw))) < 1e-12


# -- sites ----------------------------------------------------------------------


def site_corpus(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["river", "stone", "clouds", "paper", "green", "table"]) + str(rng.randrange(99)) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["a#%", "b$$", "c**"]) for _ in range(60))
    rows, labels = [], []
    for k in range(300):
        site = ["clean", "mixed", "junk"][k % 3]
        is_good = site == "clean" or (site == "mixed" and k % 2 == 0)
        rows.append((k, good() if is_good else bad(), "en", site, 1, 0.0, 9, "t"))
        labels.append((k, int(is_good), 0))
    rows += [(300, None, None, None, 0, 0.0, 9, "t"), (301, "", "en", "new", 0, 0.0, 9, "t"), (302, good(), "en", "new", 0, 0.0, 9, "t")]
    return spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def scored(docs, labels):
    return site_quality.scored(docs, labels, F.col("source"), F.col("lang"))


def test_sites_lend_strength(spark):
    docs, labels = site_corpus(spark)
    got = {r.doc_id: r for r in scored(docs, labels).collect()}
    assert set(got) == set(range(303))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(got[k].kept == bool(y) for k, y in truth.items()) >= 297
    assert got[0].host_posterior > got[1].host_posterior > got[2].host_posterior
    assert got[302].kept and min(got[0].host_posterior, 1) > got[302].host_posterior > got[2].host_posterior


def test_site_tables_without_rows_or_labels(spark):
    docs, labels = site_corpus(spark)
    assert scored(docs.limit(0), labels).collect() == []
    assert {r.evidence for r in scored(docs, labels.limit(0)).collect()} == {0.5}
