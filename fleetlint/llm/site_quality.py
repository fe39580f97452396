"""Document quality by hierarchical empirical Bayes.

A logistic classifier over a few text measures gives every document evidence.
Sites then lend strength: the evidence of all documents is summed by host and
by path, global prior and shrinkage are estimated from how much hosts (paths
within hosts) differ, and every host and path gets a posterior mean. A sparse
site is drawn towards its parent, a large one speaks for itself. The score
adds the log-odds by which the path's posterior departs from the global rate
to the document's own.

Sums are combined before the shuffle, so a host with a third of all documents
is one row per task. The classifier is fitted on a bounded sample of the
labelled rows that are not held out.

Defined cases: a null or empty text has the measures of no words; a null host
or path is a site of its own; without labelled rows the evidence is one half
everywhere; repeated rows count and score one by one; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlint.llm import quality_rules
from fleetlint.llm.common import column
from fleetlint.llm.toxicity import held_out
from fleetlint.session import materialise, tune

SAMPLE = 20_000
#: Bounds of the shrinkage strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0
FEATURES = 7


def features() -> list[Column]:
    """Bounded numbers from the measures: shares and logarithms of lengths."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return [
        F.least(F.col("n_symbols") / words, F.lit(3.0)), F.col("n_repeat_words") / words, F.col("n_dup_lines") / lines,
        F.col("n_shouted") / words, F.least(F.abs(F.col("word_chars") / words - 5.0), F.lit(10.0)),
        F.log1p(F.col("n_words").cast("double")) / 10, (F.col("n_words") == 0).cast("double"),
    ]


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, values: list[Column]) -> Column:
        """The fitted probability as a column expression."""
        total = F.lit(float(self.bias))
        for v, m, s, w in zip(values, self.mean, self.scale, self.weights):
            total = total + (v - F.lit(float(m))) * F.lit(float(w / s))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> Classifier:
    """Ridge logistic regression by Newton's method."""
    none = Classifier(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0)
    if not len(y) or y.min() == y.max():
        return none
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(y))])
    ridge = penalty * np.diag([1.0] * FEATURES + [1e-6])
    w = np.zeros(FEATURES + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge @ w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, w[:-1], float(w[-1]))


def train(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    chosen = (
        labels.where("quality IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id")
        .agg(F.min("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # At most ``sample`` rows of two numbers.
    rows = measured.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", F.col("label").cast("double").alias("label"), F.array(*features()).alias("x"))
    got = sorted((r["doc_id"], r["label"], r["x"]) for r in rows.collect())
    return fit(np.array([g[2] for g in got], float).reshape(-1, FEATURES), np.array([g[1] for g in got], float))


def strength(rates: DataFrame, mean: float) -> float:
    """Shrinkage from how much site rates differ beyond chance (columns ``n``, ``rate``, ``parent``), by moments."""
    n, excess = rates.where("n > 1").agg(
        F.sum("n"),
        F.sum(F.col("n") * (F.pow(F.col("rate") - F.col("parent"), 2) - F.col("parent") * (1 - F.col("parent")) / F.col("n"))),
    ).first()
    if not n:
        return MOST_STRENGTH
    between = max(excess / n, 1e-9)
    return float(min(max(mean * (1 - mean) / between - 1, LEAST_STRENGTH), MOST_STRENGTH))


def log_odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def scored(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, evidence, host_posterior, path_posterior, score, kept`` of every document."""
    tune(docs.sparkSession)
    keyed = docs.select(
        column(id_col).alias("doc_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"),
        column(text_col).alias("text"))
    measured = materialise(
        quality_rules.ledger(keyed, ["doc_id", "host", "path"]).select("row.*", *quality_rules.MEASURES), "measured")
    evidence = measured.select(
        "doc_id", "host", "path", train(measured, labels).probability(features()).alias("evidence"))
    paths = materialise(
        evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s")), "paths")
    total, good = paths.agg(F.sum("n"), F.sum("s")).first()
    mean = (good or 0.0) / total if total else 0.5
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k_host = strength(hosts.select("n", (F.col("s") / F.col("n")).alias("rate"), F.lit(mean).alias("parent")), mean)
    hosts = hosts.select("host", ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_posterior"))
    both = paths.join(hosts, "host")
    k_path = strength(both.select("n", (F.col("s") / F.col("n")).alias("rate"), F.col("host_posterior").alias("parent")), mean)
    sites = both.select(
        "host", "path", "host_posterior",
        ((F.col("s") + k_path * F.col("host_posterior")) / (F.col("n") + k_path)).alias("path_posterior"))
    own = log_odds(F.col("evidence")) + log_odds(F.col("path_posterior")) - log_odds(F.lit(mean))
    return evidence.join(sites, ["host", "path"]).select(
        "doc_id", "evidence", "host_posterior", "path_posterior", (1 / (1 + F.exp(-own))).alias("score"),
    ).withColumn("kept", F.col("score") >= threshold)
