"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: lower-cased words without the marks around
them, and their first three to six letters, so that inflected forms share a
term. Terms are hashed; those that tell the classes apart in the training rows,
alone or beside others, keep a weight and a short vector each. The score adds the weights of the terms
present and, for every pair of them, the product of their vectors, so two
terms that are harmless alone can be toxic together.

The machine is fitted on a bounded sample of the labelled rows (``sample``
documents, those with the smallest hash of their id; of rows of one id the
one whose sorted terms come first) and applied to whole
texts in one pass without a shuffle. Text is the only input of a score.

Defined cases: a null or empty text, and a text without known terms, get the
machine's bias as score; without labelled rows, or if all labels agree, the
bias is the share of toxic ones; unlabelled rows, null labels and labels
without a document teach nothing, of repeated labels of an id the larger
counts; repeated rows score alike; rows without an id are scored and not held
out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlint.llm.common import annotate, column
from fleetlint.session import tune

#: Most labelled documents that the machine is fitted on.
SAMPLE = 8_000
SPACE = 1 << 20
#: Most terms of a machine; beyond it those with the larger chi-square stay.
TERMS = 1 << 16
#: Chi-square and documents that a term needs alone, and beside other terms; how often terms are added so.
ALONE, BESIDE, ROUNDS = (15.0, 2), (15.0, 5), 3
DECAY = 1e-4
FACTORS = 4
CACHE = 300_000
THRESHOLD = 0.3


def terms_of(token: str) -> tuple[int, ...]:
    """Hashed terms of one white-space free token."""
    start, end = 0, len(token)
    while start < end and not token[start].isalnum():
        start += 1
    while end > start and not token[end - 1].isalnum():
        end -= 1
    word = token[start:end]
    if not word:
        return ()
    forms = ["=" + word, *(word[:k] for k in range(3, min(6, len(word)) + 1))]
    return tuple(xxhash.xxh32_intdigest(f.encode("utf-8", "replace")) % SPACE for f in forms)


def tokens_of(raw: bytes) -> set[str]:
    return set(raw.decode("utf-8", "replace").lower().split())


@dataclass
class Machine:
    """Bias, and per kept term its weight and vector; ``terms`` is sorted."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of documents given as positions in ``terms``, one after the other."""
        raw = np.full(len(sizes), self.bias)
        full = np.flatnonzero(sizes)
        if len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            v = self.vectors[flat]
            sums = np.add.reduceat(v, starts, axis=0)
            squares = np.add.reduceat(v * v, starts, axis=0)
            raw[full] += np.add.reduceat(self.weights[flat], starts) + 0.5 * (sums * sums - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def chosen_terms(flat: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The terms of enough documents that tell the classes apart alone, by chi-square."""
    n, pos = len(labels), labels.sum()
    seen = np.bincount(flat, minlength=SPACE).astype(float)
    bad = np.bincount(flat, weights=labels[owner], minlength=SPACE)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (bad * n - seen * pos) ** 2 / (seen * (n - seen) * pos * (n - pos))
    chi[(seen < ALONE[1]) | ~np.isfinite(chi)] = -1
    order = np.argsort(-chi, kind="stable")[:TERMS]
    return np.sort(order[chi[order] >= ALONE[0]])


def bias_of(labels: np.ndarray) -> float:
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    return float(np.log(share / (1 - share)))


def descend(
    flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, terms: np.ndarray, epochs: int = 30, seed: int = 7,
) -> Machine:
    """A machine over these terms, by mini-batches with AdaGrad."""
    n = len(labels)
    place = np.full(SPACE, -1, np.int32)
    place[terms] = np.arange(len(terms))
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    flat = place[flat]
    flat, owner = flat[flat >= 0], owner[flat >= 0]
    sizes = np.bincount(owner, minlength=n)
    starts = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(seed)
    m = Machine(bias_of(labels), terms, np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS)))
    g_bias, g_w, g_v = 1e-6, np.full(len(terms), 1e-6), np.full((len(terms), FACTORS), 1e-6)
    rate, width = 0.1, 128
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, width):
            rows = order[k: k + width]
            own = sizes[rows]
            total = own.sum()
            picks = np.repeat(starts[rows] - (np.cumsum(own) - own), own) + np.arange(total)
            f = flat[picks]
            row = np.repeat(np.arange(len(rows)), own)
            miss = (m.scores(f, own) - labels[rows]) / len(rows)
            v = m.vectors[f]
            sums = np.stack([np.bincount(row, v[:, j], len(rows)) for j in range(FACTORS)], axis=1)
            pull = miss[row][:, None] * (sums[row] - v)
            d_w = np.bincount(f, miss[row], len(terms)) + DECAY * m.weights
            d_v = np.stack([np.bincount(f, pull[:, j], len(terms)) for j in range(FACTORS)], axis=1) + DECAY * m.vectors
            g_bias += miss.sum() ** 2
            g_w += d_w**2
            g_v += d_v**2
            m.bias -= rate * miss.sum() / np.sqrt(g_bias)
            m.weights -= rate * d_w / np.sqrt(g_w)
            m.vectors -= rate * d_v / np.sqrt(g_v)
    return m


def losses(m: Machine, flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The log loss of a machine on each of the documents."""
    place = np.full(SPACE, -1, np.int32)
    place[m.terms] = np.arange(len(m.terms))
    owner = np.repeat(np.arange(len(labels)), sizes)
    flat = place[flat]
    sizes = np.bincount(owner[flat >= 0], minlength=len(labels))
    p = np.clip(m.scores(flat[flat >= 0], sizes), 1e-6, 1 - 1e-6)
    return -np.log(np.where(labels > 0, p, 1 - p))


def with_partners(m: Machine, flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The machine's terms and those that would gain beside them.

    For a term without a vector, the gradient of the loss by that vector sums
    what the machine misses in its documents, weighed by the vectors of the
    other terms there. Its square over its variance is a chi-square of the
    pairs, whatever the term tells alone.
    """
    n = len(labels)
    place = np.full(SPACE, -1, np.int32)
    place[m.terms] = np.arange(len(m.terms))
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    at = place[flat]
    known, at = owner[at >= 0], at[at >= 0]
    p = m.scores(at, np.bincount(known, minlength=n))
    pairs = np.zeros(SPACE)
    for j in range(FACTORS):
        total = np.bincount(known, m.vectors[at, j], n)
        missed = np.bincount(flat, ((p - labels) * total)[owner], SPACE)
        spread = np.bincount(flat, (p * (1 - p) * total * total)[owner], SPACE)
        np.maximum(pairs, missed**2 / (spread + 1e-9), out=pairs)
    pairs[np.bincount(flat, minlength=SPACE) < BESIDE[1]] = 0
    pairs[m.terms] = 0
    more = np.argsort(-pairs, kind="stable")[: max(0, TERMS - len(m.terms))]
    return np.sort(np.concatenate([m.terms, more[pairs[more] >= BESIDE[0]]]))


def fit(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> Machine:
    """Fit a machine to documents given as hashed terms.

    A term that is toxic only beside another may tell nothing alone. So the
    machine starts from the terms that do; then partners of the terms at hand
    are added, in up to ``ROUNDS`` rounds, as long as a machine fitted to four
    of five documents gains by them on the fifth, by more than the standard
    error of the difference.
    """
    n = len(labels)
    none = Machine(bias_of(labels) if n else -30.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    if not n or labels.min() == labels.max():
        return none
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    tested = np.arange(n) % 5 == 4
    rounds = 0
    if 0 < labels[tested].sum() and 0 < labels[~tested].sum() < (~tested).sum():
        of_test = tested[owner]
        rest = (flat[~of_test], sizes[~tested], labels[~tested])
        aside = (flat[of_test], sizes[tested], labels[tested])
        m = descend(*rest, chosen_terms(rest[0], np.repeat(np.arange(len(rest[1]), dtype=np.int32), rest[1]), rest[2]))
        least = losses(m, *aside)
        while rounds < ROUNDS:
            m = descend(*rest, with_partners(m, *rest))
            got = losses(m, *aside)
            gain = least - got
            if gain.mean() <= gain.std() / np.sqrt(len(gain)):
                break
            least, rounds = got, rounds + 1
    terms = chosen_terms(flat, owner, labels)
    if not len(terms):
        return none
    m = descend(flat, sizes, labels, terms)
    for _ in range(rounds):
        m = descend(flat, sizes, labels, with_partners(m, flat, sizes, labels))
    return m


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: the checksum of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Machine:
    """A machine fitted on a bounded sample of the labelled documents that are not held out."""
    tune(docs.sparkSession)
    ids = docs.select(column(id_col).alias("doc_id"))
    chosen = (
        labels.where("toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).join(ids, "doc_id", "left_semi").groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        .withColumnRenamed("doc_id", "labelled_id")
    )
    # At most ``sample`` rows of two numbers, so the texts stay where they are.
    rows = docs.select(column(id_col).alias("labelled_id"), column(text_col).alias("labelled_text")).join(
        F.broadcast(chosen), "labelled_id")

    def make():
        cache: dict[str, tuple] = {}

        def run(raws: list[bytes]) -> list[pa.Array]:
            found = []
            for raw in raws:
                ids: set[int] = set()
                for token in tokens_of(raw):
                    got = cache.get(token)
                    if got is None:
                        got = terms_of(token)
                        if len(cache) < CACHE:
                            cache[token] = got
                    ids.update(got)
                found.append(sorted(ids))
            return [pa.array(found, pa.list_(pa.int32()))]

        return run

    fields = [T.StructField("terms", T.ArrayType(T.IntegerType()), False)]
    got = annotate(rows, ["labelled_id", "label"], "labelled_text", make, fields).select(
        "row.labelled_id", "row.label", "terms").groupBy("labelled_id").agg(
        F.max("label").alias("label"), F.min("terms").alias("terms")).toArrow()  # one row per id
    order = np.argsort(got["labelled_id"].to_numpy(), kind="stable")  # the same machine whatever the order of tasks
    if not len(order):
        return fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
    lists = [v for chunk in got["terms"].chunks for v in chunk]
    flat = np.concatenate([np.asarray(lists[k].values, np.int32) for k in order])
    sizes = np.array([len(lists[k]) for k in order])
    labels_ = got["label"].to_numpy()[order].astype(float)
    del got, lists
    return fit(flat, sizes, labels_)


def scored(docs: DataFrame, machine: Machine, carry: list[str], text_col: str = "text") -> DataFrame:
    """``row`` and ``score`` of every document."""
    place = {int(t): k for k, t in enumerate(machine.terms)}

    def make():
        cache: dict[str, tuple] = {}

        def known(token: str) -> tuple:
            got = tuple(place[t] for t in terms_of(token) if t in place)
            if len(cache) < CACHE:
                cache[token] = got
            return got

        def run(raws: list[bytes]) -> list[pa.Array]:
            flat: list[int] = []
            sizes = []
            for raw in raws:
                own: set[int] = set()
                for token in tokens_of(raw):
                    got = cache.get(token)
                    if got is None:
                        got = known(token)
                    if got:
                        own.update(got)
                flat.extend(sorted(own))
                sizes.append(len(own))
            return [pa.array(machine.scores(np.array(flat, np.int64), np.array(sizes, np.int64)))]

        return run

    return annotate(docs, carry, text_col, make, [T.StructField("score", T.DoubleType(), False)])


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    rows = scored(docs, train(docs, labels), ["doc_id"])
    return rows.select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_harmless(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    machine = train(docs, labels, text_col=text_col)
    return scored(docs, machine, docs.columns, text_col).where(F.col("score") < threshold).select("row.*")
