"""Repeated passages by seed and extend.

Seeds are winnowed anchors: of the hashes of all ``gram`` consecutive words in
a window of ``window`` words the smallest is kept, so equal windows have equal
anchors at equal places. Documents meet at the anchors they share. Every
meeting is extended to both sides at once: first over the whole stretch of
words that windows through the anchor can reach; members that agree on all of
it repeat what the member with the smallest id has, without a closer look. The
first member of each such class is then extended split by split (``j`` words
to the left, the rest to the right) and compared under the extension's hash.
What a smaller document also has is joined to maximal stretches and cut.

No pairs are made: an anchor shared by many documents costs a row per member,
minima are combined before each shuffle, and counting happens on the input, so
the order of work does not matter.

Defined cases: a null or empty text and one with fewer words than a window
keep all their words; of repeated rows with one id none removes from another;
rows without an id keep everything and remove nothing; very long texts and
texts of one repeated word are anchored like others; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlint.llm.common import column
from fleetlint.session import materialise, tune

WINDOW = 50
GRAM = 16
CACHE = 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers, so that sums of products do not keep structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes by word; grows to ``CACHE`` entries."""

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE and len(word) <= 40:
            self[word] = got
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array(list(map(self.__getitem__, words)), np.uint64)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Prefixes:
    """Hashes of any stretch of words, from sums of prefixes (modulo two to the 64)."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(hashes) * self.powers[:n], dtype=np.uint64)])
        # The base is odd, so it has an inverse; stretches are brought to a common start with it.
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inverse, np.uint64), dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverses[start]
        return _mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def anchors(prefix: Prefixes, n: int, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the winnowed anchors of ``n`` words, and their hashes."""
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    values = prefix.of(at, at + gram)
    width = window - gram + 1
    picks = np.lib.stride_tricks.sliding_window_view(values, width).argmin(axis=1) + np.arange(n - window + 1)
    picks = np.unique(picks)
    return picks, values[picks]


def reach(at: np.ndarray, n: int, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretch that windows through an anchor can cover."""
    spare = window - gram
    return np.maximum(at - spare, 0), np.minimum(at + gram + spare, n)


SEED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("anchor", T.LongType(), False),
    T.StructField("context", T.LongType(), False), T.StructField("lo", T.IntegerType(), False),
    T.StructField("hi", T.IntegerType(), False),
])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        column(id_col).cast("long").alias("doc_id"),
        F.coalesce(column(text_col).cast("binary"), F.expr("X''")).alias("raw"),
    )


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def seeds(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per anchor: the hash of its gram and of its whole stretch, and where the stretch lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = raw.split()
                if len(words) < window or doc_id is None:
                    continue
                prefix = Prefixes(cache.of(words))
                at, found = anchors(prefix, len(words), window, gram)
                lo, hi = reach(at, len(words), window, gram)
                # Where the anchor stands in the stretch is part of what must agree.
                context = prefix.of(lo, hi) + (at - lo).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), doc_id, np.int64)), _signed(found), _signed(context),
                    pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
                ], names=SEED.names)

    return texts.mapInArrow(run, SEED)


EXTENSION = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("anchor", T.LongType(), False),
    T.StructField("extension", T.LongType(), False), T.StructField("lo", T.IntegerType(), False),
])


def extensions(texts: DataFrame, chosen: DataFrame, window: int, gram: int) -> DataFrame:
    """Every window through the chosen anchors (``doc_id``, ``stretches``: lo, hi, anchor), with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for doc_id, raw, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = raw.split()
                prefix = Prefixes(cache.of(words))
                lo, hi, anchor = (np.array([s[k] for s in own], np.int64) for k in ("lo", "hi", "anchor"))
                count = hi - lo - window + 1
                start = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(start), doc_id, np.int64)), pa.array(np.repeat(anchor, count)),
                    _signed(prefix.of(start, start + window)), pa.array(start.astype(np.int32)),
                ], names=EXTENSION.names)

    return texts.join(chosen, "doc_id").select("doc_id", "raw", "stretches").mapInArrow(run, EXTENSION)


def repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, lo, hi``: stretches of words that a document with a smaller id has too. They may overlap."""
    tune(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    found = materialise(seeds(texts, window, gram), "seeds")
    # Anchors that meet: in at least two documents.
    met = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("anchor")
    shared = materialise(found.join(met, "anchor"), "shared_seeds")
    first = shared.groupBy("anchor", "context").agg(F.min("doc_id").alias("first"))
    classed = shared.join(first, ["anchor", "context"])
    whole = classed.where("doc_id > first AND hi - lo >= %d" % window).select("doc_id", "lo", "hi")
    # An anchor with one class only has nothing left to compare.
    split = first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    chosen = (
        classed.where("doc_id = first").join(split, "anchor").groupBy("doc_id")
        .agg(F.collect_list(F.struct("lo", "hi", "anchor")).alias("stretches"))
    )
    windows = materialise(extensions(texts, chosen, window, gram), "extensions")
    least = windows.groupBy("anchor", "extension").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    least = least.where("first < last").drop("last")
    part = windows.join(least, ["anchor", "extension"]).where("doc_id > first").select(
        "doc_id", "lo", (F.col("lo") + window).cast("int").alias("hi"))
    return whole.unionByName(part)


def covered(n: int, stretches: list[dict]) -> np.ndarray:
    """Which of ``n`` words lie in a stretch."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, [s["lo"] for s in stretches], 1)
    np.add.at(steps, [s["hi"] for s in stretches], -1)
    return np.cumsum(steps[:-1]) > 0


def with_stretches(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``row`` (all columns of a document) and its ``stretches``, null if it has none."""
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("stretches"))
    rows = docs.select(F.struct(*[column(c).alias(c) for c in docs.columns]).alias("row"))
    return rows.join(spans, rows["row"][id_col].cast("long") == spans["doc_id"], "left").select("row", "stretches")


DIGEST = [
    T.StructField("n_words", T.LongType(), False), T.StructField("n_removed", T.LongType(), False),
    T.StructField("kept_sha256", T.StringType(), False),
]


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The contract's columns for every document."""
    docs = docs.select("doc_id", "text")
    source = with_stretches(docs, repeats(docs, window, gram)).select(
        "row.doc_id", F.coalesce(F.col("row.text").cast("binary"), F.expr("X''")).alias("raw"), "stretches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = raw.split()
                kept = words
                if own:
                    gone = covered(len(words), own)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, removed, digest = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()),
            ], names=["doc_id", *[f.name for f in DIGEST]])

    return source.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), *DIGEST]))


def cut_text(raw: bytes, stretches: list[dict]) -> bytes:
    """The text without the words of the stretches; kept words keep the white space before them."""
    words = raw.split()
    out: list[bytes] = []
    at, broken = 0, False
    for word, gone in zip(words, covered(len(words), stretches).tolist()):
        start = raw.index(word, at)
        gap = raw[at:start]
        if gone:
            broken = broken or b"\n" in gap
        else:
            # A line that ended among the removed words keeps its end.
            out.append((b"\n" if broken and b"\n" not in gap else gap) + word)
            broken = False
        at = start + len(word)
    return b"".join(out).strip(b" \t\n\r\x0b\x0c")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents without their repeated passages, with all columns.

    A document of which nothing is left stays, with an empty text; ``n_chars``,
    where there is one, is counted anew for texts that change.
    """
    source = with_stretches(docs, repeats(docs, window, gram)).select(
        "row", F.col("row.text").cast("binary").alias("raw"), "stretches")
    schema = T.StructType([source.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                cut_text(raw, own) if own else raw
                for raw, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            texts = [None if t is None else t.decode("utf-8", "replace") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    def value(name: str):
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            changed = ~F.col("text").eqNullSafe(F.col("row.text"))
            return F.when(changed, F.length("text").cast(docs.schema[name].dataType)).otherwise(column("row")[name])
        return column("row")[name]

    return source.mapInArrow(run, schema).select(*[value(c).alias(c) for c in docs.columns])
