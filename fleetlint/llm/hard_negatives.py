"""Hard negatives by products of Kronecker-packed integers.

Every component is floored to an integer (``scale * x``, scale a power of
two) and biased, so that it is not negative. Several candidates' components
then stand in separated fields of one wide integer, each field wide enough
for a whole inner product. One multiplication by an anchor's component
multiplies all fields at once; the sum over the components holds all the inner
products, which are cut out and freed of the biases exactly. Where a double
holds two fields or more (its 53 bits are an exact integer), the wide integers
are multiplied as a matrix; otherwise one Python integer holds a 64-bit field
of every candidate.

The anchors are a query set that is compared with all rows, in blocks: rows are
dealt to chunks of bounded size by a hash of their id, a copy of the anchors is
streamed past each chunk, and a task gives out the best few of its chunk, which
are ranked over all chunks. The positives come first (rows of the anchor's
label), then the rows of other labels whose scores lie in the band of a positive.

Defined cases: rows without id, label or vector or with a null or non-finite
component take no part, and neither do rows whose square (dimensions times the
largest component's square) leaves 62 bits, as a long holds no score of theirs;
an empty vector has the score 0 with other empty ones; vectors of different
length never meet; of rows with one id that with the smallest label, then the
smallest components, counts; an anchor without positives or without negatives
in the band gives no row; ties go to the smaller id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlint.llm.common import column
from fleetlint.session import materialise, tune

#: Most rows of a chunk, on average.
CHUNK = 65_536
#: Bits of an exact integer in a double.
_WORD = 53
#: Scores computed at once.
_SCORES = 1 << 21
_NONE = np.iinfo(np.int64).min

_ROWS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("label", T.StringType()),
    T.StructField("dims", T.IntegerType()), T.StructField("parts", T.BinaryType()),
])


def integer_rows(vectors: DataFrame, id_col: str, label: Column, vec_col: str, scale: int) -> DataFrame:
    """Rows that take part, components floored to 16- or 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.values
            ends = lists.offsets.to_numpy()
            x = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                floored = np.floor(scale * x)
            ids, labels, dims, parts = [], [], [], []
            for k, (vec_id, name) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if vec_id is None or name is None or not lists[k].is_valid:
                    continue
                own = floored[ends[k]: ends[k + 1]]
                top = float(np.abs(own).max()) if len(own) else 0.0
                if not np.isfinite(top) or top >= 2**31 or len(own) * int(top) ** 2 >= 1 << 62:
                    continue
                ids.append(vec_id)
                labels.append(name)
                dims.append(len(own))
                parts.append(own.astype("<i2" if top < 1 << 15 else "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(dims, pa.int32()),
                pa.array(parts, pa.binary())], names=_ROWS.names)

    return vectors.select(
        column(id_col).cast("long").alias("id"), label.cast("string").alias("label"), column(vec_col).alias("vector")
    ).mapInArrow(run, _ROWS)


def components_of(dims: int, parts: list[bytes]) -> np.ndarray:
    """Integer matrix of vectors that are stored alike."""
    kind = "<i2" if not dims or len(parts[0]) == 2 * dims else "<i4"
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), dims).astype(np.int64)


class Packed:
    """Candidates of one length, in the order of label and id, packed for products."""

    def __init__(self, ids: np.ndarray, labels: list[str], parts: np.ndarray):
        names = np.array(labels, object)
        order = np.lexsort((ids, names.astype(str)))
        self.ids, self.parts, names = ids[order], parts[order], names[order]
        starts = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
        self.spans = {names[s]: (s, e) for s, e in zip(starts, starts[1:]) if e > s}
        self.dims = parts.shape[1]
        self.bias = max(0, -int(parts.min(initial=0)))
        self.top = int(parts.max(initial=0)) + self.bias
        self.sums = (self.parts + self.bias).sum(axis=1)
        self._words: dict[tuple[int, int], np.ndarray] = {}
        self._wide: list[int] | None = None

    def words(self, fields: int, width: int) -> np.ndarray:
        """Per component and word the biased components of ``fields`` neighbours, ``width`` bits each."""
        key = (fields, width)
        if key not in self._words:
            n = -(-len(self.ids) // fields)
            biased = np.zeros((n * fields, self.dims), np.int64)
            biased[: len(self.ids)] = self.parts + self.bias
            word = np.zeros((n, self.dims), np.int64)
            for field in range(fields):
                word |= biased[field::fields] << (field * width)
            self._words = {key: np.ascontiguousarray(word.T.astype(np.float64))}
        return self._words[key]

    def wide(self) -> list[int]:
        """Per component one integer with a 64-bit field of every candidate."""
        if self._wide is None:
            biased = (self.parts + self.bias).astype("<u8")
            self._wide = [int.from_bytes(biased[:, k].tobytes(), "little") for k in range(self.dims)]
        return self._wide

    def scores(self, anchors: np.ndarray, start: int, end: int) -> np.ndarray:
        """Exact inner products of the anchors with the candidates ``start`` to ``end``."""
        bias = max(0, -int(anchors.min(initial=0)))
        biased = anchors + bias
        width = max(1, (self.dims * int(biased.max(initial=0)) * self.top).bit_length())
        fields = _WORD // width
        if fields >= 2:
            first, last = start // fields, -(-end // fields)
            product = (biased.astype(np.float64) @ self.words(fields, width)[:, first:last]).astype(np.int64)
            cut = np.empty((len(anchors), (last - first) * fields), np.int64)
            for field in range(fields):
                cut[:, field::fields] = product >> (field * width) & ((1 << width) - 1)
            raw = cut[:, start - first * fields: end - first * fields]
        else:
            size = 8 * (len(self.ids) + 1)
            rows = [
                np.frombuffer(sum(a * w for a, w in zip(row, self.wide())).to_bytes(size, "little"), "<u8")[start:end]
                for row in biased.tolist()
            ]
            raw = np.array(rows, np.uint64).reshape(len(anchors), end - start).view(np.int64)
        # Without the biases; what leaves 64 bits on the way comes back.
        with np.errstate(over="ignore"):
            return (
                raw - self.bias * biased.sum(axis=1)[:, None] - bias * self.sums[start:end]
                + self.dims * bias * self.bias)


def ranked(group: np.ndarray, score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the first ``keep`` of every group: highest score, then smallest id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[rank < keep]


def best_of_label(packed: Packed, label: str, anchors: np.ndarray, anchor_ids: np.ndarray, keep: int):
    """The best other rows of one label for anchors of that label: anchor positions, scores, ids."""
    found = [np.empty(0, np.int64)] * 3
    if label not in packed.spans:
        return found
    start, end = packed.spans[label]
    step = max(1, _SCORES // len(anchors))
    for at in range(start, end, step):
        to = min(end, at + step)
        scores, ids = packed.scores(anchors, at, to), packed.ids[at:to]
        scores = np.where(ids == anchor_ids[:, None], _NONE, scores)
        if to - at > keep:
            least = np.partition(scores, to - at - keep, axis=1)[:, to - at - keep]
        else:
            least = np.full(len(anchors), _NONE)
        a, c = np.nonzero((scores >= least[:, None]) & (scores > _NONE))
        found = [np.concatenate(pair) for pair in zip(found, (a, scores[a, c], ids[c]))]
        best = ranked(found[0], found[1], found[2], keep)
        found = [f[best] for f in found]
    return found


def best_in_band(packed: Packed, label: str, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int):
    """The best rows of other labels in each band: positions of anchor and band, scores, ids."""
    found = [np.empty(0, np.int64)] * 4
    own = packed.spans.get(label, (0, 0))
    floor, ceiling = low.min(axis=1), high.max(axis=1)
    step = max(1, _SCORES // len(anchors))
    for start, end in ((0, own[0]), (own[1], len(packed.ids))):
        for at in range(start, end, step):
            to = min(end, at + step)
            scores, ids = packed.scores(anchors, at, to), packed.ids[at:to]
            a, c = np.nonzero((scores >= floor[:, None]) & (scores <= ceiling[:, None]))
            s, i = scores[a, c], ids[c]
            for band in range(low.shape[1]):
                inside = np.flatnonzero((s >= low[a, band]) & (s <= high[a, band]))
                best = inside[ranked(a[inside], s[inside], i[inside], keep)]
                part = (a[best], np.full(len(best), band), s[best], i[best])
                found = [np.concatenate(pair) for pair in zip(found, part)]
            best = ranked(found[0] * low.shape[1] + found[1], found[2], found[3], keep)
            found = [f[best] for f in found]
    return found


def _groups(batch: pa.RecordBatch, with_label: bool) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Rows of a batch that are stored alike (and share a label): key, positions, components."""
    dims, parts = batch.column("dims").to_pylist(), batch.column("parts").to_pylist()
    labels = batch.column("label").to_pylist() if with_label else [None] * len(dims)
    at: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(dims, map(len, parts), labels)):
        at.setdefault(key, []).append(k)
    for key, rows in at.items():
        yield key, np.array(rows), components_of(key[0], [parts[k] for k in rows])


def packed_rows(batches: list[pa.RecordBatch]) -> dict[int, list[Packed]]:
    """The rows of a chunk by length; 16- and 32-bit rows apart, so that a few large ones do not widen all fields."""
    table = pa.Table.from_batches(batches).combine_chunks().to_batches(max_chunksize=None)[0]
    ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_pylist()
    found: dict[int, list[Packed]] = {}
    for (dims, *_), rows, parts in _groups(table, False):
        found.setdefault(dims, []).append(Packed(ids[rows], [labels[k] for k in rows], parts))
    return found


_BEST = T.StructType([
    T.StructField("anchor_id", T.LongType()), T.StructField("score", T.LongType()), T.StructField("other_id", T.LongType()),
    T.StructField("positive_id", T.LongType()), T.StructField("positive_score", T.LongType()),
])


def best_per_chunk(rows: DataFrame, anchors: DataFrame, chunks: int, keep: int, band: tuple[int, int] | None) -> DataFrame:
    """Per anchor (and positive, with a band) the best rows of each chunk. ``anchors`` carry their positives then."""
    none = F.lit(None).cast("array<bigint>")
    fields = [*_ROWS.names, "positives", "bounds"]
    plain = rows.withColumns({"positives": none, "bounds": none})
    dealt = plain.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(0).alias("part"), *fields
    ).unionByName((anchors if band else anchors.withColumns({"positives": none, "bounds": none})).select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("part"), *fields))

    def meet(batch: pa.RecordBatch, chunk: dict[int, list[Packed]]) -> Iterator[list[np.ndarray]]:
        ids = batch.column("vec_id").to_numpy()
        for (dims, _, label), at, parts in _groups(batch, True):
            if not band:
                for packed in chunk.get(dims, []):
                    a, score, other = best_of_label(packed, label, parts, ids[at], keep)
                    nothing = np.zeros(len(a), np.int64)
                    yield [ids[at][a], score, other, nothing, nothing]
                continue
            positives, bounds = (
                [batch.column(name)[int(k)].as_py() for k in at] for name in ("positives", "bounds"))
            width = max(map(len, bounds))
            # An empty band (low above high) fills up anchors with fewer positives.
            high = np.array([[*b, *[0] * (width - len(b))] for b in bounds], np.int64)
            low = np.array([
                [*[-(-band[0] * s // band[1]) for s in b], *[1] * (width - len(b))] for b in bounds], np.int64)
            named = np.array([[*p, *[0] * (width - len(p))] for p in positives], np.int64)
            for packed in chunk.get(dims, []):
                a, j, score, other = best_in_band(packed, label, parts, low, high, keep)
                yield [ids[at][a], score, other, named[a, j], high[a, j]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, chunk = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            where = batch.column("chunk").to_numpy()
            part = batch.column("part").to_numpy()
            borders = np.flatnonzero((np.diff(where) != 0) | (np.diff(part) != 0)) + 1
            for s, e in zip([0, *borders], [*borders, batch.num_rows]):
                piece = batch.slice(s, e - s)
                if where[s] != number:
                    number, waiting, chunk = where[s], [], None
                if not part[s]:
                    waiting.append(piece)
                    continue
                if chunk is None:
                    chunk, waiting = (packed_rows(waiting) if waiting else {}), []
                for columns in meet(piece, chunk):
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_BEST.names)

    return (
        dealt.repartitionById(chunks, "chunk").sortWithinPartitions("chunk", "part")
        .mapInArrow(run, _BEST)
    )


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding",
    positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100), scale: int = 256, chunk: int = CHUNK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``vec_id``. Per anchor the best
    ``positives`` other rows of its label, and per positive the best
    ``negatives`` rows of other labels whose score is at least ``band``
    (numerator, denominator) of the positive's and at most the positive's.
    """
    spark = tune(vectors.sparkSession)
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale must be a power of two, so that flooring is exact")
    one = integer_rows(vectors, id_col, label, vec_col, scale).groupBy("vec_id").agg(
        F.min(F.struct("label", "dims", "parts")).alias("r"))
    rows = materialise(one.select("vec_id", "r.*"), "integer_vectors")
    chunks = max(-(-rows.count() // chunk), spark.sparkContext.defaultParallelism)
    anchors = rows.where(is_anchor)

    found = best_per_chunk(rows, anchors, chunks, positives, None)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    best = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    lists = best.groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "other_id", "score"))).alias("found")
    ).select(
        F.col("anchor_id").alias("vec_id"), F.col("found.other_id").alias("positives"), F.col("found.score").alias("bounds"))
    known = materialise(anchors.join(lists, "vec_id"), "anchors")

    in_band = best_per_chunk(rows, known, chunks, negatives, band)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "other_id")
    return in_band.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
