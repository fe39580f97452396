"""SimHash near-duplicates with a Gray-order hierarchical index.

Two fingerprints that differ in at most ``radius`` bits agree on at least two
of ``radius + 2`` blocks of bits. The upper nodes of the index are therefore
the masked bit patterns of all pairs of blocks: every fingerprint is filed
under each of them. Inside a node the fingerprints stand in Gray order, so
neighbours differ in few bits; runs of them form leaves, each with the mask of
bits its members share and their pattern, and leaves form groups likewise. A
search compares patterns first and drops whole groups as soon as the
differences found in shared bits exceed the radius.

A node with more than ``limit`` members is not searched in one task: its
members are filed again under pairs of blocks of the bits not yet shared, up to
three levels deep, where at most 19 bits are left open.

Only a spanning forest of the links that a task finds leaves it, so groups of
many near copies cost no row per pair; connected groups are the same.

Defined cases: a null or empty text, or one without words, has fingerprint
zero and links like any other; fewer words than a shingle count as one
shingle; repeated rows share a group; rows without an id join a group and get
its smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlint.llm.common import annotate, column, components
from fleetlint.session import materialise

BITS = 64
SEED = 42
#: Members of a node that one task searches; larger nodes are filed one level deeper.
LIMIT = 16_384
LEVELS = 3
LEAF = 32
_TILE = 2_048

_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint: bits set in over half of the 64-bit hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    blocks = -(-n // 255)
    padded = np.zeros(blocks * 255, np.uint64)
    padded[:n] = hashes
    padded = padded.reshape(blocks, 255)
    found = 0
    for shift in range(8):
        # Eight counters of one byte each; 255 addends cannot overflow them.
        lanes = ((padded >> np.uint64(shift)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts = lanes.view(np.uint8).reshape(blocks, 8).sum(axis=0, dtype=np.int64)
        for byte in range(8):
            if 2 * counts[byte] > n:
                found |= 1 << (8 * byte + shift)
    return found


def fingerprint(raw: bytes, shingle: int) -> int:
    """SimHash of the lower-cased word shingles of a text, as an unsigned number."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return majority_bits(np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    return majority_bits(np.array(hashes, np.uint64))


def fingerprints(docs: DataFrame, carry: list[str], shingle: int = 4, text_col: str = "text") -> DataFrame:
    """``row`` and ``fp`` (the 64 bits as a signed long) of every document."""

    def make():
        def run(raws: list[bytes]) -> list[pa.Array]:
            return [pa.array(np.array([fingerprint(r, shingle) for r in raws], np.uint64).view(np.int64))]

        return run

    return annotate(docs, carry, text_col, make, [T.StructField("fp", T.LongType(), False)])


# -- the index ----------------------------------------------------------------


def blocks_of(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` blocks that share out the given bit positions, sizes differing by one at most."""
    return [sum(1 << b for b in bits[k::n]) for k in range(n)]


def child_masks(parent: int, radius: int) -> list[int]:
    """The masks under a node: its own bits and two blocks of the open ones."""
    open_bits = [b for b in range(BITS) if not parent >> b & 1]
    return [parent | a | b for a, b in combinations(blocks_of(open_bits, radius + 2), 2)]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in the Gray code sequence; only its order matters."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def shared(fps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per run of ``size`` members, the mask of bits they agree on and their pattern."""
    starts = np.arange(0, len(fps), size)
    every, some = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
    return ~(every ^ some), every


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)

    def flat(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if (nxt == self.up).all():
                return nxt
            self.up = nxt


def search(fps: np.ndarray, radius: int) -> np.ndarray:
    """Per member of a node (in Gray order), the first member of its linked group."""
    n, forest = len(fps), Forest(len(fps))
    mask, pattern = shared(fps, LEAF)
    top_mask, top_pattern = shared(fps, LEAF * LEAF)
    tops, leaves = len(top_mask), len(mask)
    for i in range(tops):
        near = np.flatnonzero(_popcount((top_pattern[i] ^ top_pattern[i:]) & top_mask[i] & top_mask[i:]) <= radius) + i
        own = np.arange(i * LEAF, min((i + 1) * LEAF, leaves))
        others = (near[:, None] * LEAF + np.arange(LEAF)).ravel()
        others = others[others < leaves]
        a, b = np.nonzero(_popcount(
            (pattern[own][:, None] ^ pattern[others]) & mask[own][:, None] & mask[others]) <= radius)
        for leaf in np.unique(a):
            at = own[leaf]
            reach = others[b[a == leaf]]
            reach = reach[reach >= at]
            left = np.arange(at * LEAF, min((at + 1) * LEAF, n))
            right = (reach[:, None] * LEAF + np.arange(LEAF)).ravel()
            right = right[right < n]
            for part in range(0, len(right), _TILE):
                x, y = np.nonzero(_popcount(fps[left][:, None] ^ fps[right[part: part + _TILE]]) <= radius)
                x, y = left[x], right[part: part + _TILE][y]
                x, y = x[x < y], y[x < y]
                if len(x):
                    # A link inside a group that is already joined says nothing new.
                    roots = forest.flat()
                    new = np.unique(np.stack([roots[x], roots[y]])[:, roots[x] != roots[y]], axis=1)
                    forest.join(*new)
    return forest.flat()


def _small_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside short runs of equal keys, by comparing with the next, the next but one and so on."""
    run = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, int)
    a_all, b_all = [], []
    at, step = np.arange(len(fps)), 1
    while True:
        at = at[at + step < len(fps)]
        at = at[run[at] == run[at + step]]
        if not len(at):
            break
        near = at[_popcount(fps[at] ^ fps[at + step]) <= radius]
        a_all.append(near)
        b_all.append(near + step)
        step += 1
    return (np.concatenate(a_all), np.concatenate(b_all)) if a_all else (np.zeros(0, int),) * 2


_LINKS = T.StructType([
    T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
    T.StructField("mask", T.LongType()), T.StructField("key", T.LongType()),
])
_SHORT = 64


class TaskLinks:
    """Union-find by fingerprint over all nodes that one task searches; the smallest member is the root.

    It holds the linked fingerprints of the task's partition only.
    """

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, i: int) -> int:
        up = self.up
        while (j := up.get(i, i)) != i:
            up[i] = up.get(j, j)
            i = j
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)

    def edges(self) -> Iterator[tuple[int, int]]:
        return ((i, self.root(i)) for i in self.up)


def _search_nodes(radius: int, limit: int):
    """Over rows sorted by mask, key and Gray rank: a spanning forest of the task's links, and the
    nodes beyond ``limit`` (with null ``a``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = TaskLinks()
        passed: list[tuple[int, int]] = []  # mask and key of nodes that are too large for one task
        held: list[np.ndarray] = []  # the open node: [mask, key, fp] rows
        size = 0

        def one_node(rows: np.ndarray) -> None:
            fps = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
            roots = search(fps, radius)
            moved = np.flatnonzero(roots != np.arange(len(fps)))
            found.add(rows[moved, 2], rows[roots[moved], 2])

        def close() -> None:
            nonlocal held, size
            if size > limit:
                passed.append((int(held[0][0, 0]), int(held[0][0, 1])))
            elif size > 1:
                one_node(np.concatenate(held))
            held, size = [], 0

        def extend(rows: np.ndarray) -> None:
            nonlocal held, size
            size += len(rows)
            held = [held[0] if held else rows[:1]] if size > limit else [*held, rows]

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            if not len(rows):
                continue
            borders = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            starts, ends = np.concatenate([[0], borders]), np.concatenate([borders, [len(rows)]])
            if held and (rows[0, :2] != held[0][0, :2]).any():
                close()
            extend(rows[: ends[0]])
            if len(starts) == 1:
                continue
            close()
            sizes = ends - starts
            inside = np.zeros(len(starts), bool)
            inside[1:-1] = True  # nodes that lie in this batch as a whole
            for k in np.flatnonzero(inside & (sizes > _SHORT)):
                if sizes[k] > limit:
                    passed.append((int(rows[starts[k], 0]), int(rows[starts[k], 1])))
                else:
                    one_node(rows[starts[k]: ends[k]])
            picked = rows[np.repeat(inside & (sizes > 1) & (sizes <= min(_SHORT, limit)), sizes)]
            for k in np.flatnonzero(inside & (sizes > limit) & (sizes <= _SHORT)):
                passed.append((int(rows[starts[k], 0]), int(rows[starts[k], 1])))
            x, y = _small_links(picked[:, :2], np.ascontiguousarray(picked[:, 2]).view(np.uint64), radius)
            found.add(picked[x, 2], picked[y, 2])
            extend(rows[starts[-1]:])
        if held:
            close()
        edges = list(found.edges())
        n, m = len(edges), len(passed)
        yield pa.RecordBatch.from_arrays([
            pa.array([*[e[0] for e in edges], *[None] * m], pa.int64()),
            pa.array([*[e[1] for e in edges], *[None] * m], pa.int64()),
            pa.array([*[None] * n, *[p[0] for p in passed]], pa.int64()),
            pa.array([*[None] * n, *[p[1] for p in passed]], pa.int64()),
        ], names=_LINKS.names)

    return run


def links(distinct: DataFrame, radius: int = 4, limit: int = LIMIT) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints (column ``fp``) that span every linked group."""
    spark = distinct.sparkSession
    masks = [0]
    filed = distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    found: list[DataFrame] = []
    for level in range(1, LEVELS + 1):
        children = {m: child_masks(m, radius) for m in masks}
        masks = sorted({c for own in children.values() for c in own})
        if level == 1:
            filed = filed.select("fp", F.explode(F.array(*[F.lit(signed(c)) for c in masks])).alias("mask"))
        else:
            # Masks under masks: a fixed table, 225 rows at the second level, 3,375 at the third.
            below = spark.createDataFrame(
                [(signed(m), [signed(c) for c in own]) for m, own in children.items()], "mask long, children array<long>")
            filed = filed.join(hot, ["mask", "key"], "left_semi").join(F.broadcast(below), "mask").select(
                "fp", F.explode("children").alias("mask"))
        filed = filed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        last = level == LEVELS
        nodes = (
            filed.select("mask", "key", "fp").repartition("mask", "key")
            .sortWithinPartitions("mask", "key", gray_rank(F.col("fp")))
            .mapInArrow(_search_nodes(radius, 1 << 62 if last else limit), _LINKS)
        )
        nodes = materialise(nodes, f"simhash_links_{level}")
        found.append(nodes.where("a IS NOT NULL").select("a", "b"))
        hot = nodes.where("a IS NULL").select("mask", "key")
        if last or hot.isEmpty():
            break
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def groups(
    docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the smallest id reachable over links) of every document."""
    marked = materialise(
        fingerprints(docs, [id_col], shingle, text_col).select(column("row")[id_col].cast("long").alias("doc_id"), "fp"),
        "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    roots = components(links(distinct, radius, limit), "simhash_groups")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def linked(docs: DataFrame) -> DataFrame:
    """The contract's columns: 4-word shingles, links at 4 or fewer differing bits."""
    return groups(docs, shingle=4, radius=4).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of every linked group, that with the smallest id, with all columns.

    Rows of one id are one document: it stays if one of them is first in its
    group, as the row with the smallest text. Rows without an id cannot be told
    apart and stay.
    """
    found = groups(docs, shingle, radius, id_col, text_col)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    # Ids are joined first; rows of one id then lie in one partition already.
    kept = docs.where(column(id_col).isNotNull()).join(stay, id_col, "left_semi").groupBy(column(id_col)).agg(
        F.min_by(F.struct(*[column(c) for c in docs.columns]), F.coalesce(column(text_col), F.lit(""))).alias("row"))
    return kept.select("row.*").unionByName(docs.where(column(id_col).isNull()))
