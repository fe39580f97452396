"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Pieces of equal length are interchangeable, so packing needs only the number
of pieces of each length: at most ``capacity`` counts, whatever the corpus
size. From these counts a plan is made. Pieces above one third of the capacity
go at most two to a sequence, so they are matched in pairs, the longest with
the longest that still fits, which pairs as many as can be paired; shorter
pieces, longest first, then go where the least room is left that holds them.
The plan says, per length, which ranks go where; ranks come from counts per
task, and every piece looks up its place on its own.

Defined cases: a null or empty text is the end token alone; a document longer
than the capacity is cut into full pieces after a first, shorter one; repeated
rows are packed as separate documents; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fleetlint.llm.common import column
from fleetlint.session import materialise, tune

CACHE = 300_000
_CACHED_LENGTH = 40
_BOUNDARY = regex.compile(r"(?<=\S) (?=\S)")


class _Cached(dict):
    """Encoded pieces by text; grows to ``CACHE`` entries."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        got = self.encode(piece)
        if len(piece) <= _CACHED_LENGTH and len(self) < CACHE:
            self[piece] = got
        return got


class ByteEncoder:
    """Ids of a byte-level vocabulary, 32 bits each, little-endian.

    The word pattern never joins a lone space between two other characters
    with what stands before it, so a text is cut there and the pieces are
    cached. Texts with other white space are cut at such spaces only.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]):
        with open(ranks_path, "rb") as source:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = {text: np.array([i], "<u4").tobytes() for text, i in special.items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.first = _Cached(self.plain)
        self.later = _Cached(lambda piece: self.plain(" " + piece))

    def plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def encode(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if self.specials and "<|" in text:
            return b"".join(
                self.special[p] if p in self.special else self._part(p) for p in self.specials.split(text) if p)
        return self._part(text)

    def _part(self, text: str) -> bytes:
        words = text.split()
        gaps = len(words) - 1
        if gaps < 0 or len(text) - sum(map(len, words)) != gaps or text.count(" ") + text.count("\n") != gaps:
            pieces = _BOUNDARY.split(text)
            return self.first[pieces[0]] + b"".join(map(self.later.__getitem__, pieces[1:]))
        found: list[bytes] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                found.append(self.first["\n"])
            pieces = line.split(" ")
            found.append(self.first[pieces[0]])
            found.extend(map(self.later.__getitem__, pieces[1:]))
        return b"".join(found)


def lengths_of(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens; only the first may be shorter."""
    full, rest = divmod(n, capacity)
    return [rest] * bool(rest) + [capacity] * full


PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType(), False),
    T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False),
    T.StructField("ids_crc32", T.LongType(), False), T.StructField("part", T.IntegerType(), False),
    T.StructField("nth", T.LongType(), False),
])
IDS = T.StructField("ids", T.BinaryType(), False)


def pieces(
    docs: DataFrame, encoder: dict, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """All pieces of all documents, with their rank (``nth``) among the pieces of that length in the task (``part``)."""
    tune(docs.sparkSession)
    schema = T.StructType([*PIECE.fields, IDS] if with_ids else PIECE.fields)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteEncoder(**encoder)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = coder.encode(raw) + end
                start = 0
                for k, length in enumerate(lengths_of(len(ids) // 4, capacity)):
                    own = ids[4 * start: 4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(own), part, seen[length], own)[: 7 + with_ids])
                    seen[length] += 1
                    start += length
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, _TYPES)], names=schema.names)

    return docs.select(
        column(id_col).cast("long").alias("doc_id"),
        F.coalesce(column(text_col).cast("binary"), F.expr("X''")).alias("raw"),
    ).mapInArrow(run, schema)


_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Kinds of sequences: how many of a kind, and the lengths in it, in order.

    Works on counts; the number of kinds depends on the capacity and not on
    how many pieces there are.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    kinds: list[tuple[int, list[int]]] = []
    if left.get(capacity):
        kinds.append((left.pop(capacity), [capacity]))
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)

    def put(count: int, held: list[int]) -> None:
        if count:
            room[capacity - sum(held)].append((count, held))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= min(n, capacity - n) and left[m] > (m == n)), None)
            if mate is None:
                put(left[n], [n])
                left[n] = 0
                break
            pairs = left[n] // 2 if mate == n else min(left[n], left[mate])
            put(pairs, [n, mate])
            left[n] -= pairs
            left[mate] -= pairs
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            gap = min((g for g, kept in room.items() if g >= n and kept), default=None)
            if gap is None:
                each = capacity // n
                whole, rest = divmod(count, each)
                put(whole, [n] * each)
                put(1 if rest else 0, [n] * rest)
                break
            many, held = room[gap].pop()
            each = min(gap // n, count)
            used = min(many, count // each)
            put(many - used, held)
            put(used, held + [n] * each)
            count -= used * each
    kinds.extend(kind for gap in sorted(room) for kind in room[gap])
    return kinds


def places(kinds: list[tuple[int, list[int]]]) -> dict[int, dict[str, np.ndarray]]:
    """Per length, the slots in order of rank: first rank, slots per sequence, first sequence, offset of each slot."""
    found: dict[int, list[tuple]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, held in kinds:
        offsets: dict[int, list[int]] = defaultdict(list)
        at = 0
        for n in held:
            offsets[n].append(at)
            at += n
        for n, own in offsets.items():
            found[n].append((used[n], len(own), sequence, own[0]))
            used[n] += count * len(own)
        sequence += count
    return {n: dict(zip(("rank", "each", "sequence", "offset"), np.array(v, np.int64).T)) for n, v in found.items()}


PLACE = [T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)]


def packed(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. ``cut`` must be a written table (see ``pack``)."""
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))), "piece_counts")
    # At most one row per length.
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(total, capacity))
    ranked = cut.join(counts.drop("n"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    kept = [c for c in cut.columns if c not in ("part", "nth")]
    source = ranked.select(*kept, "rank")
    schema = T.StructType([*source.schema.fields[:-1], *PLACE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own, slots = np.flatnonzero(length == n), table[int(n)]
                k = np.searchsorted(slots["rank"], rank[own], side="right") - 1
                past, each = rank[own] - slots["rank"][k], slots["each"][k]
                sequence[own] = slots["sequence"][k] + past // each
                offset[own] = slots["offset"][k] + past % each * n  # equal lengths stand side by side
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, encoder: dict, capacity: int = 1024, end_id: int = 2, **options) -> DataFrame:
    """Tokenise, cut and pack ``docs``; one row per piece."""
    return packed(materialise(pieces(docs, encoder, capacity, end_id, **options), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence: its pieces in order, and ``ids`` if the pieces carry them. A group is at most one capacity."""
    fields = ["offset", "doc_id", "piece", "start", "length"] + ["ids"] * ("ids" in placed.columns)
    grouped = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pieces"))
    if "ids" in placed.columns:
        grouped = grouped.withColumn("ids", F.expr("aggregate(pieces, X'', (held, p) -> concat(held, p.ids))"))
    return grouped
