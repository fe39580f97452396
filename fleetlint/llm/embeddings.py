"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine of at least ``c`` have a squared distance of at most
``2 - 2c``. A fixed random rotation spreads it over all coordinates, which are
split into blocks of few dimensions; the budget is shared out in proportion to
their dimensions, so at least one block of every linked pair stays within its
own. Each block is range-joined under its budget, with a slack for rounding, and
what any block finds is decided by the cosine of the vectors as they are given,
``dot / (norm * norm)`` in double precision.

The range join files a vector under the signs of its leading block
coordinates, taken from the mean. Where the signs of a pair differ, the two
distances from the border add up, so one of the two spends at most half of the
budget on crossing: it also looks into every cell that it can reach so. Some
signs make the cells that are shuffled, the next ones cells inside a task.
Cells are dealt in chunks of bounded size, so no cell is one task.

A pair counts once: in the first block whose budget it keeps, and from the
side that may cross (from the smaller id if both may). Tasks give out link
counts per vector and a spanning forest, never the pairs, so dense groups cost
rows in proportion to their members.

Defined cases: vectors that are null, empty or zero or hold a null or
non-finite component link with nothing; identical vectors are joined once and
counted as often as they occur, repeated ids included; vectors of different
length never link; rows without an id link with nothing and are kept; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlint.llm.common import column, components
from fleetlint.session import materialise, tune

BLOCK_DIMS = 16
#: Signs that make shuffled cells, and further signs used inside a task.
CELL_SIGNS, INNER_SIGNS = 2, 8
#: Most vectors of a cell on either side of one task.
CHUNK = 32_768
_SLACK = 1e-5
#: Squared distance that rounding may add to a linked pair.
_ROUNDING = 4e-6
_PAIRS = 20_000


def rotation(dims: int) -> np.ndarray:
    """An orthogonal matrix that depends on the number of dimensions only."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_borders(dims: int, block_dims: int = BLOCK_DIMS) -> list[tuple[int, int]]:
    n = max(1, round(dims / block_dims))
    edges = [dims * k // n for k in range(n + 1)]
    return list(zip(edges[:-1], edges[1:]))


def scaled(vector: list | None) -> np.ndarray | None:
    """The vector times a power of two, which is exact and keeps squares in range; None if it has no direction."""
    if not vector or any(v is None for v in vector):
        return None
    x = np.array(vector, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    return np.ldexp(x, -int(np.frexp(top)[1]))


def packed(x: np.ndarray) -> bytes:
    """The numbers in 32 bits each where that is exact."""
    short = x.astype("<f4")
    return (short if (short == x).all() else x.astype("<f8")).tobytes()


def unpacked(raws: list[bytes], dims: int) -> np.ndarray:
    if all(len(raw) == 4 * dims for raw in raws):
        return np.frombuffer(b"".join(raws), "<f4").reshape(-1, dims).astype(np.float64)
    return np.array([np.frombuffer(raw, "<f4" if len(raw) == 4 * dims else "<f8") for raw in raws], np.float64)


_ROTATED = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("same", T.BinaryType()),
    T.StructField("dims", T.IntegerType(), False), T.StructField("turned", T.BinaryType()), T.StructField("given", T.BinaryType()),
])


def rotated(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Per row: id, a digest of the vector, the rotated unit vector (32 bits a number) and the vector itself, scaled
    (null if there is no direction)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            same, dims, turned, given = [], [], [], []
            for vec_id, value in zip(ids, batch.column(1).to_pylist()):
                x = scaled(value) if vec_id is not None else None
                if x is None:
                    same.append(None)
                    dims.append(0)
                    turned.append(None)
                    given.append(None)
                    continue
                n = len(x)
                if n not in turns:
                    turns[n] = rotation(n)
                same.append(hashlib.md5(x.tobytes()).digest())
                dims.append(n)
                turned.append((turns[n] @ (x / np.sqrt((x * x).sum()))).astype("<f4").tobytes())
                given.append(packed(x))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(same, pa.binary()), pa.array(dims, pa.int32()),
                pa.array(turned, pa.binary()), pa.array(given, pa.binary()),
            ], names=_ROTATED.names)

    return vectors.select(column(id_col).cast("long"), column(vec_col)).mapInArrow(run, _ROTATED)


_SUMS = T.StructType([
    T.StructField("dims", T.IntegerType()), T.StructField("n", T.LongType()),
    T.StructField("sums", T.ArrayType(T.DoubleType())),
])


def means(reps: DataFrame) -> dict[int, np.ndarray]:
    """The mean rotated vector per number of dimensions, over all rows; a task gives out one partial sum each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = found.setdefault(n, [0, np.zeros(n)])
                own[0] += 1
                own[1] += np.frombuffer(raw, "<f4")
        if found:
            yield pa.RecordBatch.from_arrays([
                pa.array(list(found), pa.int32()), pa.array([f[0] for f in found.values()], pa.int64()),
                pa.array([f[1].tolist() for f in found.values()], pa.list_(pa.float64())),
            ], names=_SUMS.names)

    sums = reps.select("dims", "turned").mapInArrow(run, _SUMS)
    spread = sums.select("dims", "n", F.posexplode("sums").alias("at", "value"))
    rows = spread.groupBy("dims", "at").agg((F.sum("value") / F.sum("n")).alias("mean")).collect()
    result: dict[int, np.ndarray] = {}
    for r in rows:
        result.setdefault(r["dims"], np.zeros(r["dims"]))[r["at"]] = r["mean"]
    return result


def crossing(squares: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """What crossing the borders in ``flips`` (bits) costs each vector; summed in one fixed order."""
    cost = np.zeros(len(squares))
    for j in range(squares.shape[1]):
        cost += squares[:, j] * (flips >> j & 1)
    return cost


def codes(centred: np.ndarray) -> np.ndarray:
    code = np.zeros(len(centred), np.int64)
    for j in range(centred.shape[1]):
        code |= (centred[:, j] >= 0).astype(np.int64) << j
    return code


class Shape:
    """Blocks, budgets and signs of vectors of one length."""

    def __init__(self, dims: int, cosine: float, mean: np.ndarray, block_dims: int):
        self.borders = block_borders(dims, block_dims)
        # The slack is far above what 32 bits a coordinate can add to a squared distance.
        self.budgets = [(2 - 2 * cosine + _ROUNDING) * (b - a) / dims + 1e-12 for a, b in self.borders]
        self.mean = mean

    def leading(self, turned: np.ndarray, block: int, signs: int) -> np.ndarray:
        a, b = self.borders[block]
        b = min(b, a + signs)
        return turned[:, a:b] - self.mean[a:b]


_FILED = T.StructType([
    T.StructField("dims", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("cell", T.IntegerType()),
    T.StructField("probe", T.BooleanType()), T.StructField("rep", T.LongType()), T.StructField("copies", T.LongType()),
    T.StructField("turned", T.BinaryType()), T.StructField("given", T.BinaryType()),
])


def filed(reps: DataFrame, shapes: dict[int, Shape], with_vectors: bool) -> DataFrame:
    """Each vector as a member of its cell in every block, and as a probe of all cells it can reach."""
    schema = _FILED if with_vectors else T.StructType(_FILED.fields[:-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_dims = batch.column("dims").to_numpy()
            for n in np.unique(all_dims):
                part = batch.filter(pa.array(all_dims == n))
                turned = unpacked(part.column("turned").to_pylist(), int(n))
                shape = shapes[int(n)]
                for block in range(len(shape.borders)):
                    z = shape.leading(turned, block, CELL_SIGNS)
                    own, squares = codes(z), z * z
                    for flips in range(-1, 1 << z.shape[1]):  # -1: as a member
                        if flips < 0:
                            picked = np.arange(len(own))
                        else:
                            cost = crossing(squares, np.full(len(own), flips))
                            picked = np.flatnonzero(cost <= shape.budgets[block] / 2 + _SLACK)
                        if not len(picked):
                            continue
                        take = part.take(pa.array(picked))
                        m = len(picked)
                        arrays = [
                            pa.array(np.full(m, n, np.int32)), pa.array(np.full(m, block, np.int32)),
                            pa.array((own[picked] ^ max(flips, 0)).astype(np.int32)), pa.array(np.full(m, flips >= 0)),
                            take.column("rep"), take.column("copies"),
                        ]
                        if with_vectors:
                            arrays += [take.column("turned"), take.column("given")]
                        yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return reps.select("rep", "copies", "dims", "turned", *["given"] * with_vectors).mapInArrow(run, schema)


_FOUND = T.StructType([
    T.StructField("rep", T.LongType()), T.StructField("links", T.LongType()), T.StructField("other", T.LongType()),
])


def join_cell(
    members: np.ndarray, member_given: np.ndarray, member_ids: np.ndarray, member_copies: np.ndarray,
    probes: np.ndarray, probe_given: np.ndarray, probe_ids: np.ndarray, probe_copies: np.ndarray,
    shape: Shape, block: int, cosine: float,
) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Link counts by id and a spanning forest of the links between probes and members that belong to this block."""
    signs = CELL_SIGNS + INNER_SIGNS
    a, b = shape.borders[block]
    budget, half = shape.budgets[block], shape.budgets[block] / 2
    zm, zp = shape.leading(members, block, signs), shape.leading(probes, block, signs)
    sm, sp = zm * zm, zp * zp
    cm, cp = codes(zm), codes(zp)
    bm, bp = members[:, a:b].astype(np.float32), probes[:, a:b].astype(np.float32)
    nm, np_ = (bm * bm).sum(axis=1), (bp * bp).sum(axis=1)
    degree_m, degree_p = np.zeros(len(members), np.int64), np.zeros(len(probes), np.int64)
    length_m, length_p = (np.sqrt((g * g).sum(axis=1)) for g in (member_given, probe_given))
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while (j := up.get(i, i)) != i:
            up[i] = up.get(j, j)
            i = j
        return i

    def verify(p: np.ndarray, m: np.ndarray) -> None:
        keep = (probe_given[p] * member_given[m]).sum(axis=1) / (length_p[p] * length_m[m]) >= cosine
        p, m = p[keep], m[keep]
        if not len(p):
            return
        gaps = (probes[p] - members[m]) ** 2
        keep = gaps[:, a:b].sum(axis=1) <= budget
        for (s, e), own in zip(shape.borders[:block], shape.budgets):
            keep &= gaps[:, s:e].sum(axis=1) > own
        flips = cp[p] ^ cm[m]
        keep &= (crossing(sm[m], flips) > half) | (probe_ids[p] < member_ids[m])
        p, m = p[keep], m[keep]
        np.add.at(degree_p, p, member_copies[m])
        np.add.at(degree_m, m, probe_copies[p])
        for i, j in zip(probe_ids[p].tolist(), member_ids[m].tolist()):
            i, j = root(i), root(j)
            if i != j:
                up[max(i, j)] = min(i, j)

    order = np.argsort(cm, kind="stable")
    borders = np.flatnonzero(np.diff(cm[order])) + 1
    for cell in np.split(order, borders):
        if not len(cell):
            continue
        near = np.flatnonzero(crossing(sp, cp ^ cm[cell[0]]) <= half)
        for at in range(0, len(near), 4_096):
            rows = near[at: at + 4_096]
            for to in range(0, len(cell), 4_096):
                cols = cell[to: to + 4_096]
                gap = np_[rows][:, None] + nm[cols] - 2 * (bp[rows] @ bm[cols].T)
                x, y = np.nonzero(gap <= budget + _SLACK)
                for k in range(0, len(x), _PAIRS):
                    p, m = rows[x[k: k + _PAIRS]], cols[y[k: k + _PAIRS]]
                    other = probe_ids[p] != member_ids[m]
                    verify(p[other], m[other])
    counts: dict[int, int] = {}
    for ids, degrees in ((member_ids, degree_m), (probe_ids, degree_p)):
        for i in np.flatnonzero(degrees):
            counts[int(ids[i])] = counts.get(int(ids[i]), 0) + int(degrees[i])
    return counts, [(i, root(i)) for i in up if root(i) != i]


def found_links(reps: DataFrame, cosine: float, block_dims: int, chunk: int) -> DataFrame:
    """Partial link counts (``rep, links``) and forest edges (``rep, other``) of distinct vectors."""
    shapes = {n: Shape(n, cosine, mean, block_dims) for n, mean in means(reps).items()}
    # A row per block and cell: bounded by the dimensions, not by the vectors.
    sizes = {
        (r["dims"], r["block"], r["cell"], r["probe"]): -(-r["n"] // chunk)
        for r in filed(reps, shapes, False).groupBy("dims", "block", "cell", "probe").agg(F.count("*").alias("n")).collect()
    }
    spark = reps.sparkSession
    grid = spark.createDataFrame(
        [(*key, parts, sizes.get((*key[:3], not key[3]), 0)) for key, parts in sizes.items()],
        "dims int, block int, cell int, probe boolean, parts int, across int")
    dealt = (
        filed(reps, shapes, True).join(F.broadcast(grid), ["dims", "block", "cell", "probe"])
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("to", F.explode(F.sequence(F.lit(1), F.col("across"))))
        .where("across > 0")
        .select(
            "dims", "block", "cell", F.when(F.col("probe"), F.col("own")).otherwise(F.col("to") - 1).alias("p_chunk"),
            F.when(F.col("probe"), F.col("to") - 1).otherwise(F.col("own")).alias("m_chunk"),
            "probe", "rep", "copies", "turned", "given")
    )

    def run(group: pa.Table) -> pa.Table:
        dims, block = group["dims"][0].as_py(), group["block"][0].as_py()
        side = group["probe"].to_numpy()

        def pick(mask):
            part = group.filter(pa.array(mask))
            turned, given = (unpacked(part[name].to_pylist(), dims) for name in ("turned", "given"))
            return turned, given, part["rep"].to_numpy(), part["copies"].to_numpy()

        counts, edges = join_cell(*pick(~side), *pick(side), shapes[dims], block, cosine)
        reps_, links_, others = [*counts, *[e[0] for e in edges]], list(counts.values()), [e[1] for e in edges]
        return pa.table({
            "rep": pa.array(reps_, pa.int64()), "links": pa.array([*links_, *[None] * len(edges)], pa.int64()),
            "other": pa.array([*[None] * len(counts), *others], pa.int64()),
        })

    return dealt.groupBy("dims", "block", "cell", "p_chunk", "m_chunk").applyInArrow(run, _FOUND)


def linked(
    vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding",
    block_dims: int = BLOCK_DIMS, chunk: int = CHUNK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    tune(vectors.sparkSession)
    rows = materialise(rotated(vectors, id_col, vec_col), "rotated")
    reps = materialise(
        rows.where("same IS NOT NULL").groupBy("same").agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("dims").alias("dims"),
            F.first("turned").alias("turned"), F.first("given").alias("given")), "distinct_vectors")
    found = materialise(found_links(reps, cosine, block_dims, chunk), "vector_links")
    degree = found.where("links IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    named = (
        reps.select("same", "rep", "copies").join(degree, "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "rep").alias("component_id"))
    )
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "same").join(named, "same", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
