"""Hard negatives against a plain count over all pairs in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlint.llm import hard_negatives
from fleetlint.llm.hard_negatives import Packed, mine
from fleetlint.llm.queries import op11_kronecker_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def by_hand(rows, every, positives=5, negatives=5):
    known = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        known[vec_id] = (label, [math.floor(256 * x) for x in vector])
    found = []
    for a, (label, vector) in known.items():
        if a % every:
            continue
        scored = [
            (-sum(x * y for x, y in zip(vector, v)), i, other) for i, (other, v) in known.items()
            if i != a and len(v) == len(vector)
        ]
        same = sorted(s[:2] for s in scored if s[2] == label)[:positives]
        rest = sorted(s[:2] for s in scored if s[2] != label)
        for p, positive in same:
            fitting = [(s, i) for s, i in rest if 80 * -p <= 100 * -s <= 100 * -p][:negatives]
            found += [(a, positive, k, i, -p, -s) for k, (s, i) in enumerate(fitting, 1)]
    return sorted(found)


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def some_rows(n, dims, seed, spread=1.0, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, dims))
    return [
        (k, [float(np.float32(x)) for x in (centres[rng.integers(4)] + 0.4 * rng.standard_normal(dims)) * spread],
         int(rng.integers(labels)))
        for k in range(n)
    ]


@pytest.mark.parametrize("spread", [0.1, 1.0, 3_000.0])
def test_equals_a_plain_count(spark, spread):
    rows = some_rows(220, 9, 1, spread)
    rows += [(300 + k, rows[k % 3][1], k % 3) for k in range(40)]  # many ties
    df = spark.createDataFrame(rows, SCHEMA)
    expected = by_hand(rows, 10)
    assert expected
    for chunk in (hard_negatives.CHUNK, 17):
        assert result(mine(df, F.col("vec_id") % 10 == 0, F.col("label"), chunk=chunk)) == expected


def test_odd_rows(spark):
    rows = some_rows(60, 4, 2)
    rows[3] = (3, None, 1)
    rows[4] = (4, [None, 1.0, 1.0, 1.0], 1)
    rows[5] = (5, [float("nan"), 1.0, 1.0, 1.0], 1)
    rows[6] = (6, [1.0, float("inf"), 1.0, 1.0], 1)
    rows[7] = (7, rows[7][1], None)
    rows[8] = (8, [1.0, 2.0], 0)
    rows += [(100, [], 0), (101, [], 0), (102, [], 1), (None, [1.0] * 4, 1), (103, [5e4, -5e4, 1.0, 0.0], 1), (110, [5e4] * 4, 2)]
    expected = by_hand(rows, 10)
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({
        c: F.lit("x") for c in ("chunk", "part", "dims", "parts", "score", "positives", "rank")})
    repeated = clash.unionByName(clash)
    assert result(mine(clash, F.col("vec_id") % 10 == 0, F.col("label"))) == expected
    assert result(mine(repeated, F.col("vec_id") % 10 == 0, F.col("label"))) == expected
    assert any(row[0] == 100 for row in expected)


def test_rows_beyond_a_long_take_no_part(spark):
    rows = some_rows(30, 3, 3)
    df = spark.createDataFrame([*rows, (40, [1e300, 1.0, 1.0], 1), (50, [1e9, 1.0, 1.0], 0)], SCHEMA)
    assert result(mine(df, F.col("vec_id") % 10 == 0, F.col("label"))) == by_hand(rows, 10)


def test_empty_table_and_one_label(spark):
    assert mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    alone = spark.createDataFrame([(k, v, 1) for k, v, _ in some_rows(30, 3, 4)], SCHEMA)
    assert mine(alone, F.col("vec_id") % 10 == 0, F.col("label")).count() == 0


def test_packed_products_are_exact():
    rng = random.Random(5)
    for top in (3, 200, 30_000, 2**27):
        parts = np.array([[rng.randint(-top, top) for _ in range(6)] for _ in range(23)], np.int64)
        anchors = np.array([[rng.randint(-top, top) for _ in range(6)] for _ in range(4)], np.int64)
        packed = Packed(np.arange(23), ["a"] * 23, parts)
        assert (packed.scores(anchors, 3, 20) == anchors @ parts[3:20].T).all()
    narrow = Packed(np.arange(23), ["a"] * 23, parts % 100)
    narrow.scores(anchors % 100, 0, 23)
    assert [key[0] for key in narrow._words] == [3]  # three fields of 16 bits in a word


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [
        (r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
        for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ]
    assert result(op11_kronecker_negatives(spark, folder)) == by_hand(rows, 100)
