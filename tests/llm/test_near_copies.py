"""Similarity joins against brute force: SimHash, passages, embeddings, linked groups."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from fleetlint.llm import embeddings, simhash, substring
from fleetlint.llm.common import components

DOCS = "doc_id long, text string, fp long, stretches string, n_chars int"


def documents(spark, texts):
    return spark.createDataFrame([(k, t, 1, "s", len(t or "")) for k, t in texts.items()], DOCS).repartition(3)


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def corpus(seed=0, n=60):
    """Prose with exact copies, edited copies, shared passages and odd texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    texts = {}
    passage = [rng.choice(words) for _ in range(70)]
    for k in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(5, 260))]
        if k % 5 == 1:
            own = texts[k - 1].split()
        if k % 5 == 2:
            own = texts[k - 1].split()
            own[rng.randrange(len(own))] = "edited"
        if k % 4 == 3:
            at = rng.randrange(len(own))
            own[at:at] = passage
        texts[k] = " ".join(own)
    extra = [None, "", " \n", "one", "ONE", "word " * 400, "word " * 300, "É é", " ".join(passage), " ".join(passage[:50])]
    return texts | {n + k: t for k, t in enumerate(extra)}


# -- SimHash --------------------------------------------------------------------


def brute_fingerprint(text, shingle):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k: k + shingle]) for k in range(len(words) - shingle + 1)] or [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, radius):
    groups = Union(fps)
    ids = list(fps)
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                groups.join(i, j)
    return {i: groups.root(i) for i in ids}


@pytest.mark.parametrize("shingle,radius,limit", [(4, 4, simhash.LIMIT), (5, 8, simhash.LIMIT), (4, 4, 3)])
def test_groups_equal_brute_force(spark, shingle, radius, limit):
    texts = corpus()
    fps = {k: brute_fingerprint(t, shingle) for k, t in texts.items()}
    want = brute_groups(fps, radius)
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in simhash.groups(docs.unionAll(docs.where("doc_id < 3")), shingle, radius, limit=limit).collect()}
    assert {k: r.fp % (1 << 64) for k, r in got.items()} == fps
    assert {k: r.component_id for k, r in got.items()} == want


def test_contract_columns_and_empty_table(spark):
    docs = documents(spark, {3: "", 9: None, 11: "a b c"})
    got = {r.doc_id: r for r in simhash.linked(docs).collect()}
    assert got[3].fingerprint == got[9].fingerprint == "0" * 16
    assert got[9].component_id == 3 and got[11].component_id == 11
    assert simhash.linked(docs.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [simhash.LIMIT, 40])
def test_dense_group_of_fingerprints(spark, limit):
    """Many distinct fingerprints around one pattern, and far ones; nodes beyond the limit go a level deeper."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:
        x = centre
        for b in rng.sample(range(64), rng.randrange(1, 9)):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    ids = {simhash.signed(x): x for x in fps}
    table = spark.createDataFrame([(i,) for i in ids], "fp long").repartition(4)
    edges = simhash.links(table, 4, limit).collect()
    got = Union(ids)
    for e in edges:
        got.join(e.a, e.b)
    want = brute_groups({i: x for i, x in ids.items()}, 4)
    assert {i: got.root(i) for i in ids} == want


def test_search_of_one_node():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << b) for b in range(0, 60, 2)]))
    roots = simhash.search(fps, 4)
    want = brute_groups({k: int(x) for k, x in enumerate(fps)}, 4)
    assert [want[k] for k in range(len(fps))] == [want[int(r)] for r in roots]
    assert len(set(want.values())) == len(set(roots.tolist()))


def test_one_of_each(spark):
    texts = {5: "a b c d e f", 2: "A b c d e F", 7: "other words stand here now", 8: None}
    docs = documents(spark, texts)
    other = spark.createDataFrame([(7, "a quite different text", 1, "s", 3), (None, "a b c d e f", 1, "s", 3)], DOCS)
    got = simhash.one_of_each(docs.unionAll(docs.where("doc_id = 2")).unionAll(other))
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [
        (0, "a b c d e f"), (2, "A b c d e F"), (7, "a quite different text"), (8, "")]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_equals_brute_force(spark):
    texts = corpus(3)
    want = brute_groups({k: brute_fingerprint(t, 4) for k, t in texts.items()}, 4)
    assert sorted(r.doc_id for r in simhash.one_of_each(documents(spark, texts)).collect()) == sorted(set(want.values()))


def test_components(spark):
    rng = random.Random(8)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(1000, 1200)]
    some = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    edges = chain + star + some + [(5, 5)]
    want = Union({i for e in edges for i in e})
    for a, b in edges:
        want.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: want.root(i) for a, b in edges for i in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# -- passages -------------------------------------------------------------------


def brute_removed(texts, window):
    words = {k: (t or "").encode().split() for k, t in texts.items()}
    first = {}
    for k in sorted(texts):
        for j in range(len(words[k]) - window + 1):
            first.setdefault(tuple(words[k][j: j + window]), k)
    gone = {}
    for k, own in words.items():
        gone[k] = {j + i for j in range(len(own) - window + 1) if first[tuple(own[j: j + window])] < k for i in range(window)}
    return words, gone


@pytest.mark.parametrize("window,gram,seed", [(50, 16, 0), (50, 16, 1), (8, 3, 2)])
def test_passages_equal_brute_force(spark, window, gram, seed):
    texts = corpus(seed)
    words, gone = brute_removed(texts, window)
    got = {r.doc_id: r for r in substring.digests(documents(spark, texts), window, gram).collect()}
    assert set(got) == set(texts)
    for k, own in words.items():
        kept = b" ".join(w for j, w in enumerate(own) if j not in gone[k])
        assert (got[k].n_words, got[k].n_removed) == (len(own), len(gone[k]))
        assert got[k].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_texts_without_passages(spark):
    texts = corpus()
    words, gone = brute_removed(texts, 50)
    docs = documents(spark, texts)
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    for k, own in words.items():
        kept = [w for j, w in enumerate(own) if j not in gone[k]]
        assert (got[k].text or "").encode().split() == kept
        if not gone[k]:
            assert got[k].text == texts[k]
        else:
            assert got[k].n_chars == len(got[k].text)
    assert substring.without_repeats(docs.limit(0)).collect() == []
    assert substring.digests(docs.limit(0)).collect() == []


def test_repeated_rows_of_one_id_remove_nothing(spark):
    docs = documents(spark, {1: " ".join(f"w{k}" for k in range(80))})
    assert [r.n_removed for r in substring.digests(docs.unionAll(docs)).collect()] == [0, 0]


def test_lines_survive_a_cut():
    assert substring.cut_text(b"a b\nc d\ne f", [{"lo": 2, "hi": 4}]) == b"a b\ne f"
    assert substring.cut_text(b"a b c", [{"lo": 0, "hi": 3}]) == b""


# -- embeddings -----------------------------------------------------------------


def vectors(seed=0, dims=32):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((60, dims))
    near = base[:20] + 0.05 * rng.standard_normal((20, dims))
    hub = base[0] + 0.08 * rng.standard_normal((40, dims))
    rows = [v.tolist() for v in np.concatenate([base, near, hub, base[:5], 3 * base[5:8]])]
    odd = [None, [], [0.0] * dims, [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [None] * dims, [1.0, 2.0], [2.0, 4.0], [1e200, 2e200]]
    return {k: v for k, v in enumerate(rows + odd)}


def brute_links(table, cosine):
    given = {k: embeddings.scaled(v) for k, v in table.items()}
    links = {k: set() for k in table}
    groups = Union(table)
    for i, x in given.items():
        for j, y in given.items():
            if i < j and x is not None and y is not None and len(x) == len(y) and (
                    (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= cosine):
                links[i].add(j)
                links[j].add(i)
                groups.join(i, j)
    return {k: len(v) for k, v in links.items()}, {k: groups.root(k) for k in table}


def test_pairs_exactly_at_the_bound_are_linked(spark):
    """19, 5, 3, 2, 1 has length 20: its cosine with a unit vector along the 19 is 0.95 to the last bit."""
    rng, table = random.Random(6), {}
    for k in range(300):
        places = rng.sample(range(64), 5)
        sign = rng.choice([1.0, -1.0])
        x, y = [0.0] * 64, [0.0] * 64
        for place, size in zip(places, (19.0, 5.0, 3.0, 2.0, 1.0)):
            x[place] = size * sign
        y[places[0]] = sign * rng.choice([1.0, 2.0, 7.0])
        table |= {2 * k: x, 2 * k + 1: y}
    df = spark.createDataFrame(list(table.items()), "vec_id long, embedding array<float>")
    degree, group = brute_links(table, 0.95)
    assert all(degree[k] for k in range(0, 600, 2))
    for block_dims in (16, 8):
        got = {r.vec_id: r for r in embeddings.linked(df, block_dims=block_dims).collect()}
        assert {k: r.n_links for k, r in got.items()} == degree
        assert {k: r.component_id for k, r in got.items()} == group


@pytest.mark.parametrize("block_dims,chunk", [(16, 32_768), (8, 9), (4, 32_768)])
def test_vectors_equal_brute_force(spark, block_dims, chunk):
    table = vectors()
    degree, group = brute_links(table, 0.95)
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in table.items()], "vec_id long, embedding array<double>, same string, rep int")
    got = {r.vec_id: r for r in embeddings.linked(df.repartition(3), block_dims=block_dims, chunk=chunk).collect()}
    assert {k: r.n_links for k, r in got.items()} == degree
    assert {k: r.component_id for k, r in got.items()} == group
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vector_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.linked(spark.createDataFrame([], schema)).collect() == []
    rows = spark.createDataFrame([(4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [1.0, 0.0]), (9, None)], schema)
    got = embeddings.linked(rows).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.kept) for r in got) == [(-1, 0, True), (4, 1, True), (4, 1, True), (9, 0, True)]
