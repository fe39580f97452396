"""The pipeline's stages on the smallest tables, each held against a plain version on its own input."""

import os

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from fleetlint.llm import statements, toxicity
from fleetlint.session import materialise
from test_near_copies import brute_fingerprint, brute_groups, brute_removed

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not at hand")


def harmless(spark, docs, texts):
    """A learned score: held against the operator's own decisions, row by row."""
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    return {r.doc_id: texts[r.doc_id] for r in toxicity.predictions(docs, labels).where("predicted = 0").collect()}


def good(spark, docs, texts):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return {r[0]: texts[r[0]] for r in con.execute(f"SELECT doc_id FROM ({statements.OP9}) WHERE kept").fetchall()}


def one_of_each(spark, docs, texts):
    groups = brute_groups({k: brute_fingerprint(t, 4) for k, t in texts.items()}, 4)
    return {k: texts[k] for k, root in groups.items() if k == root}


def without_repeats(spark, docs, texts):
    words, gone = brute_removed(texts, 50)
    return {k: " ".join(w.decode() for j, w in enumerate(own) if j not in gone[k]) for k, own in words.items()}


BY_HAND = {
    "toxicity": harmless, "quality_rules": good, "near_duplicates": one_of_each, "repeated_passages": without_repeats}


def test_stages_equal_plain_versions_of_them(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        want = BY_HAND[name](spark, docs, before)
        docs = materialise(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns
        rows = docs.collect()
        now = {r.doc_id: r.text for r in rows}
        assert len(rows) == len(now) > 0.4 * len(before)
        if name == "repeated_passages":  # white space between kept words is the text's own
            assert {k: (t or "").encode().split() for k, t in now.items()} == {k: t.encode().split() for k, t in want.items()}
        else:
            assert now == want
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    lengths, loads = {}, {}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        loads.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert lengths == {k: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in now.items()}
    for pieces in loads.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(loads) <= 1.05 * -(-sum(lengths.values()) // 1024) + 1
    assert sorted(map(repr, corpus_pipeline.run(spark, SF_DIR).select("doc_id", "piece", "ids_crc32").collect())) == sorted(
        repr(r) for r in spark.createDataFrame(packed).select("doc_id", "piece", "ids_crc32").collect())


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0, name
    odd = docs.limit(30).selectExpr(
        "*", "'x' AS row", "'x' AS fp", "'x' AS component_id", "'x' AS raw", "'x' AS stretches", "1 AS score")
    odd = odd.unionByName(odd.limit(2)).unionByName(odd.limit(1).withColumns({"doc_id": odd.doc_id * 0 - 5, "text": odd.lang * 0}).selectExpr(
        *odd.columns[:1], "cast(null AS string) AS text", *odd.columns[2:]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF_DIR)
        assert out.columns == odd.columns and out.count() > 0, name


def test_registered():
    names = entry_point.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 13
    assert set(statements.SQL) <= set(entry_point.oracle_sql())


def test_operators_equal_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    for name, sql in statements.SQL.items():
        df = entry_point.queries()[name](spark, SF_DIR)
        result = con.execute(sql)
        heads = [d[0] for d in result.description]
        assert sorted(df.columns) == sorted(heads)
        assert sorted(df.select(heads).collect(), key=repr) == sorted(
            [tuple(r) for r in result.fetchall()], key=repr)
