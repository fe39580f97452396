"""The piece codec against the library on whole texts."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from fleetlint.llm import pieces
from fleetlint.llm.queries import op13_piece_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(text):
    ids = LIBRARY.encode(text or "", num_threads=1)
    return (
        len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())


def odd_texts(n, seed):
    rng = random.Random(seed)
    letters = ["a", "the", " ", "  ", "▁", "\n", "\t", "　", " ", "́", "\U0001f600", "<s>", "<0x0A>", "\x00", ".", "中"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("words", [pieces.WORDS, 50])
def test_texts_equal_the_library(monkeypatch, words):
    monkeypatch.setattr(pieces, "WORDS", words)
    codec = pieces.PieceCodec(PATH)
    assert codec.cuts
    texts = odd_texts(3_000, 1)
    for at in range(0, len(texts), 200):
        batch = texts[at: at + 200]
        for text, (ids, decoded) in zip(batch, codec.encode(batch)):
            whole = LIBRARY.encode(text)
            assert ids == ",".join(map(str, whole)) and decoded == LIBRARY.decode(whole), repr(text)
    assert len(codec.table) <= max(words, 200 * 41)


def test_every_character_in_a_word():
    codec = pieces.PieceCodec(PATH)
    texts = [f"a{chr(k)}b {chr(k)}" for k in range(1, 0x30000, 7) if not 0xD800 <= k < 0xE000]
    for text, (ids, decoded) in zip(texts, codec.encode(texts)):
        whole = LIBRARY.encode(text)
        assert ids == ",".join(map(str, whole)) and decoded == LIBRARY.decode(whole), repr(text)


def test_a_word_is_segmented_once():
    codec = pieces.PieceCodec(PATH)
    asked = []
    inner = codec.ids
    codec.ids = lambda words: asked.extend(words) or inner(words)
    codec.encode(["one two one", "two  one"])
    codec.encode(["two one three"])
    assert sorted(asked) == [" one", "one", "three", "two"]


def test_vocabulary_with_pieces_across_markers_is_not_cut(monkeypatch):
    codec = pieces.PieceCodec(PATH)
    codec.cuts = False
    codec.table = {}
    text = "a  b c"
    assert codec.encode([text, ""]) == [(",".join(map(str, LIBRARY.encode(text))), text), ("", "")]


def test_rows(spark):
    texts = [None, "", " ", "  a ", "x" * 30_000, "word " * 20_000, "a b", "a b", *odd_texts(50, 2)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("ids", "row", "raw", "n_tokens")})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(docs, PATH).collect()}
    assert got == {k: expected(t) for k, t in enumerate(texts)}
    both = {r.row.doc_id: (r.ids, r.decoded) for r in pieces.encoded(docs, PATH, ["doc_id"]).collect()}
    assert both == {k: (LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or ""))) for k, t in enumerate(texts)}
    assert pieces.digests(docs.limit(0), PATH).count() == 0


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op13_piece_codec(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert got == {r.doc_id: expected(r.text) for r in docs}
