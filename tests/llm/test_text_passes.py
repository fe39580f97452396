"""Rules, encoding, packing and pages: whole results against the libraries or brute force."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetlint.llm import bpe, html, licenses, packing, quality_rules
from fleetlint.llm.queries import byte_encoder

DOCS = "doc_id long, text string, row string, raw string, n_words long, score double"
ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "word " * 3000, "x" * 20_000, "one two\tthree\x0bfour\x0cfive\rsix",
    "Ünï  cödé spaces here  ", "tabs\t\tand\n \n lines ", " lead", "trail ", "a\n  b", "a \nb", "it's we'll I'M",
    "<|endoftext|> inside <|startoftext|>text<|endoftext|>", "\x1c\x1d sep\x1e", "ΣΑΣ ὈΔΥΣΣΕΎΣ İstanbul ǅ", "é nörm",
    "日本語 テキスト 123 ４５", "😀😃 emoji", "#*$%&|<> symbols", "a b c d e " * 4, "LOUD WORDS HERE ALWAYS " * 6, "\x00nul",
]


def documents(spark, texts):
    rows = [(k, t, "x", "y", 7, 0.5) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def rows_by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# -- rules ----------------------------------------------------------------------


def brute_measures(text):
    raw = (text or "").encode()
    words = raw.split()
    grams = Counter(tuple(words[k: k + 5]) for k in range(len(words) - 4))
    inside = {k + j for k in range(len(words) - 4) if grams[tuple(words[k: k + 5])] > 1 for j in range(5)}
    lines = [line for line in raw.split(b"\n") if line.split()]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(len(w.decode()) for w in words), symbols, len(lines) - len(set(lines)), len(inside)


def test_rule_measures(spark):
    got = rows_by_id(quality_rules.judged(documents(spark, ODD_TEXTS)))
    assert len(got) == len(ODD_TEXTS)
    for k, text in enumerate(ODD_TEXTS):
        r = got[k]
        n, chars, symbols, dup, rep = brute_measures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), text
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)


def test_policies_and_ablations(spark):
    texts = ["few", "LOUD WORD NUMBER " + " ".join(f"WORD{k}" for k in range(20)), " ".join(f"word{k}" for k in range(30))]
    entries = quality_rules.ledger(documents(spark, texts), ["doc_id"])
    kept = {r.row.doc_id for r in entries.where(quality_rules.passes("v2")).collect()}
    assert kept == {2}
    assert {r.row.doc_id for r in entries.where(quality_rules.passes("base")).collect()} == {1, 2}
    found = rows_by_id(quality_rules.ablations(entries, "v2"), "rule")
    assert len(found) == 6
    assert (found["few_words"].n_failed, found["few_words"].n_only, found["few_words"].n_kept_without) == (1, 1, 2)
    assert (found["shouting"].n_only, found["symbols"].n_failed) == (1, 0)


def test_rules_keep_all_columns(spark):
    good = " ".join(f"word{k}" for k in range(30))
    docs = documents(spark, [good, good, "bad", None])
    docs = docs.unionAll(docs.where("doc_id = 0"))
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 0, 1]
    assert quality_rules.keep_good(docs.limit(0)).collect() == []
    assert quality_rules.judged(docs.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n#A", max_size=60))
def test_measures_of_any_text(text):
    n, chars, symbols, dup, rep = brute_measures(text)
    got = quality_rules.measure(text.encode())
    assert (got[0], got[1], got[2], got[4], got[5]) == (n, chars, symbols, dup, rep)


def test_many_distinct_words_stay_exact():
    rng = random.Random(1)
    words = [f"w{rng.randrange(9000)}" for _ in range(20_000)] + ["a", "b", "c", "d", "e", "x", "a", "b", "c", "d", "e"]
    text = " ".join(words)
    assert quality_rules.measure(text.encode())[5] == brute_measures(text)[4]


# -- encoding -------------------------------------------------------------------

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD_FILE), bpe.WordEncoder(WORD_FILE)


def same_as_library(library, encoder, text):
    ids = library.encode(text, add_special_tokens=False).ids
    packed, decoded = encoder.encode(text.encode())
    assert list(struct.unpack(f"<{len(ids)}I", packed)) == ids
    assert decoded.decode() == library.decode(ids, skip_special_tokens=False) == encoder.decode(packed)


def test_encoding_equals_the_library(word_library):
    for text in ODD_TEXTS:
        same_as_library(*word_library, text or "")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_encoding_of_any_text(word_library, text):
    same_as_library(*word_library, text.encode("utf-8", "replace").decode())


def test_long_words_merge_like_short_ones(word_library):
    _, encoder = word_library
    rng = random.Random(3)
    for _ in range(50):
        letters = [rng.choice("theandingr") for _ in range(rng.randrange(2, 60))]
        assert encoder._merge(list(letters)) == encoder._merge_long(list(letters))


def test_cuts_never_split_a_token(word_library):
    _, encoder = word_library
    for token in list(encoder.vocab)[::97]:
        bare = token[: -len(encoder.end)] if token.endswith(encoder.end) else token
        assert encoder.cut(bare) == [bare]


def test_encoding_query(spark, word_library):
    library, _ = word_library
    docs = documents(spark, ODD_TEXTS)
    got = rows_by_id(bpe.digests(docs, WORD_FILE))
    for k, text in enumerate(ODD_TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[k].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.digests(docs.limit(0), WORD_FILE).collect() == []
    twice = bpe.digests(docs.where("doc_id = 5").unionAll(docs.where("doc_id = 5")), WORD_FILE).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    full = bpe.encoded(docs, WORD_FILE, ["doc_id", "raw"]).where("row.doc_id = 14").first()
    assert full.row.raw == "y" and full.decoded == library.decode(
        list(struct.unpack(f"<{len(full.ids) // 4}I", full.ids)), skip_special_tokens=False)


# -- packing --------------------------------------------------------------------


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.ByteEncoder(**byte_encoder())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'.1é \x1c"), st.characters(codec="utf-8")), max_size=60))
def test_byte_ids_of_any_text(byte_library, text):
    library, encoder = byte_library
    ids = library.encode(text, add_special_tokens=False).ids
    assert list(struct.unpack(f"<{len(ids)}I", encoder.encode(text.encode()))) == ids


def check_packing(library, texts, rows, capacity=1024):
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for k, own in by_doc.items():
        ids = library.encode(texts[k] or "", add_special_tokens=False).ids + [2]
        at = 0
        for n, r in enumerate(own):
            assert (r.piece, r.start) == (n, at)
            assert r.length == capacity or n == 0
            piece = ids[at: at + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
            at += r.length
        assert at == len(ids)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_query(spark, byte_library):
    library, _ = byte_library
    rng = random.Random(5)
    texts = ODD_TEXTS + [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(900))) for _ in range(120)]
    rows = packing.pack(documents(spark, texts), byte_encoder()).collect()
    used = check_packing(library, texts, rows)
    assert used <= -(-sum(r.length for r in rows) // 1024) + 3


def test_packing_of_odd_tables(spark):
    docs = documents(spark, ["same text"] * 5)
    assert packing.pack(docs.limit(0), byte_encoder()).collect() == []
    rows = packing.pack(docs.unionAll(docs), byte_encoder(), with_ids=True)
    assert rows.count() == 10
    sequence = packing.sequences(rows).collect()
    assert len(sequence) == 1 and len(sequence[0].pieces) == 10
    assert len(sequence[0].ids) == 4 * sum(p.length for p in sequence[0].pieces)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_uses_every_piece_once(counts):
    kinds = packing.plan(counts, 60)
    used = Counter()
    for many, held in kinds:
        assert many > 0 and 0 < sum(held) <= 60
        assert sum(3 * n > 60 for n in held) <= 2
        for n in held:
            used[n] += many
    assert used == Counter(counts)
    large = sum(c for n, c in counts.items() if n > 30)
    bound = max(-(-sum(n * c for n, c in counts.items()) // 60), large)
    assert sum(many for many, _ in kinds) <= 1.5 * bound + 1


# -- pages ----------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href='/'>Home page</a></li></ul></nav><div class=\"ad\">Buy now cheap things today.</div>"
    "<article><h1>Title &amp; more</h1><p><b>First</b> part&nbsp;one.<br><p>Second <i>pa</i>rt.</p>{}</article>"
    "<aside>Side bar words</aside><footer>&copy; all rights</footer></body></html>"
)


def test_pages(spark):
    pages = [
        PAGE.format(""), PAGE.format("<div class='ad'>Inner advert words here</div><p>Third.</p>"), None, "", "plain text",
        "<p>unclosed <b>words", "<script>never closed", PAGE.format("<p>" + "long " * 50_000 + "</p>"), "<article></article>",
    ]
    rows = [(k, f"http://h/{k}", p, "x") for k, p in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = rows_by_id(html.main_text(table), "page_id")
    assert got[0].text == "Title & more First part one. Second part."
    assert got[1].text == "Title & more First part one. Second part. Third."
    assert [got[k].text for k in (2, 3, 6, 8)] == [""] * 4
    assert got[4].text == "plain text" and got[5].text == "unclosed words"
    assert got[7].n_chars == len("Title & more First part one. Second part. ") + 5 * 50_000 - 1
    assert html.main_text(table.limit(0)).collect() == []
    assert html.main_text(table.where("page_id = 0").unionAll(table.where("page_id = 0"))).count() == 2


def test_best_run_is_the_largest():
    rng = random.Random(2)
    for _ in range(200):
        scores = [rng.randrange(-5, 6) for _ in range(rng.randrange(12))]
        a, b = html.best_run(scores)
        best = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)], default=0)
        assert sum(scores[a:b]) == max(best, 0)


# -- licences -------------------------------------------------------------------


def test_licences(spark):
    from fleetlint.model import MIT_TEXT

    texts = [
        "Some prose.\nReleased under the MIT License.\nMore prose.", "Licensed under the Apache License, Version 2.0.",
        "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
        "Before.\n" + MIT_TEXT.replace("{holder}", "2020 Somebody") + "\nAfter.", None, "", "no cue here", "a licensed driver drove home",
        "Licensed under CC BY-NC-XX 4.0.", "licence\n" * 500,
    ]
    rows = licenses.found_licences(documents(spark, texts)).collect()
    sure = {r.doc_id: r.licence for r in rows if r.confirmed}
    assert sure == {0: "MIT", 1: "Apache-2.0", 2: "CC-BY-NC-4.0", 3: "GPL-3.0", 4: "MIT"}
    assert next(r for r in rows if r.doc_id == 0).first_line == 1
    assert licenses.found_licences(documents(spark, texts).limit(0)).collect() == []


def test_letters_that_python_does_not_know():
    """Unassigned code points below U+0800 as well: the library may take one for a letter that Python does not have."""
    import struct

    library, encoder = Tokenizer.from_file(WORD_FILE), bpe.WordEncoder(WORD_FILE)
    codes = [0x558, 0x58B, 0x58C, *range(0x370, 0x800), *range(0x800, 0x30000, 41)]
    texts = [f"a{chr(k)}b {chr(k)}" for k in codes if not 0xD800 <= k < 0xE000]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = encoder.encode(text.encode())[0]
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want.ids, repr(text)
