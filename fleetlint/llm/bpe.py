"""Byte-pair encoding by forced boundaries, and decoding.

A merge joins two symbols into a vocabulary token, so two neighbouring bytes
that stand together in no token can never end up in one token. Every such pair
is a certain cut; the fragments between cuts are encoded on their own, cached
per task, and their ids put together in order. White space and the word
pattern's borders are cuts of the same kind, as no token spans them.

Defined cases: a null or empty text has no tokens, the digest of no bytes and
an empty decoded text; special tokens written out in a text are encoded as the
special ids, as the library does by default; repeated rows are encoded one by
one; very long words are merged with a heap, in n log n steps; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from fleetlint.llm.common import annotate

#: Cached entries per task: white-space free pieces, and fragments.
CACHE = 300_000
_CACHED_LENGTH = 48
_HEAP_FROM = 40

# Texts that may hold characters Python does not know; those below U+0800 are few and listed.
_HIGH = re.compile("[\u0800-\U0010ffff%s]" % "".join(
    c for c in map(chr, range(0x80, 0x800)) if unicodedata.category(c) == "Cn"))
_UNICODE_SPACE_ONLY_IN_PYTHON = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else the next free one from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordEncoder:
    """Encoder of a vocabulary with word-end tokens, read from a ``tokenizers`` file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        splits = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(splits)
        self.letters = byte_letters()
        inside = set()
        for token in self.vocab:
            bare = token[: -len(self.end)] if self.end and token.endswith(self.end) else token
            for form in {token, bare}:
                inside.update(zip(form, form[1:]))
        self.inside = inside
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.fragments: dict[tuple[str, bool], tuple[str, ...]] = {}
        self.letter: dict[str, bool] = {}

    # -- letters younger than Python's tables -----------------------------

    @cached_property
    def library(self) -> Tokenizer:
        """Asked only how it sees characters that Python does not know yet."""
        return Tokenizer.from_file(self.path)

    @staticmethod
    def unknown(text: str) -> bool:
        return _HIGH.search(text) is not None and any(
            c > "\x7f" and unicodedata.category(c) == "Cn" for c in text)

    def is_letter(self, char: str) -> bool:
        """Whether the library's word pattern takes an unknown character for a letter or number."""
        got = self.letter.get(char)
        if got is None:
            alone, joined = (self.library.encode(t, add_special_tokens=False).ids[0] for t in (":", ":" + char))
            got = self.letter[char] = alone == joined
        return got

    def words_of(self, text: str) -> list[str]:
        if text.isascii() or not self.unknown(text):
            return self.words.findall(text)
        # A symbol stands in for every unknown character that is no letter.
        shadow = "".join("$" if c > "\x7f" and unicodedata.category(c) == "Cn" and not self.is_letter(c) else c for c in text)
        return [text[m.start(): m.end()] for m in self.words.finditer(shadow)]

    # -- one word ---------------------------------------------------------

    def cut(self, letters: str) -> list[str]:
        """Fragments between byte pairs that no vocabulary token contains."""
        inside, start, found = self.inside, 0, []
        for k, pair in enumerate(zip(letters, letters[1:]), 1):
            if pair not in inside:
                found.append(letters[start:k])
                start = k
        found.append(letters[start:])
        return found

    def fragment(self, letters: str, last: bool) -> tuple[str, ...]:
        key = (letters, last)
        got = self.fragments.get(key)
        if got is None:
            symbols = list(letters)
            if last:
                symbols[-1] += self.end
            got = tuple(self._merge(symbols) if len(symbols) < _HEAP_FROM else self._merge_long(symbols))
            if len(letters) <= _CACHED_LENGTH and len(self.fragments) < CACHE:
                self.fragments[key] = got
        return got

    def _merge(self, symbols: list[str]) -> list[str]:
        """Join the pair of lowest rank, leftmost first, until none is left."""
        rank = self.rank.get
        ranks = [rank(pair) for pair in zip(symbols, symbols[1:])]
        while True:
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                return symbols
            k = ranks.index(best)
            symbols[k: k + 2] = [symbols[k] + symbols[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((symbols[k - 1], symbols[k]))
            if k < len(ranks):
                ranks[k] = rank((symbols[k], symbols[k + 1]))

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same result with a heap over a linked list."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, pair) for k, pair in enumerate(zip(symbols, symbols[1:])) if (r := self.rank.get(pair)) is not None]
        heapq.heapify(heap)
        text: list[str | None] = list(symbols)
        while heap:
            _, k, pair = heapq.heappop(heap)
            right = after[k]
            if text[k] != pair[0] or right >= n or text[right] != pair[1]:
                continue
            text[k], text[right] = pair[0] + pair[1], None
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n:
                    new = (text[left], text[after[left]])
                    if (r := self.rank.get(new)) is not None:
                        heapq.heappush(heap, (r, left, new))
        return [t for t in text if t is not None]

    # -- whole texts ------------------------------------------------------

    def piece(self, text: str) -> tuple[bytes, bytes]:
        """Ids (32 bits each, little-endian) and decoded text of a normalised piece."""
        got = self.pieces.get(text)
        if got is not None:
            return got
        tokens: list[str] = []
        for word in self.words_of(text):
            parts = self.cut("".join(map(self.letters.__getitem__, word.encode())))
            for part in parts[:-1]:
                tokens.extend(self.fragment(part, False))
            tokens.extend(self.fragment(parts[-1], True))
        ids = struct.pack(f"<{len(tokens)}I", *map(self.vocab.__getitem__, tokens))
        got = (ids, " ".join(tokens).encode())
        if len(text) <= _CACHED_LENGTH and len(self.pieces) < CACHE:
            self.pieces[text] = got
        return got

    def encode(self, raw: bytes) -> tuple[bytes, bytes]:
        """Ids and decoded text of a whole text."""
        text = raw.decode("utf-8", "replace")
        found = []
        for part in self.specials.split(text) if self.special and "<|" in text else [text]:
            if part in self.special:
                found.append((struct.pack("<I", self.special[part]), part.encode()))
                continue
            if part.isascii():
                part = part.lower()
            elif self.unknown(part):
                part = self.library.normalizer.normalize_str(part)
            else:
                # The library lowers letter by letter, without the final sigma.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            pieces = regex.split(r"[\s--[\x1c-\x1f]]+", part, flags=regex.V1) if (
                _UNICODE_SPACE_ONLY_IN_PYTHON.search(part)) else part.split()
            found.extend(map(self.piece, pieces))
        return b"".join([f[0] for f in found]), b" ".join([f[1] for f in found if f[0]])

    def decode(self, ids: bytes) -> str:
        """Token texts joined by one space: the file names no decoder."""
        return " ".join(self.tokens[i] for (i,) in struct.iter_unpack("<I", ids))


def encoded(docs: DataFrame, path: str, carry: list[str], text_col: str = "text") -> DataFrame:
    """``row``, ``ids`` (binary, 32 bits each, little-endian) and ``decoded`` of every whole text."""

    def make():
        encoder = WordEncoder(path)

        def run(raws):
            got = [encoder.encode(raw) for raw in raws]
            return [pa.array([g[0] for g in got], pa.binary()), pa.array([g[1].decode() for g in got], pa.string())]

        return run

    fields = [T.StructField("ids", T.BinaryType(), False), T.StructField("decoded", T.StringType(), False)]
    return annotate(docs, carry, text_col, make, fields)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns: number of tokens, digests of the ids and of the decoded text."""

    def make():
        encoder = WordEncoder(path)

        def run(raws):
            got = [encoder.encode(raw) for raw in raws]
            return [
                pa.array([len(ids) // 4 for ids, _ in got], pa.int64()),
                pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in got], pa.string()),
                pa.array([hashlib.sha256(text).hexdigest() for _, text in got], pa.string()),
            ]

        return run

    fields = [
        T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False),
        T.StructField("decoded_sha256", T.StringType(), False),
    ]
    return annotate(docs, ["doc_id"], "text", make, fields).select("row.doc_id", *[f.name for f in fields])
