"""Piece encoding and decoding with a table of distinct marked words.

The vocabulary writes a white-space marker for every space and one before the
text. Where no piece holds a marker behind another character, no merge can
cross the marker that ends a run of other characters, so the text falls apart
into marked words: a run of markers and what follows up to the next run. A
task keeps a table of the distinct marked words that it has met: each batch
asks the library only for those that are new, all at once, and every text is
put together from the table by position. The table starts anew when it is
full, which costs time and changes nothing; words over a bounded length are
segmented as they come and not kept. Nothing is shuffled.

A vocabulary with pieces across markers, or whose normaliser sees more than
one marked word at a time, is not cut: then a whole text is one word.

Defined cases: a null or empty text has no ids, the digest of no bytes and an
empty decoded text; the names of control pieces written out in a text are
ordinary text, as in the library; repeated rows are encoded one by one; very
long texts and words are taken whole; an empty table gives an empty result;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetlint.llm.common import annotate

MARK = "▁"
#: Distinct marked words a task keeps, and the longest of them in characters.
WORDS = 300_000
_KEPT_LENGTH = 64
_WORD_START = re.compile("(?<=[^ ]) ")
_PROBE = "a  b \u3000\ufb01\u00a0c\u200b \u00ad\u00bd\nA\u030a \u00c5\u2581x  y "


class PieceCodec:
    """Encoder and decoder of a ``sentencepiece`` model file."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.decimal = [str(i) for i in range(len(self.pieces))]
        #: Text of every piece; single bytes beyond ASCII have none of their own.
        self.texts = [self._text(i, p) for i, p in enumerate(self.pieces)]
        #: Comma-separated ids by marked word (without its first marker).
        self.table: dict[str, str] = {}
        #: Decoded text of the words that do not decode to themselves.
        self.changed: dict[str, str] = {}
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        if self.cuts:
            # A marker with nothing behind it only ends texts; alone the library cannot be asked for it.
            self.last_mark = self.joined(self.ids("a ")[len(self.ids("a")):])
            self.table[""] = self.last_mark
            self.cuts = self.encode([_PROBE])[0][0] == self.joined(self.ids(_PROBE))

    def _text(self, i: int, piece: str) -> str:
        if self.library.is_byte(i):
            value = int(piece[1:-1], 16)
            return chr(value) if value < 0x80 else MARK
        return MARK if self.library.is_control(i) or self.library.is_unknown(i) else piece.replace(MARK, " ")

    def ids(self, text):
        return self.library.encode(text, num_threads=1)

    def joined(self, ids: list[int]) -> str:
        decimal = self.decimal
        return ",".join([decimal[i] for i in ids])

    def words(self, text: str) -> list[str]:
        """Marked words without their first marker; a text begins with one that is not written out."""
        if not self.cuts:
            return [text]
        return _WORD_START.split(text) if "  " in text or text.startswith(" ") else text.split(" ")

    def learn(self, words: list[str]) -> None:
        """Segment words that the table lacks, in one call of the library."""
        texts, unsure = self.texts, []
        for word, ids in zip(words, self.ids(words)):
            self.table[word] = self.joined(ids)
            if "".join([texts[i] for i in ids]) != " " + word:
                unsure.append((word, ids))
        if unsure:
            decoded = self.library.decode([ids for _, ids in unsure], num_threads=1)
            self.changed.update((w, text) for (w, _), text in zip(unsure, decoded) if text != w)

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """Comma-separated ids and the decoded text of every whole text of a batch."""
        # A written marker is a space to the library as well.
        texts = [t.replace(MARK, " ") for t in texts]
        split = [self.words(t) if t else [] for t in texts]
        new = [*set().union(*split).difference(self.table)]
        if new:
            self.learn(new)
        table, changed, result = self.table, self.changed, []
        for text, words in zip(texts, split):
            if changed and not changed.keys().isdisjoint(words):
                text = " ".join([changed.get(w, w) for w in words])
            result.append((",".join([table[w] for w in words]), text))
        if len(table) > WORDS:
            self.table, self.changed = ({"": self.last_mark} if self.cuts else {}), {}
        else:
            for word in new:
                if len(word) > _KEPT_LENGTH:
                    del table[word]
                    changed.pop(word, None)
        return result

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def n_ids(joined: str) -> int:
    return joined.count(",") + 1 if joined else 0


def _texts(raws: list[bytes]) -> list[str]:
    return [raw.decode("utf-8", "replace") for raw in raws]


def encoded(docs: DataFrame, path: str, carry: list[str], text_col: str = "text") -> DataFrame:
    """``row``, ``ids`` (array of int) and ``decoded`` of every whole text."""

    def make():
        codec = PieceCodec(path)

        def run(raws):
            got = codec.encode(_texts(raws))
            return [
                pa.array([list(map(int, ids.split(","))) if ids else [] for ids, _ in got], pa.list_(pa.int32())),
                pa.array([text for _, text in got], pa.string()),
            ]

        return run

    fields = [
        T.StructField("ids", T.ArrayType(T.IntegerType(), True), False), T.StructField("decoded", T.StringType(), False)]
    return annotate(docs, carry, text_col, make, fields)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns: number of ids, digests of the ids and of the decoded text."""

    def make():
        codec = PieceCodec(path)

        def run(raws):
            got = codec.encode(_texts(raws))
            return [
                pa.array([n_ids(ids) for ids, _ in got], pa.int64()),
                pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in got], pa.string()),
                pa.array([hashlib.sha256(text.encode()).hexdigest() for _, text in got], pa.string()),
            ]

        return run

    fields = [
        T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False),
        T.StructField("decoded_sha256", T.StringType(), False),
    ]
    return annotate(docs, ["doc_id"], "text", make, fields).select("row.doc_id", *[f.name for f in fields])
