"""Repair of conversation structure by a suffix-shared automaton.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Rows
are kept, reroled, deleted or inserted at fixed costs, and the cheapest edits
are wanted, the ASCII-least of equally cheap ones.

What can be done with a row depends on one symbol only: its role's initial and
its fault. The symbols of a conversation, in order, are its signature, and
equal signatures are solved once. A signature's cheapest edits are decided from
its end: a node of the automaton stands for a suffix, and a suffix that many
signatures share is one node. Distinct signatures are range-partitioned and
sorted by their reversed text, so neighbours share their longest suffixes and a
task builds each of its nodes once; of every node it keeps the cost-to-go and
the best edits in each state of the grammar. Suffixes whose costs differ by a
constant act alike, so the edits of a node are looked up by that profile and
symbol, and best audits are strings that short suffixes share.

Equal rows are found by digest, with counts combined before the shuffle. The
signature of a conversation is gathered in a pass over narrow rows in order;
then the texts stream past their audit, once, in constant memory. Signature,
audit and digest are single values of one conversation, so that conversation's
rows pass one task in the end, however many there are; nothing else does.

Defined cases: null roles and texts are one space, a null id or turn is one
space in the key that decides the damage; rows without id are one conversation;
rows of one turn are in the order of role and text digest; an empty role has no
initial; a conversation without rows after the damage has zeros and the digest
of the empty text; an empty table gives an empty result; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlint.llm.common import column
from fleetlint.session import materialise, tune

#: Costs of the edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Nodes up to this depth keep their best audits as text.
SHARED = 64

START, SYSTEM, USER, ASSISTANT = range(4)
#: Grammar: state -> initial -> next state, and the role that an insertion or a new role puts there.
_NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_ROLE = ("user", "user", "assistant", "user")
_LEGAL = {"su", "ua", "au"}
_DEAD = "d"

_SPACE = r"[\x20\x09-\x0D]"


# -- damage ---------------------------------------------------------------


def damaged(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows by the damage that a checksum of their key names; dropped ones have 0 copies."""
    named = rows.select(
        column(conv_col).cast("long").alias("conv_id"), column(turn_col).cast("long").alias("turn"),
        F.coalesce(column(role_col), F.lit(" ")).alias("role"), F.coalesce(column(text_col), F.lit(" ")).alias("text"))
    key = F.concat(*[
        part for name, glue in (("conv_id", ":"), ("turn", ""))
        for part in (F.coalesce(F.col(name).cast("string"), F.lit(" ")), F.lit(glue))])
    kind = F.crc32(key.cast("binary")) % 20
    return named.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def with_order(rows: DataFrame) -> DataFrame:
    """Adds the digest of the text, the last key of the order of rows."""
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))


ORDER = ["turn", "role", "digest"]


# -- signatures -----------------------------------------------------------

_SIGNED = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("signature", T.StringType(), False),
    *[T.StructField(name, T.LongType(), False) for name in ("gaps", "blank", "duplicate", "truncated", "illegal")],
])


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows of ordered batches as dicts, each with whether it begins a conversation."""
    last = batches  # a value that no id equals
    for batch in batches:
        for row in batch.to_pylist():
            yield row["conv_id"] != last, row
            last = row["conv_id"]


class Signature:
    """The symbols and measures of one conversation, row by row in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.symbols = conv_id, []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.low = self.high = self.before = self.initial = None

    def add(self, row: dict) -> None:
        initial = row["role"][:1]
        if self.before is not None and self.initial + initial not in _LEGAL:
            self.illegal += 1
        same = (row["turn"], row["role"], row["digest"])
        fault = (
            "blank" if row["blank"] else "duplicate" if row["later"] or same == self.before
            else "truncated" if row["open"] else None)
        if row["turn"] is not None:
            self.turns += row["turn"] != self.high
            self.low = row["turn"] if self.low is None else self.low
            self.high = row["turn"]
        self.before, self.initial = same, initial
        symbol = initial if initial and initial in "sua" else "x"
        if fault:
            self.faults[fault] += 1
            symbol = symbol.upper() if fault == "truncated" else _DEAD
        self.symbols.append(symbol)

    def row(self) -> list:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [self.conv_id, "".join(self.symbols), gaps, *self.faults.values(), self.illegal]


def _batch(rows: list[list], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string()}
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kinds[f.dataType]) for values, f in zip(zip(*rows), schema.fields)], names=schema.names)


def _in_batches(rows: Iterator[list], schema: T.StructType, size: int = 1_000) -> Iterator[pa.RecordBatch]:
    waiting = []
    for row in rows:
        waiting.append(row)
        if len(waiting) >= size:
            yield _batch(waiting, schema)
            waiting = []
    if waiting:
        yield _batch(waiting, schema)


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``damaged`` rows: signature and measures."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    narrow = materialise(with_order(rows).select(
        "conv_id", *ORDER, "copies", blank.alias("blank"),
        (~blank & ~F.col("text").rlike(rf"[.!?]{_SPACE}*\z")).alias("open")), "conversation_rows")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # Only what comes back in another turn; counted before the shuffle, so a very common row is no hot key.
    again = narrow.where("copies > 0").groupBy("conv_id", "role", "digest").agg(
        F.min(at).alias("first"), F.max(at).alias("last")).where("first < last").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    marked = narrow.join(
        again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")),
        "left",
    ).select("conv_id", *ORDER, "copies", "blank", "open", F.coalesce(at > F.col("first"), F.lit(False)).alias("later"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list]:
            current = None
            for begins, row in _by_conversation(batches):
                if begins:
                    if current:
                        yield current.row()
                    current = Signature(row["conv_id"])
                for _ in range(row["copies"]):
                    current.add(row)
            if current:
                yield current.row()

        yield from _in_batches(rows(), _SIGNED)

    return marked.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).mapInArrow(run, _SIGNED)


# -- the automaton --------------------------------------------------------

#: Best edits before and at one row, by state: letters and the state behind.
Edits = tuple[tuple[str, int], ...]


def _end() -> tuple[tuple[int, ...], Edits]:
    """Costs and edits of the empty suffix: a reply or a whole exchange may be missing."""
    return (0, 2 * INSERT, INSERT, 0), (("", START), ("II", ASSISTANT), ("I", ASSISTANT), ("", ASSISTANT))


def _row(symbol: str, costs: tuple[int, ...]) -> tuple[tuple[int, ...], Edits]:
    """Costs and edits with one more row in front of a suffix of known costs."""
    extra = TRUNCATED if symbol.isupper() else 0
    options = []
    for state in range(4):
        ways = {"D": (DELETE + costs[state], state)}
        if symbol != _DEAD:
            kept = _NEXT[state].get(symbol.lower())
            if kept is not None:
                ways["K"] = (extra + costs[kept], kept)
            turned = _NEXT[state][_ROLE[state][0]]
            ways["R"] = (REROLE + extra + costs[turned], turned)
        options.append(ways)
    inserted = [_NEXT[state][_ROLE[state][0]] for state in range(4)]
    best = [min(cost for cost, _ in ways.values()) for ways in options]
    for _ in range(2):  # two insertions lead from any state to any other that is worth it
        best = [min(best[g], INSERT + best[inserted[g]]) for g in range(4)]

    def edits(state: int) -> tuple[str, int]:
        ways = {letter: behind for letter, (cost, behind) in options[state].items() if cost == best[state]}
        if INSERT + best[inserted[state]] == best[state] and "D" not in ways:
            letters, behind = edits(inserted[state])
            return "I" + letters, behind
        letter = min(ways)
        return letter, ways[letter]

    return tuple(best), tuple(edits(g) for g in range(4))


class Automaton:
    """Nodes of the suffixes of the signature at hand; signatures must come sorted by their reversed text."""

    def __init__(self):
        costs, edits = _end()
        self.text = ""
        # Per depth: profile of the costs, their least, edits by state, best audits by state (to a bounded depth).
        self.profile, self.least, self.edits = [costs], [0], [edits]
        self.audits: list[tuple[str, ...]] = [tuple(letters for letters, _ in edits)]
        self.known: dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], int, Edits]] = {}
        self.built = 0

    def _push(self, symbol: str) -> None:
        key = (self.profile[-1], symbol)
        got = self.known.get(key)
        if got is None:
            costs, edits = _row(symbol, self.profile[-1])
            least = min(costs)
            got = self.known[key] = (tuple(c - least for c in costs), least, edits)
        profile, least, edits = got
        self.profile.append(profile)
        self.least.append(self.least[-1] + least)
        self.edits.append(edits)
        if len(self.edits) <= SHARED + 1:
            below = self.audits[-1]
            self.audits.append(tuple(letters + below[behind] for letters, behind in edits))
        self.built += 1

    def solve(self, reversed_signature: str) -> tuple[int, str]:
        """Cost and audit of a signature, given reversed."""
        shared = _common(self.text, reversed_signature)
        for part in (self.profile, self.least, self.edits, self.audits):
            del part[shared + 1:]
        for symbol in reversed_signature[shared:]:
            self._push(symbol)
        self.text = reversed_signature
        found, state = [], START
        for depth in range(len(reversed_signature), len(self.audits) - 1, -1):
            letters, state = self.edits[depth][state]
            found.append(letters)
        depth = min(len(reversed_signature), len(self.audits) - 1)
        return self.least[-1] + self.profile[-1][START], "".join(found) + self.audits[depth][state]


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


_SOLVED = T.StructType([
    T.StructField("signature", T.StringType(), False), T.StructField("cost", T.LongType(), False),
    T.StructField("audit", T.StringType(), False)])


def solved(signed: DataFrame) -> DataFrame:
    """Cost and audit of every distinct signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()

        def rows() -> Iterator[list]:
            for batch in batches:
                for backwards in batch.column(0).to_pylist():
                    yield [backwards[::-1], *automaton.solve(backwards)]

        yield from _in_batches(rows(), _SOLVED)

    backwards = signed.select(F.reverse("signature").alias("backwards")).distinct()
    return backwards.repartitionByRange("backwards").sortWithinPartitions("backwards").mapInArrow(run, _SOLVED)


# -- texts past their audit -----------------------------------------------


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """``(edit, role, text)`` of every row that stays or is inserted."""
    state, letters = START, iter(audit)
    rows = iter(rows)
    for letter in letters:
        if letter == "I":
            role, text = _ROLE[state], ""
        else:
            role, text = next(rows)
            if letter == "D":
                continue
            if letter == "R":
                role = _ROLE[state]
        state = _NEXT[state][role[0]]
        yield letter, role, text


_MEASURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_DIGESTED = T.StructType([
    T.StructField("conv_id", T.LongType()), *[T.StructField(m, T.LongType(), False) for m in _MEASURES],
    T.StructField("audit", T.StringType(), False), T.StructField("repaired_sha256", T.StringType(), False)])
_REPAIRED = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("place", T.LongType(), False),
    T.StructField("edit", T.StringType(), False), T.StructField("role", T.StringType(), False),
    T.StructField("text", T.StringType(), False)])


def judged(rows: DataFrame) -> DataFrame:
    """Measures, cost and audit per conversation of ``damaged`` rows, without texts."""
    signed = materialise(signatures(rows), "signatures")
    return signed.join(solved(signed), "signature").select("conv_id", *_MEASURES, "audit")


def _streamed(rows: DataFrame, finish: Callable, schema: T.StructType) -> DataFrame:
    """``finish(verdict, edited rows)`` for every conversation, its texts read once and in order."""
    verdicts = judged(rows)
    blank = {"turn": "bigint", "role": "string", "text": "string", "digest": "binary"}
    texts = with_order(rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))))
    both = verdicts.select("conv_id", F.lit(0).alias("part"), *_MEASURES, "audit", *[
        F.lit(None).cast(kind).alias(name) for name, kind in blank.items()
    ]).unionByName(texts.select("conv_id", F.lit(1).alias("part"), *blank), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _by_conversation(batches)

        def rows() -> Iterator[list]:
            begins, verdict = next(source, (False, None))
            while verdict:
                waiting: list = []

                def own() -> Iterator[tuple[str, str]]:
                    for begins, row in source:
                        if begins:
                            waiting.append(row)
                            return
                        yield row["role"], row["text"]

                texts = own()
                yield from finish(verdict, edited(verdict["audit"], texts))
                for _ in texts:  # none is left, but the next conversation is fetched
                    pass
                verdict = waiting[0] if waiting else None

        yield from _in_batches(rows(), schema)

    return both.repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER).mapInArrow(run, schema)


def _digested(verdict: dict, rows: Iterator[tuple[str, str, str]]) -> Iterator[list]:
    digest, glue = hashlib.sha256(), ""
    for _, role, text in rows:
        digest.update(f"{glue}{role}:{text}".encode())
        glue = "\n"
    yield [verdict["conv_id"], *[verdict[m] for m in _MEASURES], verdict["audit"], digest.hexdigest()]


def _listed(verdict: dict, rows: Iterator[tuple[str, str, str]]) -> Iterator[list]:
    for place, (edit, role, text) in enumerate(rows):
        yield [verdict["conv_id"], place, edit, role, text]


def repaired(rows: DataFrame) -> DataFrame:
    """The rows of every repaired conversation: ``conv_id, place, edit, role, text``; ``rows`` are as of ``damaged``."""
    tune(rows.sparkSession)
    return _streamed(rows, _listed, _REPAIRED)


def digests(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """The contract's columns for conversations after their damage."""
    tune(rows.sparkSession)
    return _streamed(damaged(rows, conv_col, turn_col, role_col, text_col), _digested, _DIGESTED)


def undamaged(rows: DataFrame) -> DataFrame:
    """Conversations as they are, in the form that ``repaired`` takes."""
    none: Column = F.lit(1)
    return rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), none.alias("copies"))
