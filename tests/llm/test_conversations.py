"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fleetlint.llm import conversations
from fleetlint.llm.conversations import Automaton, digests, repaired, undamaged
from fleetlint.llm.queries import op12_suffix_dawg

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """Dijkstra over (rows used, last initial) with (cost, audit) as the length; rows are (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, out = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (at, last) in seen:
            continue
        seen.add((at, last))
        for role in ("user", "assistant"):
            if (last, role[0]) in STEP:
                heapq.heappush(heap, (cost + 5, audit + "I", at, role[0], (*out, (role, ""))))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(heap, (cost + 2, audit + "D", at + 1, last, out))
        if fault in ("blank", "duplicate"):
            continue
        extra = 5 if fault == "truncated" else 0
        for letter, new in (("K", role), ("R", "user"), ("R", "assistant")):
            if new and (last, new[0]) in STEP:
                heapq.heappush(heap, (
                    cost + extra + (letter == "R"), audit + letter, at + 1, new[0], (*out, (new, text))))


def by_hand(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            mine += [(turn, role, text)] * (2 if kind == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, judged = set(), []
        for _, role, text in mine:
            bare = text.strip(SPACE)
            fault = (
                "blank" if not bare else "duplicate" if (role, text) in seen
                else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, *_ in mine if t is not None]
        initials = [r[:1] for r, *_ in judged]
        cost, audit, out = cheapest(judged)
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[sum(f == name for *_, f in judged) for name in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
    return found


def result(df):
    rows = [tuple(r) for r in df.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def some_rows(n, seed):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", None, "ux", "Assistant"]
    texts = ["Yes.", "No!", "open", " \t", "", None, "What?  \n", "Étoile", "a.b", "..", "\xa0"]
    return [
        (conv, rng.choice([turn, turn, turn, turn + 2, None, -turn]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"{rng.random()}.")
        for conv in [None, *range(n)] for turn in range(rng.choice([0, 1, 2, 3, 5, 8]))
    ]


def test_signatures_equal_a_search_over_all_edits():
    rng = random.Random(1)
    signatures = sorted({"".join(rng.choice("ssuuuaaaxSUAXd") for _ in range(rng.randrange(8))) for _ in range(1_500)},
                        key=lambda s: s[::-1])
    automaton = Automaton()
    for s in signatures:
        rows = [(c.lower() if c not in "dxX" else "x", "", "blank" if c == "d" else "truncated" if c.isupper() else "") for c in s]
        assert automaton.solve(s[::-1]) == cheapest(rows)[:2], s
    # Suffixes are shared: far fewer nodes than symbols, and one per distinct suffix.
    suffixes = {s[k:] for s in signatures for k in range(len(s))}
    assert automaton.built == len(suffixes) < sum(map(len, signatures))
    assert len(automaton.known) < 400


def test_long_signatures_share_and_walk(monkeypatch):
    monkeypatch.setattr(conversations, "SHARED", 3)
    rng = random.Random(2)
    tails = ["".join(rng.choice("suaxUAd") for _ in range(30)) for _ in range(3)]
    signatures = sorted({"".join(rng.choice("suaxUAd") for _ in range(k)) + t for t in tails for k in (0, 4, 9)},
                        key=lambda s: s[::-1])
    automaton = Automaton()
    for s in signatures:
        rows = [(c.lower(), "", "blank" if c == "d" else "truncated" if c.isupper() else "") for c in s]
        assert automaton.solve(s[::-1]) == cheapest(rows)[:2]
    assert automaton.built == len({s[k:] for s in signatures for k in range(len(s))})


@pytest.mark.parametrize("partitions", [1, 7])
def test_conversations_equal_a_search(spark, partitions):
    rows = some_rows(300, 3)
    clash = spark.createDataFrame(rows, SCHEMA).repartition(partitions).withColumns(
        {c: F.lit("x") for c in ("copies", "digest", "part", "audit", "signature", "later", "first")})
    assert result(digests(clash)) == by_hand(rows)


def test_repeated_rows_and_long_texts(spark):
    rows = [(1, t, r, "x" * 200_000 + str(t) + ".") for t, r in enumerate(["user", "assistant"] * 40)]
    rows += [(2, t, "user", "Same.") for t in range(500)] + [(3, 0, "user", "Hi.")] * 3
    assert result(digests(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)


def test_repaired_rows_and_empty_table(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "open"), (1, 2, "user", "Well?"), (2, 0, "system", "Be.")]
    out = repaired(undamaged(spark.createDataFrame(rows, SCHEMA))).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in out] == [
        (1, "R", "user", "Hello."), (1, "R", "assistant", "Well?")]
    assert digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert result(op12_suffix_dawg(spark, folder)) == by_hand(rows)
