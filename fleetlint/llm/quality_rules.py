"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one long whose bit ``i`` says that rule ``i`` failed; versioned policies
are masks over these bits, so a new policy, a comparison of two policies or an
ablation reads the ledger alone and never the texts again.

Defined cases: a null or empty text has no words, fails ``few_words`` and has
zero for every measure; repeated rows are judged one by one; an empty table
gives an empty ledger; columns beyond the named ones are carried untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlint.llm.common import annotate

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouted"]
FIELDS = [T.StructField(name, T.LongType(), False) for name in MEASURES]
WINDOW = 5

# Byte classes: 1 continuation of a code point, 2 white space, 3 symbol, 0 the rest.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x80:0xC0] = 1
_CLASS[[0x20, *range(0x09, 0x0E)]] = 2
_CLASS[list(b"#*$%&|<>")] = 3


@dataclass(frozen=True)
class Rule:
    """A rule's bit and the SQL condition, over the measures, under which it fails."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule(5, "shouting", "2 * n_shouted > n_words"),
)

#: Versions of the policy: the rules that reject a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "shouting"),
}


def repeated_words(ids: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """How many words lie in a window of words that is found twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    keys, base, width = ids, max(distinct, 1), 1
    while width < window:
        if base * max(distinct, 1) >= 2**62:  # renumber, so that the combined key stays exact
            keys = np.unique(keys, return_inverse=True)[1]
            base = int(keys.max()) + 1
        keys = keys[:-1] * np.int64(max(distinct, 1)) + ids[width:]
        base, width = base * max(distinct, 1), width + 1
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    found = np.zeros(n, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    steps = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(found)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def measure(raw: bytes) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES``."""
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=4)
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return (
        len(words), len(raw) - int(kinds[1]) - int(kinds[2]), int(kinds[3]), len(lines),
        len(lines) - len(set(lines)), repeated_words(ids, len(number)), sum(map(bytes.isupper, words)),
    )


def _pass():
    def run(raws: list[bytes]) -> list[pa.Array]:
        found = np.array([measure(raw) for raw in raws], np.int64).reshape(-1, len(MEASURES))
        return [pa.array(found[:, i]) for i in range(len(MEASURES))]

    return run


def failures(rules: tuple[Rule, ...] = RULES) -> Column:
    """The ledger's bitmask, from the measures."""
    mask = F.lit(0).cast("long")
    for rule in rules:
        mask = mask.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return mask


def policy_mask(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {rule.name: 1 << rule.bit for rule in rules}
    return sum(bits[name] for name in names)


def passes(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a ledger row satisfies a policy."""
    return F.col("failures").bitwiseAND(F.lit(policy_mask(policy, rules))) == 0


def ledger(docs: DataFrame, carry: list[str], text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row`` (the carried columns), all measures and ``failures`` of every document."""
    return annotate(docs, carry, text_col, _pass, FIELDS).withColumn("failures", failures(rules))


def ablations(entries: DataFrame, policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents it fails, those it alone rejects, and those kept without it.

    The ledger is first folded into one count per bitmask, at most two to the
    number of rules, so one shuffle of few rows answers every ablation.
    """
    mask = policy_mask(policy, rules)
    folded = entries.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    chosen = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if mask >> r.bit & 1
    ])
    spread = folded.select("bits", "n", F.inline(chosen))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return spread.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def judged(docs: DataFrame, policy: str | tuple[str, ...] = "v2") -> DataFrame:
    """The contract's columns for every document."""
    found = ledger(docs, ["doc_id"])
    return found.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), (passes("base") & passes(policy)).alias("kept"), "failures",
    )


def keep_good(docs: DataFrame, policy: str | tuple[str, ...] = "v2", text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with all their columns."""
    return ledger(docs, docs.columns, text_col).where(passes(policy)).select("row.*")
