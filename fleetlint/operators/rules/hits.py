"""Building blocks shared by the rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.functions.arrays import built_once
from fleetlint.model import HIT_TYPE, HITS_TYPE


@built_once
def _constant(name: str, value) -> Column:
    return F.lit(value).alias(name)


def _field(name: str, value) -> Column:
    return value.alias(name) if isinstance(value, Column) else _constant(name, value)


def hit(rule_id, severity, title, path=None, line=1, end=None, snippet=None,
        detail=None, disc="", metadata=None, num=None, den=None) -> Column:
    """One finding; texts that depend on the rule alone are joined later. The
    cast of the whole struct gives every field its type."""
    pairs = None if metadata is None else F.create_map(
        *[x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))])
    return F.struct(
        _field("rule_id", rule_id),
        _field("severity", severity),
        _field("title", title),
        _field("path", F.col("path") if path is None else path),
        _field("line_no", line),
        _field("end_line_no", end),
        _field("code_snippet", snippet),
        _field("detail", detail),
        _field("disc", disc),
        _field("metadata", pairs),
        _field("metric_num", num),
        _field("metric_den", den),
    ).cast(HIT_TYPE)


@built_once
def none() -> Column:
    return F.array().cast(HITS_TYPE)


def only_if(condition: Column, one: Column) -> Column:
    """A single hit under a condition."""
    return F.when(condition, F.array(one)).otherwise(none())


def line_text(line: Column) -> Column:
    """The stripped source line, empty beyond the end."""
    return F.coalesce(tx.strip(F.get("lines", line - 1)), F.lit(""))


def line_block(start: Column, end: Column) -> Column:
    """Lines from start to end, clamped to the file; empty if start is outside."""
    size = F.size("lines")
    last = F.least(end, size)
    return F.when(
        (start >= 1) & (start <= size), F.array_join(F.slice("lines", start, last - start + 1), "\n")
    ).otherwise("")


def any_word(text: Column, words: list[str]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        out = out | F.contains(text, F.lit(word))
    return out


def imports_mention(words: list[str]) -> Column:
    """Does any import statement's text contain one of the words?"""
    return F.exists("imports", lambda i: any_word(i.src, words))


def outside_tests() -> Column:
    return ~F.col("path").startswith("tests/")


def is_test_path(path: Column) -> Column:
    return F.contains(F.lower(path), F.lit("test"))
