"""Text helpers as column expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def universal_newlines(text: Column) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    return F.when(F.instr(text, "\r") > 0, F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def split_lines(text: Column) -> Column:
    """Lines of a text; one trailing newline opens no further line."""
    parts = F.split(universal_newlines(text), "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)


def count_lines(text: Column) -> Column:
    """Number of lines without building them."""
    norm = universal_newlines(text)
    breaks = F.length(norm) - F.length(F.replace(norm, F.lit("\n"), F.lit("")))
    open_line = F.when((norm == "") | norm.endswith("\n"), 0).otherwise(1)
    return (breaks + open_line).cast("int")


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Parent directory, empty for a root-level file."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """Last extension with its dot; a leading dot alone is no extension."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def first_segment(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", 1)


def tenths_text(tenths: Column) -> Column:
    """71 -> ``7.1``; exact, sign included."""
    size = F.abs(tenths)
    sign = F.when(tenths < 0, "-").otherwise("")
    return F.concat(sign, F.floor(size / 10).cast("string"), F.lit("."), (size % 10).cast("string"))


def percent_text(num: Column, den: Column) -> Column:
    """A ratio as a percentage with one decimal, ties rounded up, in integers."""
    permille = F.expr("0") + F.floor((num * 2000 + den) / (den * 2))
    return F.concat(tenths_text(permille.cast("bigint")), F.lit("%"))


def stable_id(prefix: Column, *parts: Column) -> Column:
    """Deterministic identifier: prefix and 16 hex digits of a digest."""
    return F.concat(prefix, F.lit("-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def tidy_join(names: Column) -> Column:
    return F.array_join(F.sort_array(names), ", ")


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def missing_items(text: Column, wanted: list[str]) -> Column:
    """The items of a fixed list that a text does not contain, in list order."""
    return F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: ~F.contains(text, w))
