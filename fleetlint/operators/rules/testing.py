"""Test suite rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.operators.rules.hits import hit, is_test_path, none, only_if


def no_tests() -> Column:
    return only_if(
        (F.col("test_files") == 0) & (F.col("python_files") > 0),
        hit("TEST-NOTESTS", "CRITICAL", "No Automated Test Suite Detected", path=F.col("first_source")),
    )


def low_ratio() -> Column:
    """Integer comparison of the ratio; only for repositories that have tests."""
    test, source = F.col("test_loc"), F.col("source_loc")
    share = tx.percent_text(test, source)
    return only_if(
        (F.col("test_files") > 0) & (source > 100) & (test * 100 < source * 15),
        hit(
            "TEST-LOWRATIO", F.when(test * 100 < source * 5, "HIGH").otherwise("MEDIUM"),
            F.concat(F.lit("Low Test-to-Code Ratio ("), share, F.lit(")")),
            path=F.col("first_test"), line=None,
            detail=F.concat(test.cast("string"), F.lit(" of "), source.cast("string")),
            num=test, den=source,
        ),
    )


def no_assert() -> Column:
    empty = F.filter("defs", lambda d: (
        (d.kind == "function") & d["name"].startswith("test_") & (d.asserts_or_calls == 0)))
    return F.when(is_test_path(F.col("path")), F.transform(empty, lambda d: hit(
        "TEST-NOASSERT", "MEDIUM",
        F.concat(F.lit("Test Without Assertions in '"), d["name"], F.lit("()'")),
        line=d.line, detail=d["name"], disc=d["name"],
    ))).otherwise(none())

