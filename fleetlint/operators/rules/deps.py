"""Dependency rules (reported under Reproducibility)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.model import (
    DEPRECATED_PACKAGES, RECOMMENDED_PINS, REQUIREMENT_PATTERN, literal_map,
)
from fleetlint.operators.rules.hits import hit, none, only_if


def requirements() -> Column:
    """Parsed requirement lines: number, stripped text, package, constraint."""
    parsed = F.transform("lines", lambda text, pos: F.struct(
        (pos + 1).alias("line"), tx.strip(text).alias("text"),
    ))
    kept = F.filter(parsed, lambda r: r.text.rlike(REQUIREMENT_PATTERN) & ~r.text.startswith("-"))
    return F.transform(kept, lambda r: F.struct(
        r.line.alias("line"), r.text.alias("text"),
        F.lower(F.regexp_extract(r.text, REQUIREMENT_PATTERN, 1)).alias("pkg"),
        tx.strip(F.regexp_extract(r.text, REQUIREMENT_PATTERN, 2)).alias("bound"),
    ))


def _is_requirements() -> Column:
    return F.col("path") == "requirements.txt"


def deprecated() -> Column:
    names = list(DEPRECATED_PACKAGES)
    substitute = literal_map(DEPRECATED_PACKAGES)
    found = F.filter(requirements(), lambda r: r.pkg.isin(*names))
    return F.when(_is_requirements(), F.transform(found, lambda r: hit(
        "DEP-DEPR", "HIGH",
        F.concat(F.lit("Deprecated/Insecure Dependency '"), r.pkg, F.lit("'")),
        line=r.line, snippet=r.text, detail=F.element_at(substitute, r.pkg), disc=r.pkg,
        metadata={"pkg_name": r.pkg, "replacement": F.element_at(substitute, r.pkg)},
    ))).otherwise(none())


def unpinned() -> Column:
    """No constraint, or a lower bound without an upper one or a pin."""
    names = list(DEPRECATED_PACKAGES)
    pins = literal_map(RECOMMENDED_PINS)
    loose = F.filter(requirements(), lambda r: ~r.pkg.isin(*names) & (
        (r.bound == "")
        | (F.contains(r.bound, F.lit(">=")) & ~F.contains(r.bound, F.lit("<"))
           & ~F.contains(r.bound, F.lit("==")))
    ))

    def pin(pkg):
        return F.coalesce(F.try_element_at(pins, pkg), F.concat(pkg, F.lit("==latest-stable")))

    return F.when(_is_requirements(), F.transform(loose, lambda r: hit(
        "DEP-UNPIN", "MEDIUM", F.concat(F.lit("Unpinned Dependency '"), r.text, F.lit("'")),
        line=r.line, snippet=r.text, detail=pin(r.pkg), disc=r.pkg,
        metadata={"pkg_name": r.pkg, "current_constraint": r.bound, "pinned": pin(r.pkg)},
    ))).otherwise(none())


def no_manifest() -> Column:
    return only_if(
        ~F.col("has_manifest") & (F.col("python_files") > 0),
        hit("DEP-NOMANIFEST", "HIGH", "Missing Dependency Manifest (requirements.txt / pyproject.toml)",
            path="requirements.txt", line=None),
    )
