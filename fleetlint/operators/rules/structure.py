"""Layout rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.operators.rules.hits import hit, only_if


def god_file() -> Column:
    loc, path = F.col("loc"), F.col("path")
    size = loc.cast("string")
    return only_if(
        F.col("is_python") & (loc > 600),
        hit(
            "ARCH-GOD",
            F.when(loc > 1000, "HIGH").otherwise("MEDIUM"),
            F.concat(F.lit("Monolithic 'God File' Detected ("), size, F.lit(" LOC)")),
            end=F.least(loc, F.lit(50)),
            snippet=F.concat(F.lit("# File: "), path, F.lit(" ("), size, F.lit(" lines)")),
            detail=size,
            num=loc,
        ),
    )


def flat_root() -> Column:
    root = F.col("root_python_files")
    return only_if(
        (root > 6) & (root == F.col("python_files")),
        hit("ARCH-001", "MEDIUM", "Flat Unstructured Root Directory",
            path=F.col("first_python"), line=None, num=root),
    )


def missing_init(scanned: DataFrame) -> DataFrame:
    """Package directories without a marker, as one grouped pass.

    A directory's marker is itself a Python file of it, so no join is needed.
    """
    path = F.col("path")
    dirs = (
        scanned.filter("is_python")
        .select("repo_id", tx.dir_name(path).alias("dir"), (tx.base_name(path) == "__init__.py").alias("marker"))
        .filter((F.col("dir") != "") & (F.col("dir") != "tests"))
        .groupBy("repo_id", "dir")
        .agg(F.bool_or("marker").alias("marked"))
        .filter(~F.col("marked"))
    )
    where = F.col("dir")
    return dirs.select(
        "repo_id",
        hit(
            "ARCH-INIT", "LOW",
            F.concat(F.lit("Missing __init__.py in package directory '"), where, F.lit("'")),
            path=F.concat(where, F.lit("/__init__.py")), snippet="", detail=where,
        ).alias("hit"),
    )


def module_stems(scanned: DataFrame) -> DataFrame:
    """One row per (repository, file stem) with the last path of that stem."""
    return (
        scanned.filter("is_python")
        .groupBy("repo_id", tx.stem(F.col("path")).alias("stem"))
        .agg(F.max("path").alias("module_path"))
    )


def import_targets(scanned: DataFrame) -> DataFrame:
    """Distinct (repository, importing stem, first segment of the import)."""
    return (
        scanned.select(
            "repo_id", tx.stem(F.col("path")).alias("src_stem"), F.explode("import_roots").alias("dst_stem")
        )
        .filter("src_stem <> dst_stem")
        .distinct()
    )


def import_edges(scanned: DataFrame, modules: DataFrame, salts: int = 8) -> DataFrame:
    """Imports that resolve to a module of the same repository.

    A common import (``os``) of a huge repository is one key, so the edge side
    is salted and the far smaller, duplicate-free module side repeated.
    """
    targets = import_targets(scanned).withColumn("salt", F.pmod(F.xxhash64("src_stem"), F.lit(salts)))
    known = module_stems(modules).select(
        "repo_id", F.col("stem").alias("dst_stem"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"),
    )
    return targets.join(known, ["repo_id", "dst_stem", "salt"], "left_semi").select(
        "repo_id", "src_stem", "dst_stem"
    )


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs imported in both directions, by grouping, not self-joining."""
    src, dst = F.col("src_stem"), F.col("dst_stem")
    return (
        edges.groupBy("repo_id", F.least(src, dst).alias("stem_a"), F.greatest(src, dst).alias("stem_b"))
        .agg(F.bool_or(src < dst).alias("forth"), F.bool_or(src > dst).alias("back"))
        .filter("forth and back")
        .select("repo_id", "stem_a", "stem_b")
    )


def circular_imports(scanned: DataFrame, modules: DataFrame) -> DataFrame:
    """A mutual pair needs both stems to be importing files, hence modules, so
    the unresolved targets suffice and the resolving join is left out."""
    pairs = mutual_pairs(import_targets(scanned))
    stems = module_stems(modules)
    first = stems.select("repo_id", F.col("stem").alias("stem_a"), F.col("module_path").alias("path_a"))
    second = stems.select("repo_id", F.col("stem").alias("stem_b"), F.col("module_path").alias("path_b"))
    found = pairs.join(first, ["repo_id", "stem_a"]).join(second, ["repo_id", "stem_b"])
    a, b = F.col("stem_a"), F.col("stem_b")
    return found.select(
        "repo_id",
        hit(
            "ARCH-CIRC", "HIGH", F.concat(F.lit("Circular Import Dependency: "), a, F.lit(" <-> "), b),
            path=F.col("path_a"),
            detail=F.concat("path_a", F.lit(", "), "path_b"),
            disc=F.concat(a, F.lit("|"), b),
        ).alias("hit"),
    )
