"""Code quality rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlint.operators.rules.hits import hit, line_block, only_if


def swallowed_exception() -> Column:
    silent = F.filter(
        "handlers", lambda h: (h.body_len == 1) & h.first_stmt.isin("pass", "continue")
    )
    return F.transform(silent, lambda h: hit(
        "QUAL-EXC", "HIGH", "Silent Exception Swallowing (except: pass)",
        line=h.line, snippet=line_block(h.line, h.line + 2),
        metadata={"handler_type": F.lit("swallowed_exception")},
    ))


def mutable_default() -> Column:
    """One hit per mutable default, so a function may yield several."""
    found = F.filter("defs", lambda d: d.mutable_defaults > 0)
    return F.flatten(F.transform(found, lambda d: F.transform(
        F.sequence(F.lit(1), d.mutable_defaults), lambda k: hit(
            "QUAL-MUT", "MEDIUM",
            F.concat(F.lit("Mutable Default Argument in '"), d["name"], F.lit("()'")),
            line=d.line, snippet=line_block(d.line, d.line + 2), detail=d["name"],
            disc=F.concat(d["name"], F.lit("|"), k.cast("string")),
            metadata={"func_name": d["name"]},
        ))))


def complexity() -> Column:
    knotty = F.filter("defs", lambda d: (d.kind != "class") & (d.complexity > 12))
    return F.transform(knotty, lambda d: hit(
        "QUAL-CMPX", F.when(d.complexity > 20, "HIGH").otherwise("MEDIUM"),
        F.concat(F.lit("High Cyclomatic Complexity ("), d.complexity.cast("string"),
                 F.lit(") in '"), d["name"], F.lit("'")),
        line=d.line, snippet=line_block(d.line, F.least(d.line + 10, F.col("loc"))),
        detail=d["name"], disc=d["name"], num=d.complexity,
    ))


def missing_types() -> Column:
    public = F.filter("defs", lambda d: (d.kind != "class") & ~d["name"].startswith("_"))
    n_public = F.size(public)
    n_bare = F.size(F.filter(public, lambda d: ~(d.typed_args | d.typed_return)))
    path = F.col("path")
    share = F.concat(n_bare.cast("string"), F.lit("/"), n_public.cast("string"))
    return only_if(
        ~path.startswith("tests/") & ~path.startswith("test_")
        & (n_public >= 4) & (n_bare * 100 > n_public * 65),
        hit(
            "QUAL-TYPE", "LOW",
            F.concat(F.lit("Missing Type Annotations in '"), path, F.lit("' ("), share, F.lit(" functions)")),
            snippet=F.concat(F.lit("# "), n_bare.cast("string"),
                             F.lit(" untyped public functions in "), path),
            detail=share, num=n_bare, den=n_public,
        ),
    )
