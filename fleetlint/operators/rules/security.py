"""Security rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.model import (
    EXEC_CALLS, SECRET_EXCUSES, SECRET_HINTS, SECRET_PATTERNS, SHELL_CALLS, SQL_PHRASES, YAML_MODULES,
)
from fleetlint.operators.rules.hits import any_word, hit, is_test_path, line_text, none

ANY_SECRET = "|".join(f"(?:{p})" for p in SECRET_PATTERNS.values())


def may_hold_secret(content: Column) -> Column:
    """Cheap substring test on the whole text; files that fail it are not searched."""
    return any_word(F.lower(content), SECRET_HINTS)


def secrets() -> Column:
    """Line x pattern, without a join: one combined search picks the lines,
    the single patterns are tried on those alone. Needs no parsed file."""
    numbered = F.transform("lines", lambda text, pos: F.struct(
        (pos + 1).alias("line"), text.alias("text")))
    suspects = F.filter(numbered, lambda r: r.text.rlike(ANY_SECRET) & ~(
        is_test_path(F.col("path")) & any_word(F.lower(r.text), SECRET_EXCUSES)))

    def names(text):
        return F.filter(
            F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SECRET_PATTERNS.items()]),
            lambda n: n.isNotNull(),
        )

    return F.when(F.col("is_python") & F.col("suspect"), F.flatten(F.transform(suspects, lambda r: F.transform(
        names(r.text), lambda n: hit(
            "SEC-SECRET", "CRITICAL", F.concat(n, F.lit(" Detected in Source Code")),
            line=r.line,
            snippet=F.concat(F.substring(tx.strip(r.text), 1, 80), F.lit("...")),
            disc=n, metadata={"pattern": n},
        ))))).otherwise(none())


def code_execution() -> Column:
    found = F.filter("calls", lambda c: (c.func_kind == "name") & c.func_name.isin(*EXEC_CALLS))
    return F.transform(found, lambda c: hit(
        "SEC-EXEC", "CRITICAL",
        F.concat(F.lit("Arbitrary Code Execution via '"), c.func_name, F.lit("()'")),
        line=c.line, snippet=line_text(c.line), detail=c.func_name, disc=c.span,
        metadata={"func": c.func_name},
    ))


def unsafe_yaml() -> Column:
    found = F.filter("calls", lambda c: (
        (c.func_kind == "attr") & (c.func_name == "load") & c.recv_name.isin(*YAML_MODULES)
        & ~F.exists(c.kwargs, lambda k: F.coalesce(
            (k["name"] == "Loader") & F.contains(k.value_src, F.lit("SafeLoader")), F.lit(False)))
    ))
    return F.transform(found, lambda c: hit(
        "SEC-YAML", "HIGH", "Unsafe YAML Deserialization (yaml.load)",
        line=c.line, snippet=line_text(c.line), disc=c.span,
    ))


def shell_true() -> Column:
    found = F.filter("calls", lambda c: (
        (c.func_kind == "attr") & c.func_name.isin(*SHELL_CALLS)
        & F.exists(c.kwargs, lambda k: F.coalesce((k["name"] == "shell") & k.is_true, F.lit(False)))
    ))
    return F.transform(found, lambda c: hit(
        "SEC-SHELL", "HIGH", "Subprocess Execution with 'shell=True'",
        line=c.line, snippet=line_text(c.line), disc=c.span,
    ))


def sql_text() -> Column:
    found = F.filter("fstrings", lambda s: any_word(s.const_text, SQL_PHRASES))
    return F.transform(found, lambda s: hit(
        "SEC-SQL", "HIGH", "Potential SQL Injection via String Interpolation",
        line=s.line, snippet=line_text(s.line), disc=s.span,
    ))
