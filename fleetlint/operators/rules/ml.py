"""Machine-learning practice rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.functions.arrays import let
from fleetlint.model import (
    ACCURACY_WORDS, CLASSIFIERS, CV_WORDS, FIT_CALLS, MODEL_WORDS, ROBUST_METRICS, SCALE_SENSITIVE,
    SCALER_WORDS, SEED_KEYWORDS, SPLIT_CALL, STOCHASTIC_CALLS, TRANSFORM_CALLS, literal_array,
)
from fleetlint.operators.rules.hits import (
    any_word, hit, imports_mention, line_text, only_if, outside_tests,
)


def early_fits() -> Column:
    """Per scope: fits in its body above the split that is walked last."""

    def of_scope(s):
        body = F.filter(s.calls, lambda c: c.in_body)
        splits = F.filter(body, lambda c: (c.func_kind == "name") & (c.func_name == SPLIT_CALL))
        last = F.array_max(F.transform(splits, lambda c: F.struct(
            c.item_idx.alias("item_idx"), c.walk_idx.alias("walk_idx"), c.line.alias("line"))))
        fits = F.filter(body, lambda c: (
            (c.func_kind == "attr") & c.func_name.isin(*FIT_CALLS) & (c.line < last.line)))
        return F.transform(fits, lambda c: F.struct(
            s.line.alias("scope_line"), s.scope_id.alias("scope_id"),
            c.line.alias("fit_line"), last.line.alias("split_line"), c.span.alias("span")))

    return F.flatten(F.transform("scopes", of_scope))


def fit_before_split(scope_mode: str = "line") -> Column:
    """``line``: one hit per fitting line, judged in its innermost scope;
    ``source``: one per scope and call, module and function alike."""
    found = early_fits()
    if scope_mode == "line":
        found = let(found, lambda every: F.transform(
            F.array_distinct(F.transform(every, lambda f: f.fit_line)),
            lambda ln: F.array_max(F.filter(every, lambda f: f.fit_line == ln)),
        ))

    def disc(f):
        if scope_mode == "line":
            return F.lit("")
        return F.concat(f.scope_id.cast("string"), F.lit("|"), f.span)

    return F.transform(found, lambda f: hit(
        "ML-LEAK-PREFIT", "CRITICAL", "Data Leakage: Preprocessing Fitted Before train_test_split()",
        line=f.fit_line, end=f.split_line,
        snippet=F.concat(line_text(f.fit_line), F.lit("\n...\n"), line_text(f.split_line)),
        disc=disc(f), metadata={"fit_line": f.fit_line, "split_line": f.split_line},
    ))


def fit_on_test() -> Column:
    found = F.filter("calls", lambda c: (
        (c.func_kind == "attr") & c.func_name.isin(*FIT_CALLS)
        & any_word(F.lower(c.arg0_src), ["test", "val"])))
    return F.transform(found, lambda c: hit(
        "ML-LEAK-TESTFIT", "CRITICAL",
        F.concat(F.lit("Test-Set Contamination: Calling '"), c.func_name, F.lit("()' on Test Data")),
        line=c.line, snippet=line_text(c.line), detail=c.func_name, disc=c.span,
    ))


def loose_chain(s: Column) -> Column:
    """Does a scope transform with a scaler and fit a model, with no pipeline?"""
    return (
        F.coalesce(~s.uses_pipeline, F.lit(False))
        & F.exists(s.calls, lambda c: (c.func_kind == "attr") & c.func_name.isin(*TRANSFORM_CALLS)
                   & F.contains(F.lower(c.call_src), F.lit("scaler")))
        & F.exists(s.calls, lambda c: (c.func_kind == "attr") & (c.func_name == "fit")
                   & any_word(F.lower(c.call_src), MODEL_WORDS))
    )


def no_pipeline(scope_mode: str = "line") -> Column:
    """Functions that qualify; the module only if none does (``source``: both)."""
    found = F.filter("scopes", lambda s: (s.kind != "async") & loose_chain(s))
    if scope_mode == "line":
        inner = F.filter(found, lambda s: s.kind == "function")
        found = F.when(F.size(inner) > 0, inner).otherwise(found)
    return F.transform(found, lambda s: hit(
        "ML-PREP-NOPIPE", "MEDIUM", "Missing Scikit-Learn Pipeline Encapsulation",
        line=s.line, disc=s.kind,
    ))


def unscaled() -> Column:
    named = F.filter(literal_array(SCALE_SENSITIVE), lambda m: F.exists(
        "imports", lambda i: F.contains(i.src, m)))
    names = tx.tidy_join(named)
    return only_if(
        (F.size(named) > 0) & ~imports_mention(SCALER_WORDS),
        hit("ML-PREP-UNSCALED", "HIGH",
            F.concat(F.lit("Unscaled Features with Sensitive Estimator ("), names, F.lit(")")), detail=names),
    )


def no_seed() -> Column:
    found = F.filter("calls", lambda c: (
        c.func_kind.isin("name", "attr") & c.func_name.isin(*STOCHASTIC_CALLS)
        & ~F.exists(c.kwargs, lambda k: F.coalesce(k["name"].isin(*SEED_KEYWORDS), F.lit(False)))))
    return F.transform(found, lambda c: hit(
        "ML-VAL-NOSEED", "MEDIUM",
        F.concat(F.lit("Missing 'random_state' in '"), c.func_name, F.lit("()'")),
        line=c.line, snippet=line_text(c.line), detail=c.func_name, disc=c.span,
        metadata={"func_name": c.func_name},
    ))


def no_cross_validation() -> Column:
    return only_if(
        outside_tests() & imports_mention([SPLIT_CALL]) & ~imports_mention(CV_WORDS),
        hit("ML-VAL-NOCV", "LOW",
            F.concat(F.lit("Absence of K-Fold Cross-Validation in '"), F.col("path"), F.lit("'"))),
    )


def no_stratify() -> Column:
    plain = F.filter("calls", lambda c: (
        (c.func_kind == "name") & (c.func_name == SPLIT_CALL)
        & ~F.exists(c.kwargs, lambda k: F.coalesce(k["name"] == "stratify", F.lit(False)))))
    return F.transform(F.when(imports_mention(CLASSIFIERS), plain).otherwise(F.slice("calls", 1, 0)), lambda c: hit(
        "ML-MET-NOSTRAT", "MEDIUM", "Missing 'stratify' in Classification train_test_split()",
        line=c.line, snippet=line_text(c.line), disc=c.span,
    ))


def raw_accuracy() -> Column:
    return only_if(
        outside_tests() & imports_mention(ACCURACY_WORDS) & ~imports_mention(ROBUST_METRICS),
        hit("ML-MET-RAWACC", "LOW",
            F.concat(F.lit("Sole Reliance on 'accuracy_score' in '"), F.col("path"), F.lit("'"))),
    )
