"""The rule catalogue.

File rules map one row of facts and lines to an array of hits; repository
rules do the same on one row of per-repository counters. Both are plain
column expressions, so any set of them runs in a single pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from fleetlint.model import RULES
from fleetlint.operators.rules import deps, deploy, docs, ml, quality, security, structure, testing

# Category -> place of its findings among those of equal severity.
ANALYZER_ORDER = {r.category: r.analyzer_ord for r in RULES}

FILE_RULES = {
    "ARCH-GOD": structure.god_file,
    "QUAL-EXC": quality.swallowed_exception,
    "QUAL-MUT": quality.mutable_default,
    "QUAL-CMPX": quality.complexity,
    "QUAL-TYPE": quality.missing_types,
    "DEP-DEPR": deps.deprecated,
    "DEP-UNPIN": deps.unpinned,
    "SEC-SECRET": security.secrets,
    "SEC-EXEC": security.code_execution,
    "SEC-YAML": security.unsafe_yaml,
    "SEC-SHELL": security.shell_true,
    "SEC-SQL": security.sql_text,
    "TEST-NOASSERT": testing.no_assert,
    "DEPLOY-INCOMPLETE-GITIGNORE": deploy.incomplete_gitignore,
    "ML-LEAK-PREFIT": ml.fit_before_split,
    "ML-LEAK-TESTFIT": ml.fit_on_test,
    "ML-PREP-NOPIPE": ml.no_pipeline,
    "ML-PREP-UNSCALED": ml.unscaled,
    "ML-VAL-NOSEED": ml.no_seed,
    "ML-VAL-NOCV": ml.no_cross_validation,
    "ML-MET-NOSTRAT": ml.no_stratify,
    "ML-MET-RAWACC": ml.raw_accuracy,
}

REPO_RULES = {
    "ARCH-001": structure.flat_root,
    "DEP-NOMANIFEST": deps.no_manifest,
    "TEST-NOTESTS": testing.no_tests,
    "TEST-LOWRATIO": testing.low_ratio,
    "DOC-NOREADME": docs.no_readme,
    "DOC-SPARSE-README": docs.sparse_readme,
    "DOC-SECTIONS": docs.missing_sections,
    "DOC-LOWDOCSTRINGS": docs.low_docstrings,
    "DOC-NOLICENSE": docs.no_license,
    "CICD-NOWORKFLOWS": deploy.no_workflows,
    "DEPLOY-NODOCKER": deploy.no_docker,
    "DEPLOY-DOCKER-LATEST": deploy.docker_latest,
    "DEPLOY-NOGITIGNORE": deploy.no_gitignore,
}

# Fact arrays each rule reads; rules not listed need none.
FACTS_NEEDED = {
    "QUAL-EXC": {"handlers"},
    "QUAL-MUT": {"defs"},
    "QUAL-CMPX": {"defs"},
    "QUAL-TYPE": {"defs"},
    "SEC-EXEC": {"calls"},
    "SEC-YAML": {"calls"},
    "SEC-SHELL": {"calls"},
    "SEC-SQL": {"fstrings"},
    "TEST-NOASSERT": {"defs"},
    "DOC-LOWDOCSTRINGS": {"defs"},
    "ML-LEAK-PREFIT": {"scopes"},
    "ML-LEAK-TESTFIT": {"calls"},
    "ML-PREP-NOPIPE": {"scopes"},
    "ML-PREP-UNSCALED": {"imports"},
    "ML-VAL-NOSEED": {"calls"},
    "ML-VAL-NOCV": {"imports"},
    "ML-MET-NOSTRAT": {"calls", "imports"},
    "ML-MET-RAWACC": {"imports"},
    "ARCH-CIRC": {"imports"},
}


@dataclass(frozen=True)
class UserRule:
    """A rule of the user's own, given to ``Audit(rules=[...])`` beside the ids of built-in ones.

    ``hits`` builds an array of ``hits.hit(...)``: over the facts and lines of
    a file (``level`` "file") or over the counters of a repository ("repo").
    ``facts`` names the fact arrays it reads and ``calls`` the functions whose
    calls it looks at. ``category`` must be one of the scored ones. ``{x}`` in
    the texts stands for a hit's detail.
    """

    rule_id: str
    category: str
    hits: Callable[[], Column]
    level: str = "file"
    facts: frozenset[str] = frozenset()
    calls: frozenset[str] = frozenset()
    confidence_pct: int = 80
    risk: str = ""
    advice: str = ""

    def __post_init__(self):
        if self.level not in ("file", "repo"):
            raise ValueError(f"level {self.level!r} is neither file nor repo")
        if self.category not in ANALYZER_ORDER:
            raise ValueError(f"category {self.category!r} has no weight")


def user_rules(rules) -> list[UserRule]:
    return [r for r in rules if isinstance(r, UserRule)]


def facts_needed(rules) -> set[str]:
    return set().union(*(r.facts if isinstance(r, UserRule) else FACTS_NEEDED.get(r, set()) for r in rules))
