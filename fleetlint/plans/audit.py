"""From a file table to findings.

``scan_files`` is one narrow pass over the sources: parse, run every file rule,
keep a compact row per file. All later steps read those rows, never the text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.functions.arrays import built_once, explode_once
from fleetlint.model import (
    DOCKERFILES, EXEC_CALLS, FIT_CALLS, LICENSES, MANIFESTS, README_SECTIONS, READMES, RULE_IDS,
    SHELL_CALLS, SPLIT_CALL, STOCHASTIC_CALLS, HITS_TYPE, rule_dim,
)
from fleetlint.operators import scoring
from fleetlint.operators.facts import extract_facts
from fleetlint.operators.repair import LINE_FIXES
from fleetlint.operators.rules import ANALYZER_ORDER, FILE_RULES, REPO_RULES, facts_needed, structure, user_rules
from fleetlint.operators.rules.hits import is_test_path, none
from fleetlint.operators.rules.security import may_hold_secret
from fleetlint.session import materialise, spread

# Small text files whose content a rule looks at.
NOTE_FILES = [*READMES, *DOCKERFILES, "requirements.txt", ".gitignore"]

# Rules that need no file content at all.
PATH_ONLY = {
    "ARCH-001", "ARCH-GOD", "ARCH-INIT", "DEP-NOMANIFEST", "TEST-NOTESTS", "TEST-LOWRATIO",
    "DOC-NOREADME", "DOC-NOLICENSE", "CICD-NOWORKFLOWS", "DEPLOY-NODOCKER", "DEPLOY-NOGITIGNORE",
}
NOTE_RULES = {
    "DEP-DEPR", "DEP-UNPIN", "DOC-SPARSE-README", "DOC-SECTIONS", "DEPLOY-DOCKER-LATEST",
    "DEPLOY-INCOMPLETE-GITIGNORE",
}
# Rules that look at Python files alone, one by one or together.
CODE_RULES = set(FILE_RULES) - NOTE_RULES | {"ARCH-CIRC", "ARCH-INIT"}
# Names of calls any rule looks at; other calls need not leave the parser.
WATCHED_CALLS = [*EXEC_CALLS, "load", *SHELL_CALLS, *FIT_CALLS, SPLIT_CALL, *STOCHASTIC_CALLS]


def annotate(files: DataFrame, rules=RULE_IDS) -> DataFrame:
    """Files with ``lines``, ``note`` and the fact arrays the rules need."""
    want = tuple(sorted(facts_needed(rules)))
    calls = [*WATCHED_CALLS, *(c for r in user_rules(rules) for c in sorted(r.calls))]
    note = F.when(F.col("path").isin(*NOTE_FILES), F.col("content"))
    base = files.withColumns({"note": note, "closed": F.col("content").endswith("\n")})
    if "SEC-SECRET" in rules:
        base = base.withColumn("suspect", may_hold_secret(F.col("content")))
    if want:
        code = base.withColumn("content", F.when(F.col("is_python"), F.col("content")))
        out = extract_facts(code, want, calls, with_lines=True)
        lines = F.when(F.col("is_python"), F.col("lines")).otherwise(tx.split_lines(F.col("note")))
        return out.withColumn("lines", lines)
    if set(rules) <= PATH_ONLY:
        return base.drop("content", "note", "closed")
    if set(rules) <= PATH_ONLY | NOTE_RULES:
        return base.drop("content").withColumn("lines", tx.split_lines(F.col("note")))
    text = F.when(F.col("is_python"), F.col("content")).otherwise(F.col("note"))
    return spread(base, "repo_id", "path").withColumn("lines", tx.split_lines(text)).drop("content")


def file_hits(rules=RULE_IDS, scope_mode: str = "line"):
    """All file rules as one array expression."""
    return _file_hits(tuple(rules), scope_mode)


@built_once
def _file_hits(rules: tuple, scope_mode: str):
    scoped = {"ML-LEAK-PREFIT", "ML-PREP-NOPIPE"}
    parts = [
        rule(scope_mode) if rule_id in scoped else rule()
        for rule_id, rule in FILE_RULES.items() if rule_id in rules
    ]
    parts += [rule.hits() for rule in user_rules(rules) if rule.level == "file"]
    # A null array (rule not applicable to the row) must not blank the rest.
    parts = [F.coalesce(p, none()) for p in parts]
    return F.concat(*parts) if parts else F.array().cast(HITS_TYPE)


def _import_roots():
    return F.array_distinct(F.flatten(F.transform("imports", lambda i: F.when(
        i.kind == "import", F.transform(i.names, tx.first_segment)
    ).when(i.module.isNotNull(), F.array(tx.first_segment(i.module))).otherwise(
        F.array().cast("array<string>")))))


def compact(annotated: DataFrame, rules=RULE_IDS, scope_mode: str = "line", for_repair: bool = False) -> DataFrame:
    """Rule hits and the per-file numbers later steps need; text is dropped.

    ``for_repair`` keeps the text of files that some line edit applies to, so
    that repairs need neither a second parse nor a join with the file table.
    """
    have = set(annotated.columns)
    path, note = F.col("path"), F.col("note")
    columns = ["repo_id", "repo_name", "path", "is_python", "loc"]
    if "parse_ok" in have:
        columns += ["parse_ok", "error_line", "error_text", "fact_errors"]
    if "imports" in have:
        columns.append(_import_roots().alias("import_roots"))
    if "defs" in have:
        public = F.filter("defs", lambda d: ~d["name"].startswith("_"))
        columns.append(F.size(public).alias("public_defs"))
        columns.append(F.size(F.filter(public, lambda d: d.has_docstring)).alias("documented_defs"))
    if "note" in have or not set(rules) <= PATH_ONLY:
        readme = path.isin(*READMES)
        docker = path.isin(*DOCKERFILES) & F.contains(note, F.lit("latest")) & F.contains(note, F.lit("FROM"))
        columns += [
            F.when(readme, F.length(tx.strip(note))).alias("readme_chars"),
            F.when(readme, F.substring(note, 1, 100)).alias("readme_head"),
            F.when(readme, F.array_join(tx.missing_items(F.lower(note), README_SECTIONS), ", ")).alias("readme_gaps"),
            F.when(docker, F.get(
                F.filter("lines", lambda x: F.contains(x, F.lit("FROM"))), F.lit(0))).alias("docker_from"),
        ]
    if for_repair:
        text = F.concat(F.array_join("lines", "\n"), F.when(F.col("closed"), "\n").otherwise(""))
        wanted = F.exists("hits", lambda h: h.rule_id.isin(*LINE_FIXES))
        columns.append(F.when(wanted, text).alias("original"))
    return annotated.withColumn("hits", file_hits(rules, scope_mode)).select(*columns, "hits")


def scan_files(
    files: DataFrame, rules=RULE_IDS, scope_mode: str = "line", for_repair: bool = False
) -> DataFrame:
    """A compact row per file. Only code and the few notes are read as text.

    Built-in rules say nothing about any other file, so those are scanned for
    their paths alone; the filter on the text branch reaches the file scan. A
    rule of the user's own may look at any file, so it needs all of them.
    """
    if set(rules) <= PATH_ONLY or any(r.level == "file" for r in user_rules(rules)):
        return compact(annotate(files, rules), rules, scope_mode, for_repair)
    of_interest = F.col("is_python") | F.col("path").isin(*NOTE_FILES)
    texts = compact(annotate(files.filter(of_interest), rules), rules, scope_mode, for_repair)
    others = files.filter(~of_interest)
    have = ("repo_id", "repo_name", "path", "is_python", "loc")
    blank = {"hits": none()}
    rest = others.select(*[
        F.col(c.name) if c.name in have else blank.get(c.name, F.lit(None)).cast(c.dataType).alias(c.name)
        for c in texts.schema
    ])
    return texts.unionByName(rest)


def repo_rows(scanned: DataFrame) -> DataFrame:
    """Counters and marks per repository: one grouped pass, partial sums first."""
    have = set(scanned.columns)
    path, python = F.col("path"), F.col("is_python")
    test = python & is_test_path(path)
    source = python & ~is_test_path(path)
    untested = python & ~path.startswith("tests/")

    def present(names):
        return F.coalesce(F.bool_or(path.isin(*names)), F.lit(False))

    def preferred(column, names):
        """The value on the first of the named files the repository has."""
        out = F.when(F.bool_or(path == names[0]), F.max(F.when(path == names[0], column)))
        return out.otherwise(F.max(F.when(path == names[1], column)))

    def total(condition, value):
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")

    aggs = [
        F.max("repo_name").alias("repo_name"),
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(python).alias("python_files"),
        F.sum("loc").alias("total_loc"),
        F.count_if(python & (F.instr(path, "/") == 0)).alias("root_python_files"),
        F.count_if(test).alias("test_files"),
        total(source, F.col("loc")).alias("source_loc"),
        total(test, F.col("loc")).alias("test_loc"),
        present(MANIFESTS).alias("has_manifest"),
        present(LICENSES).alias("has_license"),
        present([".gitignore"]).alias("has_gitignore"),
        F.bool_or(path.rlike(r"^\.github/workflows/.*\.ya?ml$")).alias("has_workflow"),
        F.min(F.when(python, path)).alias("first_python"),
        F.min(F.when(source, path)).alias("first_source"),
        F.min(F.when(test, path)).alias("first_test"),
        F.min(F.when(untested, path)).alias("first_untested"),
        preferred(path, READMES).alias("readme_path"),
        preferred(path, DOCKERFILES).alias("docker_path"),
    ]
    if "readme_chars" in have:
        aggs += [preferred(F.col(c), READMES).alias(c) for c in ("readme_chars", "readme_head", "readme_gaps")]
        aggs.append(preferred(F.col("docker_from"), DOCKERFILES).alias("docker_from"))
    if "public_defs" in have:
        aggs += [total(untested, F.col(c)).alias(c) for c in ("public_defs", "documented_defs")]
    return scanned.groupBy("repo_id").agg(*aggs)


def hits_of(scanned: DataFrame, repos: DataFrame, rules=RULE_IDS, modules: DataFrame | None = None) -> DataFrame:
    """Every hit as a row ``(repo_id, hit)``, duplicates kept.

    ``modules`` may name a table of the same files that is cheaper to read
    than ``scanned`` where only paths are needed.
    """
    modules = scanned if modules is None else modules
    parts = []
    added = user_rules(rules)
    if any(r in FILE_RULES for r in rules) or any(r.level == "file" for r in added):
        parts.append(explode_once(scanned, ["repo_id"], "hits", "hit"))
    of_repo = [rule() for rule_id, rule in REPO_RULES.items() if rule_id in rules]
    of_repo += [F.coalesce(rule.hits(), none()) for rule in added if rule.level == "repo"]
    if of_repo:
        wide = repos.select("repo_id", F.concat(*of_repo).alias("hits"))
        parts.append(explode_once(wide, ["repo_id"], "hits", "hit"))
    if "ARCH-INIT" in rules:
        parts.append(structure.missing_init(modules))
    if "ARCH-CIRC" in rules:
        parts.append(structure.circular_imports(scanned, modules))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def to_findings(hits: DataFrame, rules=RULE_IDS) -> DataFrame:
    """Add identifier and the texts fixed per rule (broadcast of one row per rule).

    A hit of a rule without a row stays: it belongs to no category, counts
    with no confidence and says so in its texts.
    """
    spark = hits.sparkSession
    flat = hits.select("repo_id", "hit.*")
    line = F.coalesce(F.col("line_no").cast("string"), F.lit("-"))
    detail = F.coalesce("detail", F.lit(""))
    dim = rule_dim(spark)
    added = [
        (r.rule_id, r.category, ANALYZER_ORDER[r.category], r.confidence_pct / 100.0, False, r.risk, r.advice)
        for r in user_rules(rules)
    ]
    if added:
        dim = dim.unionByName(spark.createDataFrame(added, dim.schema))
    known = flat.join(F.broadcast(dim), "rule_id", "left").fillna({
        "category": "Unknown", "analyzer_ord": 99, "confidence": 0.0, "auto_fixable": False,
        "risk_text": "The rule is not in the rule table.", "advice_text": "Add the rule to the table."})
    return known.select(
        tx.stable_id(F.col("rule_id"), F.col("repo_id").cast("string"), F.col("path"), line, F.col("disc"))
        .alias("finding_id"),
        "rule_id", "repo_id", "category", "severity", "title", "path", "line_no", "end_line_no",
        "code_snippet",
        F.replace("risk_text", F.lit("{x}"), detail).alias("risk_explanation"),
        F.replace("advice_text", F.lit("{x}"), detail).alias("recommendation"),
        "confidence", "auto_fixable", "metadata", "metric_num", "metric_den", "analyzer_ord",
    )


def relevant(files: DataFrame, rules) -> DataFrame:
    """Only the files some rules can look at; the filter reaches the scan."""
    if set(rules) <= CODE_RULES:
        return files.filter("is_python")
    if set(rules) <= NOTE_RULES & set(FILE_RULES):
        return files.filter(F.col("path").isin("requirements.txt", ".gitignore"))
    return files


def findings(files: DataFrame, rules=RULE_IDS, scope_mode: str = "line") -> DataFrame:
    """Findings of some rules, in one lazy plan."""
    files = relevant(files, rules)
    scanned = scan_files(files, rules, scope_mode)
    return to_findings(hits_of(scanned, repo_rows(scanned), rules, files), rules)


@dataclass
class Audit:
    """Tables of one scan. Per-file rows and findings are written once and shared."""

    files: DataFrame
    rules: tuple = tuple(RULE_IDS)
    scope_mode: str = "line"
    for_repair: bool = False
    #: When the scan was made, in UTC; reports say so.
    scanned_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    @cached_property
    def scanned(self) -> DataFrame:
        rows = scan_files(self.files, self.rules, self.scope_mode, self.for_repair)
        return materialise(rows, "scan")

    @cached_property
    def repos(self) -> DataFrame:
        return repo_rows(self.scanned)

    @cached_property
    def findings(self) -> DataFrame:
        hits = hits_of(self.scanned, self.repos, self.rules)
        return materialise(to_findings(hits, self.rules), "findings")

    @cached_property
    def scorecards(self) -> DataFrame:
        return scoring.scorecards(self.findings, self.repos)

    @cached_property
    def category_scores(self) -> DataFrame:
        return scoring.category_scores(self.scorecards)

    @cached_property
    def summaries(self) -> DataFrame:
        return scoring.executive_summaries(self.findings, self.scorecards)
