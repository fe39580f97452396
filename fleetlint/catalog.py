"""Named queries over the test tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.model import (
    ACCURACY_WORDS, CLASSIFIERS, CV_WORDS, LICENSES, MANIFESTS, ROBUST_METRICS, RULE_IDS, SPLIT_CALL,
)
from fleetlint.operators import explore, fact_store, facts, mldata, repair, scoring, timeline, verdict
from fleetlint.operators.rules import structure
from fleetlint.operators.snapshot_log import SnapshotLog
from fleetlint.operators.rules import UserRule
from fleetlint.operators.rules.hits import hit, imports_mention, is_test_path
from fleetlint.operators.rules.ml import early_fits
from fleetlint.plans import audit as plan
from fleetlint.plans import report
from fleetlint.plans.repair import Repair
from fleetlint.session import materialise, scratch_path, tune
from fleetlint.sources import corpus
from fleetlint.sources import files as src
from fleetlint.streaming import arrivals, snapshots

FINDING_COLUMNS = [
    "finding_id", "rule_id", "repo_id", "category", "severity", "title", "path", "line_no",
    "end_line_no", "code_snippet", "confidence", "auto_fixable", "metric_num", "metric_den", "analyzer_ord",
]


# A fixed date, so that reports can be compared.
SCANNED_AT = datetime(2024, 1, 31, 12, 5)


class Fleet:
    """Inputs and shared intermediate tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = tune(spark), sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        return corpus.raw_files(self.table("documents"))

    @cached_property
    def files(self) -> DataFrame:
        """The fleet's file table, written once as a real fleet would have it."""
        made = corpus.source_files(self.spark, self.dir)
        tasks = self.spark.sparkContext.defaultParallelism
        # Only a table of few splits is dealt anew; else texts stay with the tasks that read
        # them, and the number of files grows with the table.
        if self.table("documents").rdd.getNumPartitions() < 3 * tasks:
            made = made.repartition(tasks, "repo_id", "path")
        return materialise(made, "source_files")

    @cached_property
    def audit(self) -> plan.Audit:
        return plan.Audit(self.files, for_repair=True, scanned_at=SCANNED_AT)

    @cached_property
    def findings(self) -> DataFrame:
        return self.audit.findings

    @cached_property
    def cards(self) -> DataFrame:
        return self.audit.scorecards

    @cached_property
    def proposals(self) -> DataFrame:
        return corpus.proposals(self.findings)

    @cached_property
    def repair(self) -> Repair:
        return Repair(self.audit, corpus.test_runs, self.proposals)

    @cached_property
    def exported(self) -> str:
        """Where the whole diagnosis is written as JSON."""
        out = scratch_path(self.spark, "diagnosis")
        report.write_diagnosis(report.diagnosis_records(
            self.audit, self.repair.results, self.repair.patches, timeline.timeline(self.snapshots)), out)
        return out

    @cached_property
    def snapshots(self) -> DataFrame:
        return timeline.snapshots_from_events(self.table("events"))

    @cached_property
    def facts(self) -> DataFrame:
        return facts.extract_facts(src.python_files(self.files))

    @cached_property
    def trials(self) -> DataFrame:
        return corpus.trial_patches(self.table("documents"))

    @cached_property
    def trial_decisions(self) -> DataFrame:
        return verdict.gate(verdict.patch_features(self.trials))


_FLEETS: dict[tuple[str, str], Fleet] = {}


def fleet(spark: SparkSession, sf_dir: str) -> Fleet:
    """One ``Fleet`` per session and folder, so shared tables are written once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FLEETS:
        _FLEETS[key] = Fleet(spark, sf_dir)
    return _FLEETS[key]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(build: Callable[[Fleet], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(fleet(spark, sf_dir))
        return build

    return register


def _rule_query(rule_id: str):
    # Only the facts this rule reads are extracted.
    return lambda f: plan.findings(f.files, [rule_id]).select(*FINDING_COLUMNS)


for _rule in RULE_IDS:
    query("rule_" + _rule.lower().replace("-", "_"))(_rule_query(_rule))


# ------------------------------------------------------------ sources, sinks
@query("s1_list_tree")
def _(f):
    return src.tree_entries(f.files)


@query("s1_load_trees")
def _(f):
    """The file table written as trees to the shared folder and loaded from there."""
    folder = scratch_path(f.spark, "trees")
    src.write_trees(f.files, folder)
    return src.load_trees(f.spark, parent=folder).select(
        "repo_name", "path", "is_python", "loc", F.md5("content").alias("digest"))


@query("s2_skip_rules")
def _(f):
    return src.keep_files(f.raw).select("repo_id", "path", "size_bytes")


@query("s2_skip_rules_all_dot_dirs")
def _(f):
    return src.keep_files(f.raw, admit_dirs=()).select("repo_id", "path", "size_bytes")


@query("s2_skipped_files")
def _(f):
    return src.skipped_files(f.raw, max_bytes=4000)


@query("s3_decode")
def _(f):
    return f.files.select("repo_id", "repo_name", "path", "is_python", "loc", F.md5("content").alias("digest"))


@query("s4_lookup")
def _(f):
    names = F.array(F.lit("README.md"), F.lit("Dockerfile"))
    wanted = f.files.select("repo_id").distinct().withColumn("path", F.explode(names))
    found = src.find_files(f.files, wanted, "left")
    return found.select("repo_id", "path", F.col("loc").isNotNull().alias("found"), "loc")


@query("s5_fact_counts")
def _(f):
    return f.facts.select(
        "repo_id", "path", "parse_ok",
        *[F.size(c).alias(f"n_{c}") for c in ("calls", "scopes", "imports", "defs", "handlers", "fstrings")])


@query("s5_stored_facts")
def _(f):
    """Facts by way of a store that two scans filled: Python files of odd repositories, then all."""
    store = fact_store.FactStore(f.spark, scratch_path(f.spark, "facts"))
    code = src.python_files(f.files)
    store.add(code.filter("repo_id % 2 = 1"), "odd")
    store.add(code, "all")
    return store.facts_of(code).select(
        "repo_id", "path", "parse_ok",
        *[F.size(c).alias(f"n_{c}") for c in ("calls", "scopes", "imports", "defs", "handlers", "fstrings")])


@query("s5_parsed_once")
def _(f):
    """Texts parsed by a scan, by the same scan later, and by a scan of the same files under other paths."""
    store = fact_store.FactStore(f.spark, scratch_path(f.spark, "facts"), want=("imports",))
    code = src.python_files(f.files)
    moved = code.withColumn("path", F.concat(F.lit("moved/"), "path"))
    added = [store.add(rows, name).agg(F.lit(name).alias("scan"), F.count(F.lit(1)).alias("parsed"))
             for name, rows in (("first", code), ("again", code), ("moved", moved))]
    return reduce(DataFrame.unionByName, added)


@query("s5_defs")
def _(f):
    return facts.fact_view(f.facts, "defs")


@query("s5_calls")
def _(f):
    return facts.fact_view(f.facts, "calls").select(
        "repo_id", "path", "call_id", "line", "span", "func_kind", "func_name", "recv_name", "n_args",
        "arg0_src", "call_src",
        F.array_join(F.transform("kwargs", lambda k: k["name"]), ",").alias("keywords"))


@query("s5_imports")
def _(f):
    return facts.fact_view(f.facts, "imports").withColumn("names", F.array_join("names", ","))


@query("s5_scope_calls")
def _(f):
    return facts.scope_call_view(f.facts).select(
        "repo_id", "path", "scope_kind", "scope_line", "uses_pipeline", "line", "func_name", "item_idx", "in_body")


@query("s6_python_files")
def _(f):
    return src.python_files(f.files).select("repo_id", "path", "loc")


@query("k1_append_snapshots")
def _(f):
    log = scratch_path(f.spark, "timeline")
    for part in (0, 1):
        for _again in range(2):  # a repeated run leaves no second copy
            timeline.record_snapshots(f.snapshots.filter(F.col("snapshot_id") % 2 == part), log, f"part-{part}")
    return timeline.read_snapshots(f.spark, log).select(
        "repo_id", "snapshot_id", "overall_tenths", "total_issues", "fixes_applied")


@query("k1_compacted_log")
def _(f):
    """Eight scans, each recorded twice, in a log that puts folders together beyond four."""
    log = SnapshotLog(f.spark, scratch_path(f.spark, "log"), folders=4)
    for part in range(8):
        for _again in range(2):
            log.commit(f.snapshots.filter(F.col("snapshot_id") % 8 == part), f"part-{part}")
    return log.read().select(
        "repo_id", "snapshot_id", "scan_id", "overall_tenths",
        F.try_element_at("category_scores", F.lit("Security")).alias("security"))


@query("k1_card_timeline")
def _(f):
    """From a scan's scorecards to the timeline."""
    log = scratch_path(f.spark, "timeline")
    timeline.record_snapshots(timeline.snapshots_from_cards(f.cards), log, "scan")
    entries = timeline.timeline(timeline.read_snapshots(f.spark, log))
    return entries.select("repo_id", "version", "overall_tenths", "total_issues", F.size("category_scores").alias("n_scores"))


@query("k2_read_timeline")
def _(f):
    log = scratch_path(f.spark, "timeline")
    timeline.record_snapshots(f.snapshots, log, "all")
    return timeline.read_snapshots(f.spark, log).select(
        "repo_id", "snapshot_id", F.size("category_scores").alias("n_scores"),
        F.try_element_at("category_scores", F.lit("Security")).alias("security"))


@query("k3_diagnosis_json")
def _(f):
    """Written and read back."""
    return report.read_diagnosis(f.spark, f.exported).select(
        "repo_id", "section", "key", F.get_json_object("json", "$.title").alias("title"),
        F.get_json_object("json", "$.grade").alias("grade"),
        F.get_json_object("json", "$.total_loc").cast("bigint").alias("total_loc"))


def _section_query(section: str, fields: str, *columns, **made):
    """Whole records of one section of the export, read back; ``made`` columns are built from the record."""
    def build(f):
        rows = report.read_diagnosis(f.spark, f.exported, section)
        return rows.select("repo_id", F.from_json("json", fields).alias("r")).select(
            *[F.col(c if c == "repo_id" else f"r.{c}") for c in columns], *[make().alias(name) for name, make in made.items()])

    return build


query("k3_findings_json")(_section_query(
    "finding", "finding_id string, rule_id string, category string, severity string, title string, path string, line_no int, "
    "end_line_no int, code_snippet string, confidence double, auto_fixable boolean, metric_num bigint, metric_den bigint, "
    "analyzer_ord int", *FINDING_COLUMNS))
query("k3_scorecards_json")(_section_query(
    "scorecard", "repo_name string, overall_score double, grade string, total_issues bigint, critical_issues bigint, "
    "high_issues bigint, medium_issues bigint, low_issues bigint, summary string, total_files bigint, python_files bigint, "
    "total_loc bigint", "repo_id", "repo_name", "overall_score", "grade", "total_issues", "critical_issues", "high_issues",
    "medium_issues", "low_issues", "summary", "total_files", "python_files", "total_loc"))
query("k3_validation_json")(_section_query(
    "validation", "patch_id string, path string, overall_status string, syntax_check boolean, import_check boolean, "
    "tests_passed_before int, tests_failed_before int, tests_passed_after int, tests_failed_after int, confidence double, "
    "steps array<struct<name:string,status:string>>", "patch_id", "path", "overall_status", "syntax_check", "import_check",
    "tests_passed_before", "tests_failed_before", "tests_passed_after", "tests_failed_after", "confidence",
    steps=lambda: F.array_join(F.transform("r.steps", lambda s: F.concat(s["name"], F.lit("="), s.status)), ";")))
query("k3_patches_json")(_section_query(
    "patch", "finding_id string, rule_id string, path string, description string, replacement_code string", "repo_id",
    "finding_id", "rule_id", "path", "description", text_digest=lambda: F.md5("r.replacement_code")))
query("k3_timeline_json")(_section_query(
    "timeline", "snapshot_id bigint, version string, overall_tenths int, previous_tenths int, delta_tenths int, "
    "total_issues bigint, fixes_applied bigint, description string", "repo_id", "snapshot_id", "version", "overall_tenths",
    "previous_tenths", "delta_tenths", "total_issues", "fixes_applied", "description"))


@query("k4_report_lines")
def _(f):
    """Written as files and read back."""
    out = scratch_path(f.spark, "reports")
    report.write_reports(report.report_lines(f.audit, f.repair.results), out)
    return report.read_reports(f.spark, out)


@query("k4_report_timeline")
def _(f):
    return report.timeline_lines(timeline.timeline(f.snapshots))


@query("k5_counters")
def _(f):
    return src.repo_counters(f.files)


# ---------------------------------------------------------- filters, checks
@query("p1_search")
def _(f):
    found = explore.search(
        f.findings, ["CRITICAL", "HIGH", "MEDIUM"], ["Security", "Testing", "Documentation", "CI/CD"], "Test")
    return found.select("finding_id", "rule_id", "repo_id", "path")


@query("p2_urgent")
def _(f):
    return explore.urgent(f.findings).select("finding_id", "severity")


@query("p3_ml_related")
def _(f):
    return explore.ml_related(f.findings).select("finding_id", "rule_id", "category")


@query("p4_fixable")
def _(f):
    return explore.fixable(f.findings).select("finding_id", "rule_id")


@query("p5_bands")
def _(f):
    return f.audit.category_scores.select("repo_id", "category", "score_tenths", "band")


@query("p6_snippets")
def _(f):
    ranges = f.findings.filter("line_no is not null").select(
        "repo_id", "path", "finding_id", F.col("line_no").alias("start_line"),
        (F.col("line_no") + 2).alias("end_line"))
    return explore.snippets(ranges, f.files).select("finding_id", "start_line", "end_line", "snippet")


@query("p6b_badges")
def _(f):
    return explore.badges(f.cards)


@query("v1_range_checks")
def _(f):
    return explore.range_checks(f.findings, f.cards)


# --------------------------------------------------------------------- joins
@query("j1_files_present")
def _(f):
    return src.repos_having(f.files, MANIFESTS)


@query("j1_files_absent")
def _(f):
    return src.repos_lacking(f.files, LICENSES)


@query("j2_missing_init")
def _(f):
    return structure.missing_init(f.files).select("repo_id", F.col("hit.path").alias("path"))


def _import_rows(f):
    return plan.scan_files(f.files, ["ARCH-CIRC"])


@query("j3_import_edges")
def _(f):
    return structure.import_edges(_import_rows(f), f.files)


@query("j4_mutual_imports")
def _(f):
    return structure.mutual_pairs(structure.import_edges(_import_rows(f), f.files))


@query("j5_fits_above_splits")
def _(f):
    scoped = facts.extract_facts(src.python_files(f.files), ("scopes",), [])
    return scoped.select("repo_id", "path", F.inline(early_fits())).drop("scope_id")


@query("j6_requirement_pins")
def _(f):
    found = plan.findings(f.files, ["DEP-UNPIN", "DEP-DEPR"])
    return found.select(
        "repo_id", "line_no", F.col("metadata")["pkg_name"].alias("pkg"),
        F.coalesce(F.col("metadata")["pinned"], F.col("metadata")["replacement"]).alias("pin"))


@query("j7_secret_lines")
def _(f):
    found = plan.findings(f.files, ["SEC-SECRET"])
    return found.select("repo_id", "path", "line_no", F.col("metadata")["pattern"].alias("pattern"))


@query("j8_proposals")
def _(f):
    return f.repair.accepted.select("finding_id", "repo_id", "path", "root_cause")


@query("j9_patch_results")
def _(f):
    results = f.repair.results.select(F.col("patch_id").alias("finding_id"), "overall_status")
    return f.repair.patches.select("finding_id", "description").join(results, "finding_id")


@query("j10_selected_patches")
def _(f):
    even = F.instr(F.lit("02468ace"), F.right(F.col("finding_id"), F.lit(1))) > 0
    chosen = f.repair.patches.filter(even).select(F.col("finding_id").alias("patch_id"))
    return verdict.applied_files(f.repair.applied, chosen)


@query("j11_compare_scores")
def _(f):
    return explore.compare_scans(f.cards, f.repair.after.scorecards)


@query("j11_compare_findings")
def _(f):
    return explore.compare_findings(f.findings, f.repair.after.findings)


@query("j11_changed_files")
def _(f):
    return explore.rewritten_files(f.files, f.repair.repaired)


@query("j11_rescan_versions")
def _(f):
    """What the scan after the repair wrote, and how many rows each version has."""
    table = f.repair.versions

    def counted(number):
        rows = table.read(number).groupBy("repo_id").agg(F.count(F.lit(1)).alias("rows_read"))
        written = table.rows(number).groupBy("repo_id").agg(F.count(F.lit(1)).alias("rows_written"))
        return rows.join(written, "repo_id", "left").fillna(0, ["rows_written"]).withColumn("version", F.lit(number))

    return counted(0).unionByName(counted(1))


@query("j11_version_changes")
def _(f):
    return f.repair.versions.changes(1)


# -------------------------------------------------------------- aggregations
@query("a1_category_counts")
def _(f):
    return f.audit.category_scores.select("repo_id", "category", "ord", "issue_count")


@query("a2_category_scores")
def _(f):
    return f.audit.category_scores.select("repo_id", "category", "score")


@query("a3_category_words")
def _(f):
    return f.audit.category_scores.select("repo_id", "category", "summary")


@query("a4_overall")
def _(f):
    return f.cards.select("repo_id", "overall_tenths", "overall_score")


@query("a5_severity_counts")
def _(f):
    totals = f.cards.select("repo_id", *[f"{c}_issues" for c in ("total", "critical", "high", "medium", "low")])
    crit = f.audit.category_scores.groupBy("repo_id").agg(F.sum("critical_count").alias("critical_by_category"))
    return totals.join(crit, "repo_id")


@query("a6_grades")
def _(f):
    return f.cards.select("repo_id", "grade")


@query("a7_score_map")
def _(f):
    return f.cards.select("repo_id", F.explode("category_scores").alias("category", "score"))


@query("a7_radar")
def _(f):
    return scoring.radar(f.cards)


@query("a8_summaries")
def _(f):
    return f.audit.summaries


@query("a9_test_ratio")
def _(f):
    return plan.repo_rows(plan.scan_files(f.files, ["TEST-LOWRATIO"])).select(
        "repo_id", "test_files", "test_loc", "source_loc")


@query("a10_docstring_coverage")
def _(f):
    return scoring.coverage(f.audit.repos)


@query("a10_typing_coverage")
def _(f):
    defs = facts.fact_view(facts.extract_facts(src.python_files(f.files), ("defs",)), "defs")
    public = defs.filter((F.col("kind") != "class") & ~F.col("name").startswith("_"))
    return public.groupBy("repo_id", "path").agg(
        F.count(F.lit(1)).alias("functions"), F.count_if(F.col("typed_args") | F.col("typed_return")).alias("typed"))


@query("a11_directories")
def _(f):
    return src.python_files(f.files).select(
        "repo_id", tx.dir_name(F.col("path")).alias("dir")).filter("dir <> ''").distinct()


@query("a12_import_flags")
def _(f):
    imports = facts.extract_facts(src.python_files(f.files), ("imports",)).filter(F.size("imports") > 0)
    return imports.select(
        "repo_id", "path", imports_mention([SPLIT_CALL]).alias("splits"), imports_mention(CV_WORDS).alias("cv"),
        imports_mention(CLASSIFIERS).alias("classifier"), imports_mention(ACCURACY_WORDS).alias("accuracy"),
        imports_mention(ROBUST_METRICS).alias("robust"))


@query("a13_verdict_counts")
def _(f):
    return verdict.verdict_counts(f.repair.applied)


# ------------------------------------------------------------ windows, top-k
@query("w1_versions")
def _(f):
    return timeline.timeline(f.snapshots).select("repo_id", "snapshot_id", "version")


@query("w2_changes")
def _(f):
    return timeline.timeline(f.snapshots).select(
        "repo_id", "snapshot_id", "previous_tenths", "delta_tenths", "description")


@query("w3_trajectory")
def _(f):
    return timeline.trajectory(f.snapshots)


@query("w4_numbering")
def _(f):
    return report.numbered_urgent(f.findings).select("repo_id", "item_no", "finding_id")


@query("w5_source_lines")
def _(f):
    return src.source_lines(f.files)


@query("t1_timeline_order")
def _(f):
    return timeline.in_order(f.snapshots).select("repo_id", "snapshot_id", "ts", "overall_tenths")


@query("t2_first_findings")
def _(f):
    return explore.first_findings(f.findings).select("repo_id", "rank", "finding_id")


@query("t3_first_urgent")
def _(f):
    first = scoring.first_findings(f.findings)
    return first.select(
        "repo_id", F.col("first_critical.finding_id").alias("critical_id"),
        F.col("first_high.finding_id").alias("high_id"))


@query("t4_first_from_line")
def _(f):
    return plan.scan_files(f.files, ["DEPLOY-DOCKER-LATEST"]).filter("docker_from is not null").select(
        "repo_id", "path", "docker_from")


@query("t5_truncation")
def _(f):
    return f.files.select("repo_id", "path", F.substring("content", 1, 100).alias("head"))


# ------------------------------------------------------------ set operations
@query("u1_all_findings")
def _(f):
    return f.findings.select(*FINDING_COLUMNS)


@query("u2_introduced")
def _(f):
    return f.trial_decisions.select(
        "finding_id", F.array_join("blocked_imports", ",").alias("modules"),
        F.size("ast_vulnerabilities").alias("n_vulnerabilities"))


@query("u3_missing_items")
def _(f):
    note = f.files.filter(F.col("path") == ".gitignore")
    return note.select("repo_id", F.array_join(
        tx.missing_items(F.col("content"), [".env", "__pycache__", ".venv"]), ", ").alias("missing"))


@query("u4_test_split")
def _(f):
    return src.python_files(f.files).select("repo_id", "path", is_test_path(F.col("path")).alias("is_test"))


# ------------------------------------------------------------------- repairs
def _edit_query(*rules):
    def build(f):
        edits = repair.line_edits(f.repair.patches.filter(F.col("rule_id").isin(*rules)))
        return edits.select("repo_id", "path", "finding_id", "line_no", "op", "new_text")

    return build


@query("r1_created_files")
def _(f):
    made = repair.create_patches(f.findings, f.audit.repos)
    return made.select("repo_id", "path", "finding_id", "description", "replacement_code")


for _name, _rules in {
    "r2_requirements": ("DEP-UNPIN", "DEP-DEPR"), "r3_fit_below_split": ("ML-LEAK-PREFIT",),
    "r4_random_state": ("ML-VAL-NOSEED",), "r5_stratify": ("ML-MET-NOSTRAT",),
    "r6_exception_log": ("QUAL-EXC",), "r7_mutable_default": ("QUAL-MUT",),
    "r8_safe_load": ("SEC-YAML",), "r9_literal_eval": ("SEC-EXEC",),
}.items():
    query(_name)(_edit_query(*_rules))


@query("r10_dispatch")
def _(f):
    made = f.repair.patches.select("finding_id").withColumn("has_patch", F.lit(True))
    wanted = explore.fixable(f.findings).join(F.broadcast(repair.fix_dim(f.spark)), "rule_id")
    return wanted.join(made, "finding_id", "left").select(
        "finding_id", "rule_id", "edit", F.coalesce("has_patch", F.lit(False)).alias("has_patch"))


@query("r11_proposal_override")
def _(f):
    return f.repair.patches.filter(F.col("description").startswith("Proposed")).select(
        "finding_id", "path", "description", F.md5("replacement_code").alias("digest"))


@query("r12_rebuilt_files")
def _(f):
    return f.repair.repaired.select("repo_id", "path", F.md5("content").alias("digest"))


@query("r12_superseded")
def _(f):
    """One mutable default of each file gets a whole-file proposal, which leaves out the edit of the other."""
    chosen = f.findings.filter("rule_id = 'QUAL-MUT'").groupBy("repo_id", "path").agg(
        F.min("finding_id").alias("finding_id"))
    proposals = chosen.select(
        "finding_id", F.lit("Shared between calls.").alias("root_cause"), F.lit("x = 1\n").alias("replacement_code"),
        F.lit(True).alias("safe_to_apply"), F.lit(0.9).alias("confidence"))
    return Repair(f.audit, corpus.test_runs, proposals).superseded


# ------------------------------------------------------------------ verdicts
@query("g1_path_check")
def _(f):
    return f.trials.select("finding_id", "path", verdict.unsafe_path(F.col("path")).alias("unsafe"))


@query("g2_size_check")
def _(f):
    old, new = tx.count_lines(F.col("original_code")), tx.count_lines(F.col("replacement_code"))
    return f.trials.select(
        "finding_id", old.alias("old_lines"), new.alias("new_lines"),
        verdict.grows_too_much(old, new).alias("expands"), (new - old > 250).alias("adds_too_much"))


@query("g3_parse_check")
def _(f):
    return verdict.patch_features(f.trials).select("finding_id", "parse_ok", "compile_ok")


@query("g4_features")
def _(f):
    return verdict.patch_features(f.trials).select(
        "finding_id", *[F.array_join(c, ",").alias(c) for c in (
            "old_modules", "old_calls", "new_modules", "new_calls")])


@query("g5_decisions")
def _(f):
    return f.trial_decisions.select(
        "finding_id", "passed", F.size("reasons").alias("n_reasons"),
        F.array_join("ast_vulnerabilities", "; ").alias("vulnerabilities"), "diff_line_change")


@query("g6_test_counts")
def _(f):
    return verdict.test_counts(corpus.test_runs(f.trials)).select(
        "finding_id", "phase", "passed", "failed", "errors", "success")


def _flat_results(results):
    return results.select(
        "patch_id", "path", "overall_status", "syntax_check", "import_check", "tests_passed_before",
        "tests_failed_before", "tests_passed_after", "tests_failed_after", "confidence",
        F.array_join(F.transform("steps", lambda s: F.concat(s["name"], F.lit("="), s.status)), ";").alias("steps"))


@query("g7_trial_verdicts")
def _(f):
    return _flat_results(verdict.verdicts(f.trial_decisions, corpus.test_runs(f.trials)))


@query("g7_verdicts")
def _(f):
    return _flat_results(f.repair.results)


@query("g8_compile_report")
def _(f):
    return verdict.compile_report(
        facts.extract_facts(src.python_files(f.files), (), compiled=True))


# ---------------------------------------------------------------- user rules
def _own_rules():
    """Files of over 20 lines with a print call; repositories with more test than source lines."""
    prints = UserRule(
        "OWN-PRINT", "Code Quality", facts=frozenset({"calls"}), calls=frozenset({"print"}), confidence_pct=70,
        risk="Prints {x} times.", advice="Use a logger.",
        hits=lambda: F.when(F.exists("calls", lambda c: c.func_name == "print"), F.array(hit(
            "OWN-PRINT", "LOW", "Print Call",
            detail=F.size(F.filter("calls", lambda c: c.func_name == "print")).cast("string")))))
    untested = UserRule(
        "OWN-TESTHEAVY", "Testing", level="repo", confidence_pct=60, risk="More tests than code.", advice="Check the code.",
        hits=lambda: F.when(F.col("test_files") >= 1, F.array(hit(
            "OWN-TESTHEAVY", "MEDIUM", "Has Tests", path=F.col("first_test")))))
    return [prints, untested]


def _own_audit(f):
    return plan.Audit(f.files, rules=("TEST-NOTESTS", *_own_rules()))


@query("u5_user_rules")
def _(f):
    return _own_audit(f).findings.select("rule_id", "repo_id", "category", "severity", "path", "confidence", "risk_explanation")


@query("u5_user_rule_scores")
def _(f):
    return _own_audit(f).category_scores.select("repo_id", "category", "issue_count")


# -------------------------------------------------------- rules turned to data
@query("d1_contamination")
def _(f):
    return mldata.contamination(f.table("documents"), f.table("benchmark"))


@query("d2_hash_split")
def _(f):
    return mldata.hash_split(f.table("documents").select("doc_id"), "doc_id")


@query("d3_stratified_split")
def _(f):
    return mldata.stratified_split(f.table("labels"), "doc_id", ["quality", "toxic"])


@query("d3_share_drift")
def _(f):
    split = mldata.stratified_split(f.table("labels"), "doc_id", ["quality", "toxic"])
    return mldata.share_drift(split, ["quality", "toxic"])


@query("d4_standardised")
def _(f):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    return mldata.standardised(f.table("lineitem"), ["l_orderkey", "l_linenumber"], "l_orderkey", columns).withColumn(
        "z", F.round("z", 6))


@query("d5_folds")
def _(f):
    return mldata.folds(f.table("labels").select("doc_id"), "doc_id", 5)


@query("d6_class_metrics")
def _(f):
    return mldata.class_metrics(f.table("labels"), 1 - F.col("quality"), F.col("toxic"), [0, 1])


@query("d7_text_secrets")
def _(f):
    return mldata.text_secrets(f.table("documents"), {"Quoted Token": r'token = "[0-9a-f]{40}"'})


# ---------------------------------------------------------- scalar functions
@query("f1_split_lines")
def _(f):
    lines = tx.split_lines(F.col("text"))
    return f.table("documents").select(
        "doc_id", F.size(lines).alias("n_lines"), tx.count_lines(F.col("text")).alias("counted"),
        F.try_element_at(lines, F.lit(1)).alias("first_line"), F.try_element_at(lines, F.lit(-1)).alias("last_line"))


@query("f2_text")
def _(f):
    text = F.col("text")
    return f.table("documents").select(
        "doc_id", F.length(tx.strip(text)).alias("stripped"), F.contains(F.lower(text), F.lit("the ")).alias("has_the"),
        text.startswith("A").alias("starts"), text.endswith(".").alias("ends"),
        F.length(F.replace(text, F.lit("e"), F.lit(""))).alias("without_e"))


@query("f3_regex")
def _(f):
    text = F.col("text")
    return f.table("documents").select(
        "doc_id", text.rlike(r"[0-9]{3,}").alias("has_number"),
        F.regexp_extract(text, r"([A-Z][a-z]+) ([a-z]+)", 2).alias("second_word"),
        F.length(F.regexp_replace(text, r"[0-9]+", "#")).alias("masked_length"))


@query("f4_paths")
def _(f):
    path = F.col("path")
    return f.files.select(
        "repo_id", "path", tx.dir_name(path).alias("dir"), tx.stem(path).alias("stem"),
        tx.suffix(path).alias("suffix"), tx.first_segment(F.replace(path, F.lit("/"), F.lit("."))).alias("first"))


@query("f5_numbers")
def _(f):
    n = F.col("event_id").cast("bigint")
    return f.table("events").select(
        "event_id", tx.clamp(F.floor("value").cast("bigint"), 10, 100).alias("clamped"),
        tx.percent_text(n % 97, 1 + n % 89).alias("share"), tx.tenths_text(n % 200 - 100).alias("tenths"))


@query("f6_json")
def _(f):
    value = F.to_json(F.create_map(F.lit("a"), F.col("event_id") % 7, F.lit("b"), F.col("event_id") % 3))
    return f.table("events").select(
        "event_id", value.alias("encoded"),
        F.from_json(value, "map<string,bigint>")["b"].alias("decoded_b"))


@query("f7_time")
def _(f):
    ts = F.col("ts").cast("timestamp")
    return f.table("events").select(
        "event_id", F.date_format(ts, "yyyy-MM-dd HH:mm").alias("minute"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("iso"))


@query("f8_ids")
def _(f):
    return f.table("documents").select(
        "doc_id", tx.stable_id(F.lit("DOC"), F.col("doc_id").cast("string"), F.col("text")).alias("id"))


@query("f9_name_lists")
def _(f):
    return f.table("documents").select("doc_id", tx.tidy_join(F.array("source", "lang")).alias("names"))


@query("f10_last_paren")
def _(f):
    lines = f.table("documents").select("doc_id", F.posexplode(tx.split_lines(F.col("text"))).alias("pos", "line"))
    return lines.filter(F.contains("line", F.lit(")"))).select(
        "doc_id", "pos", F.regexp_extract("line", r"^.*\)([^)]*)$", 1).alias("tail"))


# ----------------------------------------------------------------- streaming
@query("st1_scan_arrivals")
def _(f):
    landing, out = scratch_path(f.spark, "landing"), scratch_path(f.spark, "stream")
    checkpoint = scratch_path(f.spark, "cp")
    third = F.pmod(F.xxhash64("repo_id", "path"), F.lit(3))
    for part in range(3):  # files of one repository arrive in several batches
        f.files.filter(third == part).write.mode("append").parquet(landing)
        arrivals.start_scan(f.spark, landing, out, checkpoint).awaitTermination()
    return arrivals.current_findings(f.spark, out).select(*FINDING_COLUMNS)


def _recorded(f, *parts) -> str:
    """The log after events landed in several batches."""
    landing, log, checkpoint = (scratch_path(f.spark, n) for n in ("events", "log", "cp"))
    for part in parts:
        part.write.mode("append").parquet(landing)
        stream = snapshots.read_event_stream(f.spark, landing)
        snapshots.start_recording(stream, log, checkpoint).awaitTermination()
    return log


@query("st2_snapshot_stream")
def _(f):
    kept = snapshots.recorded(f.spark, _recorded(f, f.table("events")))
    return timeline.timeline(kept.drop("copies", "outcome", "batch_id")).select(
        "repo_id", "snapshot_id", "version", "description")


@query("st2_late_rows")
def _(f):
    """A tenth of the events lands after all others; what is a day or more behind then comes out as late."""
    events, later = f.table("events"), F.col("event_id") % 10 == 0
    log = _recorded(f, events.filter(~later), events.filter(later))
    return snapshots.recorded(f.spark, log, "late").select("repo_id", "snapshot_id")


@query("st2_outcomes")
def _(f):
    """As before, then a seventh of the events twice more: kept, late and repeated rows are all that arrived."""
    events, later, again = f.table("events"), F.col("event_id") % 10 == 0, F.col("event_id") % 7 == 1
    log = _recorded(f, events.filter(~later), events.filter(later), events.filter(again).unionByName(events.filter(again)))
    return reduce(DataFrame.unionByName, [snapshots.recorded(f.spark, log, o) for o in snapshots.OUTCOMES]).select(
        "repo_id", "snapshot_id", "batch_id", "outcome", "copies")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecards of the whole fleet."""
    return fleet(spark, sf_dir).cards.select(
        "repo_id", "repo_name", "overall_score", "grade", "total_issues", "critical_issues", "high_issues",
        "medium_issues", "low_issues")

