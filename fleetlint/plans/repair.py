"""Scan, patch, judge, rebuild and scan again."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlint.operators import repair, verdict
from fleetlint.operators.versions import VersionedTable
from fleetlint.plans.audit import Audit, scan_files
from fleetlint.session import materialise
from fleetlint.sources.files import decode_files


def fixable_rows(files: DataFrame) -> DataFrame:
    """Scan of the rules that have a line fix, text kept where one applies."""
    kept = files.filter(F.col("is_python") | (F.col("path") == "requirements.txt"))
    return scan_files(kept, list(repair.LINE_FIXES), for_repair=True)


@dataclass
class Repair:
    """Tables of one repair run over an audited fleet.

    With ``Audit(for_repair=True)`` the texts to edit are in the scan already;
    otherwise the files are scanned once more, still without a join.
    """

    audit: Audit
    runs_of: object  # function: patch table -> recorded test runs
    proposals: DataFrame | None = None

    @cached_property
    def accepted(self) -> DataFrame | None:
        if self.proposals is None:
            return None
        return repair.accepted_proposals(self.proposals, self.audit.findings)

    @cached_property
    def rows(self) -> DataFrame:
        if self.audit.for_repair:
            return self.audit.scanned
        return materialise(fixable_rows(self.audit.files), "fixable")

    @cached_property
    def patched(self) -> DataFrame:
        """Files with the edits of their findings, written once: they feed gate, rebuild and report."""
        return materialise(repair.patched_files(self.rows), "patched")

    @cached_property
    def patches(self) -> DataFrame:
        """All candidate patches: edits of findings, and whole texts of new and proposed files."""
        built_in = repair.line_patches(self.patched).unionByName(
            repair.create_patches(self.audit.findings, self.audit.repos))
        if self.accepted is not None:
            proposed = repair.proposal_patches(self.accepted, self.audit.files)
            built_in = repair.override(built_in, proposed)
        return materialise(built_in, "patches")

    @cached_property
    def decisions(self) -> DataFrame:
        whole = repair.with_originals(self.patches.filter("replacement_code is not null"), self.audit.files)
        of_lines = verdict.edit_features(self.patched)
        if self.accepted is not None:
            kept = self.patches.filter("replacement_code is null").select("finding_id")
            of_lines = of_lines.join(kept, "finding_id", "left_semi").select(*of_lines.columns)
        return materialise(verdict.gate(verdict.patch_features(whole).unionByName(of_lines)), "decisions")

    @cached_property
    def results(self) -> DataFrame:
        runs = self.runs_of(self.patches.select("repo_id", "finding_id"))
        return verdict.verdicts(self.decisions, runs)

    @cached_property
    def superseded(self) -> DataFrame:
        """Verified patches that the rebuilt file does not hold, with the one it holds instead.

        A whole-file text replaces the line edits of its file and every later
        text for it.
        """
        whole = F.col("replacement_code").isNotNull().alias("whole")
        verified = self.patches.select("repo_id", "path", "finding_id", whole).join(
            verdict.passed_patches(self.results), "finding_id", "left_semi")
        winners = verified.filter("whole").groupBy("repo_id", "path").agg(F.min("finding_id").alias("superseded_by"))
        return materialise(
            verified.join(winners, ["repo_id", "path"]).filter("finding_id <> superseded_by").select(
                "repo_id", "path", "finding_id", "superseded_by"), "superseded")

    @cached_property
    def applied(self) -> DataFrame:
        """The results without superseded patches: what counts as applied."""
        gone = self.superseded.select(F.col("finding_id").alias("patch_id"))
        return self.results.join(gone, "patch_id", "left_anti").select(*self.results.columns)

    @cached_property
    def repaired(self) -> DataFrame:
        """New content of every file that a verified patch changes."""
        verified = self.patches.join(verdict.passed_patches(self.results), "finding_id", "left_semi")
        merged = repair.merged_files(self.patched, verified.filter("replacement_code is null"))
        # Whole-file texts: created files and proposals. Of several for one
        # file the first by finding wins, and it wins over line edits.
        whole = verified.filter("replacement_code is not null").groupBy("repo_id", "path").agg(
            F.min_by("replacement_code", "finding_id").alias("content"))
        lines_only = merged.join(whole.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
        return materialise(
            lines_only.select("repo_id", "path", "content").unionByName(whole), "repaired")

    @cached_property
    def repaired_files(self) -> DataFrame:
        """The changed files with all ``source_files`` columns."""
        # Written, so that the join is planned by their size: the texts stay where they are.
        names = materialise(self.audit.repos.select("repo_id", "repo_name").coalesce(1), "names")
        return decode_files(self.repaired.join(names, "repo_id").withColumn(
            "size_bytes", F.octet_length("content").cast("bigint")))

    @cached_property
    def files_after(self) -> DataFrame:
        """The whole fleet with the changed files in place."""
        untouched = self.audit.files.join(self.repaired.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
        return untouched.select(*self.audit.files.columns).unionByName(self.repaired_files)

    @cached_property
    def versions(self) -> VersionedTable:
        """The scan before the repair as version 0 and what the repair changed as version 1."""
        old = self.audit
        table = VersionedTable.over(old.scanned, ["repo_id", "path"])
        table.commit(scan_files(self.repaired_files, old.rules, old.scope_mode, old.for_repair))
        return table

    @cached_property
    def after(self) -> Audit:
        """Scan after the repair: only changed files are parsed and written, the
        rows of all others are read from the scan before."""
        old = self.audit
        later = Audit(self.files_after, old.rules, old.scope_mode, old.for_repair)
        later.scanned = self.versions.read()
        return later
