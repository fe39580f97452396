"""Filters, lookups and checks on findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.functions.arrays import let
from fleetlint.model import FINDING_ORDER, SEVERITIES
from fleetlint.operators.scoring import band
from fleetlint.operators.sequence import first_rows


def search(findings: DataFrame, severities=None, categories=None, text: str = "") -> DataFrame:
    """Severity and category in the given sets, text found in title, path or risk."""
    out = findings
    if severities is not None:
        out = out.filter(F.col("severity").isin(*severities))
    if categories is not None:
        out = out.filter(F.col("category").isin(*categories))
    needle = F.lit(text.lower())
    found = F.contains(F.lower("title"), needle)
    for column in ("path", "risk_explanation"):
        found = found | F.contains(F.lower(column), needle)
    return out.filter(found)


def urgent(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("severity").isin(*SEVERITIES[:2]))


def ml_related(findings: DataFrame) -> DataFrame:
    return findings.filter((F.col("category") == "ML Engineering") | F.col("rule_id").startswith("ML-"))


def fixable(findings: DataFrame) -> DataFrame:
    return findings.filter("auto_fixable")


def first_findings(findings: DataFrame, n: int = 6) -> DataFrame:
    return first_rows(findings, ["repo_id"], FINDING_ORDER, n)


def badges(cards: DataFrame) -> DataFrame:
    """Badge text and image link per repository."""
    score = tx.tenths_text(F.col("overall_tenths"))
    colour = F.when(band(F.col("overall_tenths")) == "green", "brightgreen").otherwise(band(F.col("overall_tenths")))
    link = F.concat(F.lit("https://img.shields.io/badge/health-"), score, F.lit("%2F10-"), colour)
    return cards.select(
        "repo_id", score.alias("score_text"), colour.alias("colour"),
        F.concat(F.lit("![Health Score]("), link, F.lit(")")).alias("badge"),
    )


def snippets(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """Text of line ranges ``(repo_id, path, start_line, end_line)``, clamped to the file.

    The ranges of a file are gathered, sorted (a file's findings are bounded by
    its size), and brought to its row, so that a text is read and split once,
    in the pass that scans it; only ranges and snippets are ever copied.
    Ranges may overlap.
    """
    last = F.coalesce("end_line", "start_line")
    others = [c for c in ranges.columns if c not in ("repo_id", "path")]
    wanted = ranges.groupBy("repo_id", "path").agg(
        F.sort_array(F.collect_list(F.struct("start_line", last.alias("last_line"), F.struct(*others).alias("row")))).alias("ranges"))

    def cut(r, lines):
        end = F.least(r.last_line, F.size(lines))
        text = F.when(
            (r.start_line >= 1) & (r.start_line <= F.size(lines)),
            F.array_join(F.slice(lines, r.start_line, F.greatest(end - r.start_line + 1, F.lit(0))), "\n")).otherwise("")
        return F.struct(r.row.alias("row"), text.alias("snippet"))

    cuts = let(tx.split_lines(F.col("content")), lambda lines: F.transform("ranges", lambda r: cut(r, lines)))
    # The few ranges are the side that moves or is broadcast, by its size.
    found = files.select("repo_id", "path", "content").join(wanted, ["repo_id", "path"]).select(
        "repo_id", "path", F.explode_outer(cuts).alias("cut"))
    return found.select(
        *[F.col(c) if c in ("repo_id", "path") else F.col(f"cut.row.{c}").alias(c) for c in ranges.columns],
        F.coalesce("cut.snippet", F.lit("")).alias("snippet"))


def range_checks(findings: DataFrame, cards: DataFrame) -> DataFrame:
    """Values outside their allowed range, counted per check."""
    conf = F.col("confidence")
    of_findings = findings.agg(
        F.count(F.lit(1)).alias("rows_checked"), F.count_if(~conf.between(0, 1)).alias("violations")
    ).withColumn("check_name", F.lit("finding.confidence"))
    overall = cards.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.count_if(~F.col("overall_tenths").between(0, 100)).alias("violations"),
    ).withColumn("check_name", F.lit("scorecard.overall"))
    scores = F.transform("categories", lambda c: c.score_tenths)
    by_category = cards.agg(
        F.sum(F.size(scores)).alias("rows_checked"),
        F.sum(F.size(F.filter(scores, lambda s: ~s.between(0, 100)))).alias("violations"),
    ).withColumn("check_name", F.lit("category.score"))
    return of_findings.unionByName(overall).unionByName(by_category)


def compare_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Resolved, new and remaining findings of two scans."""
    b = before.select("finding_id", F.col("repo_id").alias("repo_b"), F.col("rule_id").alias("rule_b"))
    a = after.select("finding_id", F.col("repo_id").alias("repo_a"), F.col("rule_id").alias("rule_a"))
    state = (
        F.when(F.col("repo_a").isNull(), "resolved").when(F.col("repo_b").isNull(), "new").otherwise("remaining")
    )
    return b.join(a, "finding_id", "full_outer").select(
        "finding_id", F.coalesce("repo_b", "repo_a").alias("repo_id"),
        F.coalesce("rule_b", "rule_a").alias("rule_id"), state.alias("state"),
    )


def compare_scans(before_cards: DataFrame, after_cards: DataFrame) -> DataFrame:
    """Scores and finding counts of two scans side by side."""

    def side(cards, tag):
        return cards.select(
            "repo_id", F.col("overall_tenths").alias(f"score_{tag}"), F.col("total_issues").alias(f"issues_{tag}")
        )

    both = side(before_cards, "before").join(side(after_cards, "after"), "repo_id", "full_outer")
    return both.withColumns({
        "score_change": F.col("score_after") - F.col("score_before"),
        "issue_change": F.col("issues_after") - F.col("issues_before"),
    })


def _digest(tag: str) -> list:
    """Length and hash of a file's text; only these take part in a comparison."""
    return [F.struct(F.octet_length("content").alias("size"), F.xxhash64("content").alias("hash")).alias(tag)]


def rewritten_files(before: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Which of the rewritten files are new and which replace another text.

    Texts are hashed where they are read; only keys and digests are shuffled.
    """
    keys = ["repo_id", "path"]
    new = rewritten.select(*keys, *_digest("after"))
    old = before.select(*keys, *_digest("before"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("before") != F.col("after"), "modified")
    return new.join(old, keys, "left").select(*keys, change.alias("change")).filter("change is not null")


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files of two full scans added, removed or different, by content digest."""

    def side(files, tag):
        return files.select("repo_id", "path", *_digest(tag))

    both = side(before, "before").join(side(after, "after"), ["repo_id", "path"], "full_outer")
    change = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed")
        .when(F.col("before") != F.col("after"), "modified")
    )
    return both.select("repo_id", "path", change.alias("change")).filter("change is not null")
