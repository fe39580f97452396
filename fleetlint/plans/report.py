"""Reports and exports in long form.

A report is a table of lines ``(repo_id, section, ord, place, sub, text)``.
Nothing is gathered per repository: one that holds a third of all findings is
simply many rows, and its file parts are written by many tasks in order. Only
the findings to fix first carry numbers; other lists are in the order of a
text key, so nothing is numbered for them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.model import FINDING_ORDER
from fleetlint.operators import explore
from fleetlint.operators.scoring import band, category_scores
from fleetlint.operators.sequence import number_rows

LINE_ORDER = ["repo_id", "section", "ord", "place", "sub"]
LINE_SCHEMA = "repo_id bigint, section int, ord bigint, place string, sub int, text string"
TOP, SCORES, FIRST, LEARNING, PATCHES, HISTORY = range(6)


def _lines(df: DataFrame, section: int, texts: list[Column], order: Column | int = 0, place: Column | str = "") -> DataFrame:
    """A row's text lines; null lines are left out."""
    present = F.filter(F.array(*texts), lambda x: x.isNotNull())
    as_column = [x if isinstance(x, Column) else F.lit(x) for x in (order, place)]
    return df.select(
        "repo_id", F.lit(section).alias("section"), as_column[0].cast("bigint").alias("ord"),
        as_column[1].alias("place"), F.posexplode(present).alias("sub", "text"))


def _headed(body: DataFrame, section: int, title: str) -> DataFrame:
    """A section with its title in front, once for each repository that has lines in it."""
    title_lines = _lines(body.select("repo_id").distinct(), section, [F.lit(""), F.lit(f"## {title}"), F.lit("")], -1)
    return title_lines.unionByName(body)


def _say(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _sure(confidence: Column) -> Column:
    return F.floor(F.round(confidence * 100, 6))


def _indented(text: Column) -> Column:
    return F.concat(F.lit("       "), F.replace(text, F.lit("\n"), F.lit("\n       ")))


def numbered_urgent(findings: DataFrame) -> DataFrame:
    """Critical and high findings, numbered from 1 per repository."""
    return number_rows(explore.urgent(findings), ["repo_id"], FINDING_ORDER, seq="item_no")


def top_lines(cards: DataFrame, summaries: DataFrame, repos: DataFrame, scanned_at: datetime) -> DataFrame:
    c = cards.join(summaries.select("repo_id", "summary"), "repo_id").join(
        repos.select("repo_id", "total_files", "python_files", "total_loc"), "repo_id")
    return _lines(c, TOP, [
        _say("# Audit of ", F.col("repo_name")),
        F.lit(f"Scanned on {scanned_at:%Y-%m-%d} at {scanned_at:%H:%M} UTC."),
        _say(F.col("total_files"), " files, ", F.col("python_files"), " of them Python; ", F.col("total_loc"), " lines."),
        F.lit(""), F.col("summary"),
    ])


def score_lines(cards: DataFrame) -> DataFrame:
    critical = F.when(F.col("critical_count") > 0, _say(", ", F.col("critical_count"), " critical")).otherwise("")
    each = _lines(category_scores(cards), SCORES, [_say(
        "- ", F.col("category"), ": ", tx.tenths_text(F.col("score_tenths")), " (", band(F.col("score_tenths")), "), ",
        F.col("issue_count"), " findings", critical, ". ", F.col("summary"), "."
    )], F.col("ord"))
    whole = _lines(cards, SCORES, [_say(
        "- Together: ", tx.tenths_text(F.col("overall_tenths")), ", grade ", F.col("grade"), ", ", F.col("total_issues"),
        " findings, ", F.col("critical_issues"), " critical")], 99)
    return _headed(each.unionByName(whole), SCORES, "Scores")


def urgent_lines(findings: DataFrame) -> DataFrame:
    line = F.coalesce(_say(":", F.col("line_no")), F.lit(""))
    code = F.when(F.coalesce("code_snippet", F.lit("")) != "", _indented(F.col("code_snippet")))
    body = _lines(numbered_urgent(findings), FIRST, [
        _say(F.col("item_no"), ". ", F.col("title"), " (", F.lower("severity"), ", ", F.col("category"), ")"),
        _say("   in ", F.col("path"), line, ", ", _sure(F.col("confidence")), " in 100 sure"),
        code,
        _say("   ", F.col("risk_explanation")),
        _say("   To do: ", F.col("recommendation")),
    ], F.col("item_no"))
    return _headed(body, FIRST, "To fix first")


def ml_lines(findings: DataFrame) -> DataFrame:
    place = F.concat_ws("\t", F.lpad(F.col("analyzer_ord").cast("string"), 3, "0"), "path",
                        F.lpad(F.coalesce("line_no", F.lit(0)).cast("string"), 9, "0"), "rule_id", "finding_id")
    body = _lines(explore.ml_related(findings), LEARNING, [
        _say("- ", F.col("path"), ": ", F.col("title")),
        _say("  ", F.col("risk_explanation"), " ", F.col("recommendation")),
    ], place=place)
    return _headed(body, LEARNING, "Learning code")


def validation_lines(results: DataFrame) -> DataFrame:
    def tests(phase):
        return _say(F.col(f"tests_passed_{phase}"), " passed and ", F.col(f"tests_failed_{phase}"), f" failed {phase}")

    verified = F.when(F.col("overall_status") == "PASSED", "verified").otherwise("rejected")
    syntax = F.when(F.col("syntax_check"), "compiles").otherwise("does not compile")
    body = _lines(results, PATCHES, [
        _say("- ", F.col("path"), ": ", verified, ", ", syntax, ", tests ", tests("before"), ", ", tests("after"), " (",
             F.col("patch_id"), ", ", _sure(F.col("confidence")), " in 100 sure)"),
    ], place=F.col("patch_id"))
    return _headed(body, PATCHES, "Checked patches")


def timeline_lines(entries: DataFrame) -> DataFrame:
    """``entries`` as made by ``operators.timeline.timeline``."""
    body = _lines(entries, HISTORY, [
        _say("- ", F.col("version"), " of ", F.date_format("ts", "yyyy-MM-dd HH:mm"), ": ",
             tx.tenths_text(F.col("overall_tenths")), " with ", F.col("total_issues"), " findings, ", F.col("fixes_applied"),
             " fixes applied. ", F.col("description")),
    ], F.col("version_no"))
    return _headed(body, HISTORY, "History")


def report_lines(audit, results: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """All lines of the reports of a fleet."""
    out = (
        top_lines(audit.scorecards, audit.summaries, audit.repos, audit.scanned_at)
        .unionByName(score_lines(audit.scorecards))
        .unionByName(urgent_lines(audit.findings))
        .unionByName(ml_lines(audit.findings))
    )
    if results is not None:
        out = out.unionByName(validation_lines(results))
    if entries is not None:
        out = out.unionByName(timeline_lines(entries))
    return out


def _write_ordered(rows: DataFrame, path: str, order: list[str], buckets: int) -> None:
    """Rows in order, in ``buckets`` folders by hash of the repository, which stays a column.

    A folder per repository would be millions of tiny files; the hash lets a
    reader of one repository open a single folder. JSON repeats its names in
    every row, so the files are compressed.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = rows.withColumn("bucket", _bucket(F.col("repo_id"), buckets))
    keys = ["bucket", *order]
    (bucketed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
     .write.option("maxRecordsPerFile", 1_000_000).partitionBy("bucket").json(path, compression="gzip"))


def _bucket(repo_id, buckets: int):
    return F.pmod(F.xxhash64(repo_id.cast("bigint")), F.lit(buckets)).cast("int")


def write_reports(lines: DataFrame, path: str, buckets: int = 64) -> None:
    """The lines of all reports as JSON rows; see ``read_report``."""
    _write_ordered(lines.select(*LINE_ORDER, "text"), path, LINE_ORDER, buckets)


def read_reports(spark, path: str) -> DataFrame:
    """The written lines of all reports."""
    return spark.read.schema(LINE_SCHEMA + ", bucket int").json(path).drop("bucket")


def read_report(spark, path: str, repo_id: int, buckets: int = 64) -> DataFrame:
    """The lines of one repository's report, in order; only its folder is read."""
    key = F.lit(repo_id)
    rows = spark.read.schema(LINE_SCHEMA + ", bucket int").json(path).filter(
        (F.col("bucket") == _bucket(key, buckets)) & (F.col("repo_id") == key))
    return rows.orderBy(*LINE_ORDER).select("text")


def diagnosis_records(
    audit, results: DataFrame | None = None, patches: DataFrame | None = None, entries: DataFrame | None = None
) -> DataFrame:
    """The whole diagnosis as JSON records ``(repo_id, section, key, json)``: scorecard, findings and,
    where given, validation results, patches (with their edits) and the timeline."""
    cards = audit.scorecards.join(audit.summaries.select("repo_id", "summary"), "repo_id").join(
        audit.repos.select("repo_id", "total_files", "python_files", "total_loc"), "repo_id")

    def records(df, section, key):
        columns = [c for c in df.columns if c != "repo_id"]
        return df.select(
            "repo_id", F.lit(section).alias("section"), F.col(key).cast("string").alias("key"),
            F.to_json(F.struct(*columns)).alias("json"))

    out = records(cards, "scorecard", "repo_name").unionByName(
        records(audit.findings, "finding", "finding_id"))
    if results is not None:
        out = out.unionByName(records(results, "validation", "patch_id"))
    if patches is not None:
        out = out.unionByName(records(patches, "patch", "finding_id"))
    if entries is not None:
        out = out.unionByName(records(entries, "timeline", "version"))
    return out


def write_diagnosis(records: DataFrame, path: str, buckets: int = 64) -> None:
    """The records as JSON rows ``repo_id, section, key, json`` in folders by hash of the repository."""
    _write_ordered(records, path, ["repo_id", "section", "key"], buckets)


def read_diagnosis(spark, path: str, section: str | None = None) -> DataFrame:
    """The written records, of one section if it is named."""
    rows = spark.read.schema("repo_id bigint, section string, key string, json string, bucket int").json(path).drop("bucket")
    return rows if section is None else rows.filter(F.col("section") == section)
