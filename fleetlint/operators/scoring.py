"""Scores, grades and summaries per repository; integer arithmetic throughout.

Category scores are tenths of a point, weights percent, so the weighted sum is
in thousandths and is rounded half-up to tenths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.model import CATEGORIES, CATEGORY_WEIGHTS, FINDING_ORDER, GRADES, deduction


def health_words(tenths: Column) -> Column:
    return (
        F.when(tenths >= 90, "Excellent health")
        .when(tenths >= 70, "Minor issues found")
        .otherwise("Needs immediate attention")
    )


def grade(tenths: Column) -> Column:
    out = F.when(tenths >= GRADES[0][0], GRADES[0][1])
    for cut, name in GRADES[1:]:
        out = out.when(tenths >= cut, name)
    return out.otherwise("F")


def band(tenths: Column) -> Column:
    return F.when(tenths >= 85, "green").when(tenths >= 65, "yellow").otherwise("red")


def round_thousandths(thousandths: Column) -> Column:
    return F.floor((thousandths + 50) / 100)


def tallies(findings: DataFrame) -> DataFrame:
    """Counts and deductions per repository and category, side by side.

    One shuffle on repo_id after partial sums, so a repository that holds a
    third of all findings costs one partial row per task.
    """
    cost = deduction(F.col("severity"))
    aggs = [F.count(F.lit(1)).alias("total_issues")]
    for name in ("CRITICAL", "HIGH", "MEDIUM", "LOW"):
        aggs.append(F.count_if(F.col("severity") == name).alias(f"{name.lower()}_issues"))
    for k, category in enumerate(CATEGORIES):
        mine = F.col("category") == category
        aggs += [
            F.sum(F.when(mine, cost).otherwise(0)).alias(f"cost_{k}"),
            F.count_if(mine).alias(f"n_{k}"),
            F.count_if(mine & (F.col("severity") == "CRITICAL")).alias(f"crit_{k}"),
        ]
    return findings.groupBy("repo_id").agg(*aggs)


def scorecards(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """One row per repository, all eight categories present in each."""
    counted = tallies(findings)
    wide = repos.select("repo_id", "repo_name").join(counted, "repo_id", "left").na.fill(
        0, [c for c in counted.columns if c != "repo_id"])
    scores = [tx.clamp(F.lit(100) - F.col(f"cost_{k}"), 10, 100) for k in range(len(CATEGORIES))]
    rows = []
    for k, (category, score) in enumerate(zip(CATEGORIES, scores)):
        rows.append(F.struct(
            F.lit(k + 1).alias("ord"),
            F.lit(category).alias("category"),
            score.cast("int").alias("score_tenths"),
            F.col(f"n_{k}").alias("issue_count"),
            F.col(f"crit_{k}").alias("critical_count"),
            health_words(score).alias("summary"),
        ))
    weighted = sum((s * w for s, w in zip(scores, CATEGORY_WEIGHTS.values())), F.lit(0))
    overall = tx.clamp(round_thousandths(weighted), 10, 100).cast("int")
    return (
        wide.withColumns({"overall_tenths": overall, "categories": F.array(*rows)})
        .select(
            "repo_id", "repo_name", "overall_tenths",
            (F.col("overall_tenths") / 10).alias("overall_score"),
            grade(F.col("overall_tenths")).alias("grade"),
            "total_issues", "critical_issues", "high_issues", "medium_issues", "low_issues",
            "categories",
            F.map_from_arrays(
                F.array(*[F.lit(c) for c in CATEGORIES]), F.array(*[s / 10 for s in scores])
            ).alias("category_scores"),
        )
    )


def category_scores(cards: DataFrame) -> DataFrame:
    return cards.select("repo_id", F.inline("categories")).withColumns({
        "score": F.col("score_tenths") / 10, "band": band(F.col("score_tenths")),
    })


def radar(cards: DataFrame) -> DataFrame:
    """Category scores as one column each."""
    names = [c.lower().replace(" ", "_").replace("/", "_") for c in CATEGORIES]
    return cards.select("repo_id", *[
        (F.col("categories")[k].score_tenths / 10).alias(name) for k, name in enumerate(names)
    ])


def first_findings(findings: DataFrame) -> DataFrame:
    """First critical and first high finding per repository (a minimum, no sort)."""
    item = F.struct(*FINDING_ORDER, "title")
    return findings.groupBy("repo_id").agg(
        F.min(F.when(F.col("severity") == "CRITICAL", item)).alias("first_critical"),
        F.min(F.when(F.col("severity") == "HIGH", item)).alias("first_high"),
    )


def executive_summaries(findings: DataFrame, cards: DataFrame) -> DataFrame:
    urgent = findings.filter(F.col("severity").isin("CRITICAL", "HIGH"))
    c = cards.join(first_findings(urgent), "repo_id", "left")

    def pointer(label, column):
        return F.concat(F.lit(label), F.col(f"{column}.title"), F.lit(" in `"), F.col(f"{column}.path"), F.lit("`."))

    closing = (
        F.when(F.col("first_critical").isNotNull(), pointer("Critical: ", "first_critical"))
        .when(F.col("first_high").isNotNull(), pointer("Key risk: ", "first_high"))
        .otherwise("No critical or high finding.")
    )
    counts = F.concat_ws(", ", *[
        F.concat(F.col(f"{s}_issues").cast("string"), F.lit(f" {s}")) for s in ("critical", "high", "medium")
    ])
    text = F.concat(
        F.lit("Scored "), tx.tenths_text(F.col("overall_tenths")), F.lit("/10 (grade "), F.col("grade"),
        F.lit(") over 8 categories. "), F.col("total_issues").cast("string"), F.lit(" findings ("),
        counts, F.lit("). "), closing,
    )
    return c.select("repo_id", "repo_name", text.alias("summary"))


def coverage(scanned_repos: DataFrame) -> DataFrame:
    """Docstring coverage and test-to-source ratio as integer pairs."""
    return scanned_repos.select(
        "repo_id", "documented_defs", "public_defs", "test_loc", "source_loc"
    )
