"""Documentation rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.operators.rules.hits import hit, only_if


def no_readme() -> Column:
    return only_if(
        F.col("readme_path").isNull(),
        hit("DOC-NOREADME", "HIGH", "Missing README.md Documentation", path="README.md"),
    )


def sparse_readme() -> Column:
    return only_if(
        F.col("readme_chars") < 150,
        hit("DOC-SPARSE-README", "MEDIUM", "Sparse / Incomplete README.md",
            path=F.col("readme_path"), snippet=F.col("readme_head"), num=F.col("readme_chars")),
    )


def missing_sections() -> Column:
    gaps = F.col("readme_gaps")
    return only_if(
        gaps != "",
        hit("DOC-SECTIONS", "LOW",
            F.concat(F.lit("README Missing Essential Sections ("), gaps, F.lit(")")),
            path=F.col("readme_path"), detail=gaps),
    )


def low_docstrings() -> Column:
    total, documented = F.col("public_defs"), F.col("documented_defs")
    share = tx.percent_text(documented, total)
    return only_if(
        (total > 4) & (documented * 100 < total * 40),
        hit(
            "DOC-LOWDOCSTRINGS", F.when(documented * 100 < total * 20, "MEDIUM").otherwise("LOW"),
            F.concat(F.lit("Low Public API Docstring Coverage ("), share, F.lit(")")),
            path=F.col("first_untested"),
            detail=F.concat(documented.cast("string"), F.lit(" of "), total.cast("string")),
            num=documented, den=total,
        ),
    )


def no_license() -> Column:
    return only_if(
        ~F.col("has_license"),
        hit("DOC-NOLICENSE", "LOW", "Missing Open-Source LICENSE File", path="LICENSE"),
    )
