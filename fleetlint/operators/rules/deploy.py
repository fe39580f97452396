"""Build and deployment rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlint.functions import text as tx
from fleetlint.model import GITIGNORE_ENTRIES
from fleetlint.operators.rules.hits import hit, none, only_if


def no_workflows() -> Column:
    return only_if(
        ~F.col("has_workflow"),
        hit("CICD-NOWORKFLOWS", "HIGH", "Missing Automated CI/CD Workflows",
            path=".github/workflows/ci.yml"),
    )


def no_docker() -> Column:
    return only_if(
        F.col("docker_path").isNull(),
        hit("DEPLOY-NODOCKER", "LOW", "Missing Dockerfile for Containerized Deployment", path="Dockerfile"),
    )


def docker_latest() -> Column:
    return only_if(
        F.col("docker_from").isNotNull(),
        hit("DEPLOY-DOCKER-LATEST", "MEDIUM", "Unpinned Docker Base Image ('latest' tag)",
            path=F.col("docker_path"), snippet=F.col("docker_from")),
    )


def no_gitignore() -> Column:
    return only_if(
        ~F.col("has_gitignore"),
        hit("DEPLOY-NOGITIGNORE", "HIGH", "Missing .gitignore File", path=".gitignore"),
    )


def incomplete_gitignore() -> Column:
    gaps = tx.missing_items(F.array_join("lines", "\n"), GITIGNORE_ENTRIES)
    names = F.array_join(gaps, ", ")
    return F.when(
        F.col("path") == ".gitignore",
        only_if(F.size(gaps) > 0, hit(
            "DEPLOY-INCOMPLETE-GITIGNORE", "MEDIUM",
            F.concat(F.lit(".gitignore Missing Essential Rules ("), names, F.lit(")")), detail=names,
        )),
    ).otherwise(none())
