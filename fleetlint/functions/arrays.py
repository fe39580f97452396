"""Array helpers."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the column a function returns, per JVM and arguments.

    A large expression takes thousands of calls to the JVM to build; it is
    unresolved, so it can be used in any number of queries.
    """
    kept: dict = {}

    @functools.wraps(build)
    def wrapper(*args) -> Column:
        key = (id(SparkContext._gateway), args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return wrapper


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times, also inside lambdas.

    An expression used in a lambda is otherwise evaluated once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def computed_once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a costly column that later filters cannot copy below themselves.

    A filter on a projected column is pushed down by repeating the expression;
    it is not pushed through a generator, and an outer one infers no filter.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def explode_once(df: DataFrame, keys: list[str], array: str, name: str) -> DataFrame:
    """Explode an array that is itself a costly expression. A plain explode
    infers ``size(array) > 0`` below it, which evaluates the array again."""
    return df.select(*keys, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
