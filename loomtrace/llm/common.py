"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.sources.scratch import dropped, saved, shared_dir  # noqa: F401  used by the operators from here


_held: dict[tuple, Any] = {}


def held(name: tuple, make: Callable[[], Any]) -> Any:
    """What a worker keeps from task to task, made once. Only that of the last name stays, so operators that follow each other don't add up."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(name: str, df: DataFrame) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(text_col: str) -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(named(text_col).cast("string"), F.lit(""))
