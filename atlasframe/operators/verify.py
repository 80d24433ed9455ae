"""Checks: tables against each other, row by row or as bags, and tables' sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mismatches(left: DataFrame, right: DataFrame, pos: str, columns: list[str]) -> DataFrame:
    """One row: rows that only one side has, and for each column how many differ (nulls agree)."""
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, F.col(f"a.{pos}") == F.col(f"b.{pos}"), "full_outer")
    here = F.col(f"a.{pos}").isNotNull() & F.col(f"b.{pos}").isNotNull()
    counts = [F.count_if(here & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"{c}_differs") for c in columns]
    return both.agg(F.count_if(F.col(f"b.{pos}").isNull()).alias("missing"), F.count_if(F.col(f"a.{pos}").isNull()).alias("extra"), *counts)


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether both hold the same rows as often, in any order."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name and n for each table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def byte_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: bytes of each text or binary column."""
    return df.agg(*[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("long").alias(f"{c}_bytes") for c in columns])


def vocabulary_bytes(vocabulary: DataFrame) -> DataFrame:
    """One row: what the vocabulary takes in a bundle, three bytes a token besides its text."""
    return vocabulary.agg(F.coalesce(F.sum(F.octet_length("token") + 3), F.lit(0)).cast("long").alias("vocabulary_bytes"))
