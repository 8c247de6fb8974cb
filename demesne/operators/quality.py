"""Diagnostics of results and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_rates(df: DataFrame, columns: list[str], least_rows: int = 5, warn_at: float = 0.6) -> DataFrame:
    """(column, rows, nulls, rate, warn) of each column, in one pass."""
    agg = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    long = agg.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])).alias("x")).select("x.column", "rows", "x.nulls")
    rate = F.floor(F.col("nulls") * 10000 / F.expr("nullif(rows, 0)") + 0.5) / 10000
    return long.withColumn("rate", rate).withColumn("warn", ((F.col("rows") >= least_rows) & (F.col("rate") >= warn_at)).cast("int"))


def value_profile(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    """The commonest values of a column with their counts (ties by value)."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col("value").asc_nulls_last()).limit(top).select(F.lit(column).alias("column"), "value", "n")


def lane_discrepancy(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two results held against each other: ``agree`` below 5 %, ``close`` below 20 %, else ``differ``; ``missing`` on one side."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer")
    gap = F.abs(F.col("a") - F.col("b")) / F.expr("nullif(greatest(abs(a), abs(b)), 0)")
    verdict = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.coalesce(gap, F.lit(0.0)) < 0.05, "agree").when(gap < 0.2, "close").otherwise("differ")
    return both.select(key, "a", "b", verdict.alias("verdict"))


def stale(meta: DataFrame, at, today: str, days: int) -> DataFrame:
    """Adds ``age_days`` and ``stale`` (at least ``days`` old)."""
    age = F.date_diff(F.lit(today).cast("date"), F.to_date(at))
    return meta.withColumn("age_days", age).withColumn("stale", (age >= days).cast("int"))
