"""Merging, survivorship and synchronisation of tables as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def merge_survivor(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Full outer upsert on ``key`` with a rule for each column.

    ``new``: the new value unless null; ``old``: the old one unless null;
    ``overwrite``: the new row's value even if null; ``list``: the new JSON list
    unless null or empty.  Keys of one side only keep that side's values.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")

    def pick(c: str, rule: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if rule == "new":
            return F.coalesce(b, a)
        if rule == "old":
            return F.coalesce(a, b)
        if rule == "overwrite":
            return F.when(F.col(f"n.{key}").isNotNull(), b).otherwise(a)
        if rule == "list":
            return F.when(b.isNotNull() & (F.trim(b) != "[]"), b).otherwise(F.coalesce(a, b))
        raise ValueError(f"unknown rule {rule!r}")

    return both.select(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), *[pick(c, r).alias(c) for c, r in rules.items()])


def last_wins(df: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows a key in the given order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= keep).drop("__rn")


def insert_or_ignore(stored: DataFrame, fresh: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Stored rows stay; of fresh rows with a new key the first in the given order is added."""
    new = fresh.join(stored.select(*keys).distinct(), keys, "left_anti")
    return stored.unionByName(last_wins(new, keys, order).select(*stored.columns))


def by_precedence(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of sources of which an earlier one hides a later one's rows of the same key."""
    out = None
    for rank, s in enumerate(sources):
        s = s.withColumn("__rank", F.lit(rank))
        out = s if out is None else out.unionByName(s)
    first = out.groupBy(*keys).agg(F.min("__rank").alias("__rank"))
    return out.join(first, [*keys, "__rank"], "left_semi").drop("__rank")


def content_hash(df: DataFrame, cols: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c).alias(c) for c in cols]), {"ignoreNullFields": "false"}), 256)


def hash_diff(stored: DataFrame, fresh: DataFrame, key: str, hash_col: str = "content_hash") -> DataFrame:
    """(key, action): ``insert``, ``update`` or ``delete`` that brings ``stored`` to ``fresh``; equal rows have none."""
    s = stored.select(key, F.col(hash_col).alias("a"))
    f = fresh.select(key, F.col(hash_col).alias("b"))
    action = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(F.col("a") != F.col("b"), "update")
    return s.join(f, key, "full_outer").select(key, action.alias("action")).where("action is not null")


def provenance(df: DataFrame, key: str, fields: list[str], source: Column, rule: str) -> DataFrame:
    """One row a filled field: (key, field_name, field_value, source, rule)."""
    long = df.select(key, source.alias("source"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("field_value")) for f in fields])).alias("x"))
    return long.select(key, "x.field_name", "x.field_value", "source", F.lit(rule).alias("rule")).where("field_value is not null")


def unpivot_years(df: DataFrame, key: str, pattern: str) -> DataFrame:
    """(key, year, kind, value) from columns such as ``1841 Male``; ``pattern`` captures year and kind; duplicates sum, never-seen stays null."""
    import re

    cols = [(c, re.fullmatch(pattern, c)) for c in df.columns]
    picks = [F.struct(F.lit(int(m[1])).alias("year"), F.lit(m[2].lower()).alias("kind"), F.col(f"`{c}`").cast("long").alias("value")) for c, m in cols if m]
    return df.select(key, F.explode(F.array(*picks)).alias("x")).groupBy(key, "x.year", "x.kind").agg(F.sum("x.value").alias("value"))
