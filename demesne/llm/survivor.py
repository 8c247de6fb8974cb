"""Problem 5: best representative of each group of values, by skyline selection.

Rows are judged on three criteria: completeness (a real, whole value beats an
incomplete one, which beats a hollow one), trust (rank of source and rule) and
recency.  Every group is first reduced, map-side, to one cell per completeness
and rank; dominance is then worked out among at most three cells a listed rank.
No group, however large, is held in one task.

Incomplete values are found exactly.  In the order of the alphabet a value that
begins others is followed at once by one of them, so a value of at least ``HEAD``
letters is held against the next one of its group and first ``HEAD`` letters;
shorter values (of fewer than ``HEAD`` different lengths) are met by equi-join
with the beginnings of those lengths that longer values offer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demesne.runtime import lookup_join, table, ws_trim

#: Spellings that stand for a missing value (compared in lower case).
HOLLOW = ["unknown", "not known", "n/a", "na", "n.a.", "n.a", "nan", "none", "null", "nil", "tbc", "tbd", "to be confirmed", "not recorded", "unrecorded", "not given", "not stated", "not available", "missing", "illegible", "[illegible]", "(illegible)", "[blank]", "blank", "undefined", "empty", "no data", "[unknown]", "(unknown)", "<na>", "#n/a"]
#: rows of the trust list that are broadcast; a longer list is joined
MAX_RANKS = 1000
HEAD = 16
NO_TIME = "0001-01-01"


def plain(c: Column) -> Column:
    return F.lower(ws_trim(c))


def is_real(c: Column) -> Column:
    """Neither null nor blank nor a sign or word for a missing value."""
    t = plain(c)
    return F.coalesce((t != "") & ~t.isin(HOLLOW) & t.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def stem(c: Column) -> Column:
    """The value without case, outer blanks and trailing dots."""
    return F.regexp_replace(plain(c), r"[\s.…]+$", "")


def incomplete_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct (keys, __stem) whose stem begins another, longer real stem of the group."""
    vals = df.where(is_real(F.col(value))).select(*keys, stem(F.col(value)).alias("__stem")).where(F.col("__stem") != "").distinct()
    vals = vals.withColumn("__n", F.length("__stem"))
    # a lookup of at most HEAD - 1 lengths a group, and as many beginnings a value
    lengths = vals.where(F.col("__n") < HEAD).groupBy(*keys).agg(F.collect_set("__n").alias("__ns"))
    heads = lookup_join(vals, lengths, keys).select(*keys, F.explode(F.filter("__ns", lambda n: n < F.col("__n"))).alias("__k"), "__stem")
    heads = heads.select(*keys, F.substring("__stem", F.lit(1), F.col("__k")).alias("__stem")).distinct()
    short = vals.where(F.col("__n") < HEAD).drop("__n").join(heads, [*keys, "__stem"], "left_semi")
    # values alike in their first letters only; sorted, not held
    following = F.lead("__stem").over(Window.partitionBy(*keys, F.substring("__stem", 1, HEAD)).orderBy("__stem"))
    long_ = vals.where(F.col("__n") >= HEAD).withColumn("__next", following).where(F.startswith(F.col("__next"), F.col("__stem"))).select(*keys, "__stem")
    return short.unionByName(long_)


def with_rank(df: DataFrame, trust: DataFrame) -> DataFrame:
    """Adds ``__rank``: trust_rank of (source, rule), case and outer blanks aside; unlisted pairs come last."""
    ranks = trust.groupBy(plain(F.col("source")).alias("__s"), plain(F.col("rule")).alias("__r")).agg(F.min("trust_rank").alias("__rank"))
    keyed = df.withColumn("__s", plain(F.col("source"))).withColumn("__r", plain(F.col("rule")))
    if ranks.count() <= MAX_RANKS:
        # bounded: at most MAX_RANKS rows, counted
        out = keyed.join(F.broadcast(ranks), ["__s", "__r"], "left")
    else:
        out = lookup_join(keyed, ranks, ["__s", "__r"], "left")
    return out.withColumn("__rank", F.coalesce("__rank", F.lit(2147483647))).drop("__s", "__r")


def graded(df: DataFrame, keys: list[str], value: str, trust: DataFrame) -> DataFrame:
    """Adds ``__rank``, ``__t`` and ``__full`` (2 real and whole, 1 incomplete, 0 hollow).

    Null keys form groups like any other value.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    # null keys become equal to each other: a struct never compares as null
    base = with_rank(df, trust).withColumns({n: F.to_json(F.struct(F.col(f"`{k}`").alias("k"))) for n, k in zip(names, keys)})
    base = base.withColumn("__stem", F.when(is_real(F.col(value)), stem(F.col(value))))
    out = incomplete_values(base.select(*names, value), names, value).withColumn("__out", F.lit(True))
    base = lookup_join(base, out, [*names, "__stem"], "left")
    full = F.when(F.col("__stem").isNull(), 0).when(F.col("__out"), 1).otherwise(2)
    return base.withColumn("__full", full).withColumn("__t", F.coalesce(F.col("created_at"), F.lit(NO_TIME).cast("timestamp_ntz"))).drop("__out", "__stem")


def dominates(a: Column, b: Column) -> Column:
    """``a`` is at least as good on every criterion and better on one."""
    at_least = (a["full"] >= b["full"]) & (a["rank"] <= b["rank"]) & (a["t"] >= b["t"])
    return at_least & ((a["full"] > b["full"]) | (a["rank"] < b["rank"]) | (a["t"] > b["t"]))


def survivors(df: DataFrame, keys: list[str], value: str, trust: DataFrame) -> DataFrame:
    """One row a group of ``keys``: ``n``, ``id``, ``field_value``, ``trust_rank``, ``skyline`` (undominated cells).

    The survivor is the first of the undominated rows by completeness, trust,
    recency and smallest id.  Groups without any real value have ``id`` null.
    Ties and repeated rows go to the smallest id; a missing time is the oldest.
    An empty table gives no rows; other columns are not read.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    g = graded(df.select(*keys, value, "source", "rule", "created_at", "id"), keys, value, trust)
    best = F.max(F.struct(F.col("__t").alias("t"), (-F.col("id")).alias("nid"), F.col(value).alias("v"))).alias("b")
    cells = g.groupBy(*names, "__full", "__rank").agg(best, F.count(F.lit(1)).alias("n"), *[F.first(k).alias(k) for k in keys])
    cell = F.struct(F.col("__full").alias("full"), F.col("__rank").alias("rank"), F.col("b.t").alias("t"), (-F.col("b.nid")).alias("id"), F.col("b.v").alias("v"))
    groups = cells.groupBy(*names).agg(F.collect_list(cell).alias("cells"), F.sum("n").alias("n"), *[F.first(k).alias(k) for k in keys])
    groups = groups.withColumn("sky", F.filter("cells", lambda x: ~F.exists("cells", lambda y: dominates(y, x))))
    order = F.transform(F.filter("sky", lambda x: x["full"] > 0), lambda x: F.struct((-x["full"]).alias("a"), x["rank"].alias("b"), (-F.unix_micros(x["t"].cast("timestamp"))).alias("c"), x["id"].alias("id"), x["v"].alias("v")))
    top = F.array_min(order)
    return groups.select(*keys, "n", top["id"].alias("id"), top["v"].alias("field_value"), top["b"].alias("trust_rank"), F.size("sky").alias("skyline"))


def golden_records(df: DataFrame, entity: str, field: str, value: str, trust: DataFrame) -> DataFrame:
    """One built record an entity (as JSON, fields in order), filled layer by layer.

    Candidate records of an entity are its values by trust rank, that is by
    source and rule (a source's own record numbers name single values).  They
    are peeled into dominance layers over completeness (filled fields), recency
    and trust; the base is the first of the first layer by trust, recency and
    completeness, and each field still missing is filled from the next record of
    the same layer, then from later layers.  Every field that occurs is kept.
    """
    g = graded(df.select(entity, field, value, "source", "rule", "created_at", "id"), [entity, field], value, trust).where("__full = 2 and " + f"`{field}` is not null and `{entity}` is not null")
    pick = F.max(F.struct(F.col("__t").alias("t"), (-F.col("id")).alias("nid"), F.col(value).alias("v")))
    cells = g.groupBy(entity, "__rank", field).agg(pick.alias("b"))
    # one cell a field and rank
    recs = cells.groupBy(entity, "__rank").agg(F.max("b.t").alias("t"), F.map_from_entries(F.collect_list(F.struct(F.col(field), F.col("b.v")))).alias("m"))
    full = F.size("m")
    rec = F.struct((-full).alias("miss"), (-F.unix_micros(F.col("t").cast("timestamp"))).alias("age"), F.col("__rank").alias("rank"), full.alias("full"), F.col("t").alias("t"))
    listed = F.array_sort(F.collect_list(F.struct(rec.alias("r"), F.map_entries("m").alias("m"))))
    out = recs.groupBy(entity).agg(listed.alias("recs"))
    # sorted by (completeness, recency, trust) a record can only be dominated by earlier ones
    layer = F.aggregate(
        F.sequence(F.lit(1), F.size("recs")),
        F.array().cast("array<int>"),
        lambda acc, i: F.array_append(acc, F.lit(1) + F.coalesce(F.array_max(F.transform(acc, lambda l, j: F.when(dominates(F.get("recs", j)["r"], F.get("recs", i - 1)["r"]), l))), F.lit(0))),
    )
    out = out.withColumn("layer", layer)
    ranked = F.array_sort(F.zip_with("layer", "recs", lambda l, r: F.struct(l.alias("layer"), r["r"]["rank"].alias("rank"), r["r"]["age"].alias("age"), r["r"]["miss"].alias("miss"), r["m"].alias("m"))))
    # of a field's values in this order the first
    every = F.flatten(F.transform(ranked, lambda x: x["m"]))
    kept = F.filter(every, lambda x, i: F.array_position(F.transform(every, lambda y: y["key"]), x["key"]) == i + 1)
    filled = F.to_json(F.map_from_entries(F.array_sort(kept)))
    return out.select(entity, F.size("recs").alias("n_records"), F.array_max("layer").alias("n_layers"), F.get(ranked, F.lit(0))["rank"].alias("base_rank"), filled.alias("record"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = survivors(table(spark, sf_dir, "field_provenance"), ["entity_id", "field_name"], "field_value", table(spark, sf_dir, "trust_order"))
    return s.where((F.col("n") >= 2) & F.col("id").isNotNull()).select("entity_id", "field_name", "id")


def p5_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden_records(table(spark, sf_dir, "field_provenance"), "entity_id", "field_name", "field_value", table(spark, sf_dir, "trust_order"))


QUERIES = {"p5_found": p5_found, "p5_golden": p5_golden}

_HOLLOW_SQL = ", ".join("'" + h + "'" for h in HOLLOW)
SQL = {
    "p5_found": rf"""
WITH v AS (
  SELECT *, lower(regexp_replace(field_value, '^\s+|\s+$', '', 'g')) AS p FROM field_provenance
), g AS (
  SELECT *, coalesce(p <> '' AND p NOT IN ({_HOLLOW_SQL}) AND regexp_matches(p, '[\p{{L}}\p{{N}}]'), false) AS ok,
         regexp_replace(p, '[\s.…]+$', '') AS stem, count(*) OVER (PARTITION BY entity_id, field_name) AS n FROM v
), w AS (
  SELECT * FROM g a WHERE ok AND n >= 2 AND NOT EXISTS (
    SELECT 1 FROM g b WHERE b.ok AND b.entity_id IS NOT DISTINCT FROM a.entity_id AND b.field_name IS NOT DISTINCT FROM a.field_name
      AND length(b.stem) > length(a.stem) AND starts_with(b.stem, a.stem))
), r AS (
  SELECT w.entity_id, w.field_name, w.id, row_number() OVER (PARTITION BY w.entity_id, w.field_name
    ORDER BY coalesce(t.trust_rank, 2147483647), w.created_at DESC NULLS LAST, w.id) AS rn
  FROM w LEFT JOIN trust_order t ON lower(trim(t.source)) = lower(regexp_replace(w.source, '^\s+|\s+$', '', 'g'))
    AND lower(trim(t.rule)) = lower(regexp_replace(w.rule, '^\s+|\s+$', '', 'g'))
)
SELECT entity_id, field_name, id FROM r WHERE rn = 1
"""
}
