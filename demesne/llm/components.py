"""Problem 7: consolidate pairwise matches into groups by randomised contraction.

Each round gives every vertex a fresh pseudo-random order, hooks it to the
neighbour (or itself) that comes first in that order, relabels both ends of
every edge by the hook, and drops loops and repeats.  Rounds go on until no edge
is left; the expected number is logarithmic in the vertices, whatever the length
of the chains.  The rounds' hook tables, each a fraction of the one before, are
then composed from the last to the first into one mapping, without being written
in between, and every group is named by its smallest member.

Every step is a grouped aggregate or a salted lookup join, so a hub or a giant
component that holds a third of all pairs is spread over many tasks; nothing is
collected and no component is held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demesne.runtime import cut, lookup_join, table, ws_trim

MAX_ROUNDS = 200
#: hook tables composed in one plan
COMPOSED = 8


def connected_groups(pairs: DataFrame, a: str, b: str, vertex: str = "vertex", group: str = "group_id", seed: int = 7) -> DataFrame:
    """(vertex, group): every vertex of a pair of two different ends, with its group's least vertex.

    Ends of any one orderable type.  Pairs with a null end and pairs of a vertex
    with itself are ignored; repeated and reversed pairs count once; no pairs
    give no rows; other columns are not read.
    """
    edges = (
        pairs.select(F.col(f"`{a}`").alias("u"), F.col(f"`{b}`").alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
    edges = cut(edges)
    hooks: list[DataFrame] = []
    for rnd in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = F.xxhash64(F.lit(seed * 1_000 + rnd), F.col("v"))
        mine = F.xxhash64(F.lit(seed * 1_000 + rnd), F.col("u"))
        best = both.groupBy("u").agg(F.min(F.struct(order.alias("h"), F.col("v").alias("w"))).alias("best"))
        hook = cut(best.select("u", F.when(F.struct(mine.alias("h"), F.col("u").alias("w")) <= F.col("best"), F.col("u")).otherwise(F.col("best.w")).alias("w")))
        hooks.append(hook)
        step = lookup_join(edges, hook.withColumnRenamed("w", "ru"), ["u"]).select(F.col("ru").alias("x"), "v")
        step = lookup_join(step, hook.select(F.col("u").alias("v"), F.col("w").alias("rv")), ["v"]).select("x", F.col("rv").alias("y"))
        edges = cut(step.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    if not hooks:
        return edges.select(F.col("u").alias(vertex), F.col("v").alias(group))
    mapping = hooks[-1]
    for k, hook in enumerate(reversed(hooks[:-1]), 1):
        later = mapping.select(F.col("u").alias("w"), F.col("w").alias("w2"))
        mapping = lookup_join(hook, later, ["w"], "left").select("u", F.coalesce("w2", "w").alias("w"))
        if k % COMPOSED == 0:
            mapping = cut(mapping)
    mapping = cut(mapping)
    least = mapping.groupBy("w").agg(F.min("u").alias("least"))
    return lookup_join(mapping, least, ["w"]).select(F.col("u").alias(vertex), F.col("least").alias(group))


def confirmed_pairs(review: DataFrame) -> DataFrame:
    """(u, v), u < v: the unordered pairs whose latest deciding review confirmed them.

    Status is read without case and outer blanks; only ``confirmed`` and
    ``rejected`` decide.  Of several deciding reviews the latest ``reviewed_at``
    holds (a missing time is the earliest); if that ties, the highest id.
    """
    status = F.lower(ws_trim(F.col("status")))
    decided = (
        review.select(F.least("townland_id_a", "townland_id_b").alias("u"), F.greatest("townland_id_a", "townland_id_b").alias("v"), "reviewed_at", "id", status.alias("status"), F.col("townland_id_a").isNotNull().alias("has_a"), F.col("townland_id_b").isNotNull().alias("has_b"))
        .where(F.col("has_a") & F.col("has_b") & (F.col("u") != F.col("v")) & F.col("status").isin("confirmed", "rejected"))
    )
    last = decided.groupBy("u", "v").agg(F.max(F.struct(F.coalesce("reviewed_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), F.col("id"), F.col("status"))).alias("last"))
    return last.where(F.col("last.status") == "confirmed").select("u", "v")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = confirmed_pairs(table(spark, sf_dir, "match_review"))
    return connected_groups(pairs, "u", "v", "townland_id", "group_id")


QUERIES = {"p7_found": p7_found}

SQL = {
    "p7_found": r"""
WITH RECURSIVE d AS (
  SELECT least(townland_id_a, townland_id_b) AS u, greatest(townland_id_a, townland_id_b) AS v, reviewed_at, id,
         regexp_replace(lower(status), '^\s+|\s+$', '', 'g') AS st
  FROM match_review WHERE townland_id_a IS NOT NULL AND townland_id_b IS NOT NULL AND townland_id_a <> townland_id_b
), l AS (
  SELECT u, v, st, row_number() OVER (PARTITION BY u, v ORDER BY reviewed_at DESC NULLS LAST, id DESC) AS rn
  FROM d WHERE st IN ('confirmed', 'rejected')
), e AS (
  SELECT u, v FROM l WHERE rn = 1 AND st = 'confirmed' UNION SELECT v, u FROM l WHERE rn = 1 AND st = 'confirmed'
), r(x, y) AS (
  SELECT u, u FROM e UNION SELECT r.x, e.v FROM r JOIN e ON e.u = r.y
)
SELECT x AS townland_id, min(y) AS group_id FROM r GROUP BY x
"""
}
