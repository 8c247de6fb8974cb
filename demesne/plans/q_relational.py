"""Joins, set operations, windows, sorts and record lists over the estate model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demesne.functions.cleaning import person_display
from demesne.plans import views
from demesne.runtime import lookup_join, table


def _place(spark, d) -> DataFrame:
    """The place most records name (ties: the first by name), one row: stands in for a place asked about."""
    r = views.records(spark, d).where("townland_norm is not null").groupBy("townland_norm").agg(F.count(F.lit(1)).alias("n"))
    return r.orderBy(F.desc("n"), "townland_norm").limit(1).select("townland_norm")


_PLACE_SQL = "place AS (SELECT townland_norm FROM unified_record WHERE townland_norm IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def j_inner_dim(spark, d):
    r = views.records(spark, d).where("has_eviction_record = 1").select("id", "record_id", "year", "townland_norm")
    c = views.catalogue(spark, d).withColumnRenamed("name", "townland_norm")
    return lookup_join(r, c, ["townland_norm"]).select("id", "record_id", "year", "townland_norm", "parish", "county")


def j_left_catalog_counts(spark, d):
    r = views.records(spark, d).groupBy(F.col("townland_norm").alias("name")).agg(F.countDistinct("record_id").alias("records"))
    return views.catalogue(spark, d).join(r, "name", "left").select("name", "parish", F.coalesce("records", F.lit(0)).cast("long").alias("records"))


def j_left_on_predicate(spark, d):
    c = views.census(spark, d).where("year = 1841").select(F.col("townland_norm").alias("name"), "total")
    return views.catalogue(spark, d).join(c, "name", "left").select("name", F.col("total").alias("total_1841"))


def j_self_siblings(spark, d):
    c = views.catalogue(spark, d)
    mine = c.join(_place(spark, d), c["name"] == F.col("townland_norm")).select("name", F.col("parish").alias("p"))
    return c.join(F.broadcast(mine.select("p", F.col("name").alias("asked"))), (c["parish"] == F.col("p")) & (c["name"] != F.col("asked"))).select("asked", c["name"], "parish")


def j_temporal_change(spark, d):
    c = views.census(spark, d).groupBy("townland_norm").pivot("year", [1841, 1851]).agg(F.sum("total"))
    return c.where("`1841` is not null and `1851` is not null").select("townland_norm", F.col("1841").alias("before"), F.col("1851").alias("after"), (F.col("1851") - F.col("1841")).alias("change"))


def j_pct_change_nullif(spark, d):
    c = j_temporal_change(spark, d)
    return c.select("townland_norm", (F.floor(F.expr("change * 1000D / nullif(before, 0)")) / 10).alias("percent"))


def j_latest_per_key(spark, d):
    r = views.records(spark, d).where("has_tenancy_record = 1 and holding_acres is not null and year is not null")
    last = r.withColumn("rk", F.rank().over(W.partitionBy("record_id").orderBy(F.desc("year")))).where("rk = 1")
    return last.groupBy("record_id").agg(F.max("year").alias("year"), F.max("holding_acres").alias("acres"))


def j_same_place_same_year_both_events(spark, d):
    r = views.records(spark, d).where("townland_norm is not null and year is not null")
    return r.groupBy("townland_norm", "year").agg(F.count(F.when(F.col("has_emigration_record") == 1, 1)).alias("emigrants"), F.count(F.when(F.col("has_eviction_record") == 1, 1)).alias("evicted")).where("emigrants > 0 and evicted > 0")


def j_semi_in_subquery(spark, d):
    r = views.records(spark, d)
    gone = r.where("has_emigration_record = 1 and surname is not null").select("surname", "townland_norm").distinct()
    return r.where("has_eviction_record = 1").join(gone, ["surname", "townland_norm"], "left_semi").select("id", "record_id", "surname", "townland_norm")


def j_anti_gaps(spark, d):
    r = views.records(spark, d).where("townland_norm is not null").select("townland_norm").distinct()
    return r.join(views.catalogue(spark, d).select(F.col("name").alias("townland_norm")), "townland_norm", "left_anti")


def j_cross_top1_compare(spark, d):
    c = views.census(spark, d)
    top = lambda y: c.where(F.col("year") == y).orderBy(F.desc("total"), "townland_norm").limit(1).select(F.col("townland_norm").alias(f"place_{y}"), F.col("total").alias(f"total_{y}"))
    # one row each
    return top(1841).join(F.broadcast(top(1861)))


def j_three_way_cte(spark, d):
    e = views.records(spark, d).where("has_emigration_record = 1").groupBy("townland_norm").agg(F.countDistinct("record_id").alias("emigrants"))
    c = views.census(spark, d).groupBy("townland_norm").agg(*[F.sum(F.when(F.col("year") == y, F.col("total"))).alias(f"p{y}") for y in (1841, 1861)])
    return e.join(c, "townland_norm", "left").select("townland_norm", "emigrants", "p1841", "p1861")


def j_fanout_literal(spark, d):
    c = views.census(spark, d).alias("c")
    e = views.records(spark, d).where("has_emigration_record = 1").select("townland_norm", "record_id").alias("e")
    return c.join(e, "townland_norm", "left").groupBy("year").agg(F.countDistinct("record_id").alias("emigrants"), F.sum("total").alias("fanned_total"))


def j_preagg_fixed(spark, d):
    c = views.census(spark, d).groupBy("year").agg(F.sum("total").alias("total"))
    e = views.records(spark, d).where("has_emigration_record = 1 and year is not null").groupBy((F.floor(F.col("year") / 10) * 10 + 1).cast("int").alias("year")).agg(F.countDistinct("record_id").alias("emigrants"))
    return c.join(e, "year", "left").select("year", "total", F.coalesce("emigrants", F.lit(0)).cast("long").alias("emigrants"))


def j_group_presence(spark, d):
    """Population of places with and without a ring fort."""
    fort = views.heritage(spark, d).where("feature_group = 'ring_fort'").join(views.places(spark, d).select("entity_id", F.upper(F.trim("name")).alias("townland_norm")), "entity_id").select("townland_norm").distinct().withColumn("has", F.lit(True))
    c = views.census(spark, d).where("year = 1841").join(fort, "townland_norm", "left")
    return c.groupBy(F.when(F.col("has"), "with").otherwise("without").alias("group_label")).agg(F.count(F.lit(1)).alias("places"), F.sum("total").alias("people"), F.max("total").alias("most"))


def j_range_time(spark, d):
    """Interval join: purchases within an hour after a sign-up of the same user, met by user and hour, so that a busy user's events are spread over the hours."""
    e = table(spark, d, "events")
    hour = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 3_600_000_000)
    s = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("t0"), F.col("event_id").alias("signup_id"), F.explode(F.array(hour("ts"), hour("ts") + 1)).alias("hour"))
    return e.where("event_type = 'purchase'").withColumn("hour", hour("ts")).join(s, ["user_id", "hour"]).where("ts >= t0 and ts < t0 + interval 1 hour").select("signup_id", "event_id", "user_id")


def j_asof_last(spark, d):
    """As-of join: the last click of the user at or before each error, by window, without a range join."""
    e = table(spark, d, "events").where("event_type in ('click', 'error')")
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), True).over(W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1), "event_id").rowsBetween(W.unboundedPreceding, 0))
    return e.withColumn("click_id", last).where("event_type = 'error'").select("event_id", "click_id")


def s_union_all_metrics(spark, d):
    r = views.records(spark, d)
    row = lambda name, df: df.select(F.lit(name).alias("metric"), F.col("v").cast("string").alias("value"))
    parts = [
        row("evicted", r.where("has_eviction_record = 1").agg(F.countDistinct("record_id").alias("v"))),
        row("emigrated", r.where("has_emigration_record = 1").agg(F.countDistinct("record_id").alias("v"))),
        row("first_year", r.agg(F.min("year").alias("v"))),
        row("places", views.places(spark, d).agg(F.count(F.lit(1)).alias("v"))),
        row("people_1841", views.census(spark, d).where("year = 1841").agg(F.sum("total").alias("v"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def s_distinct_list(spark, d):
    return views.records(spark, d).where("has_emigration_record = 1 and trim(ship_name) <> ''").select("ship_name").distinct()


def s_set_operations(spark, d):
    r = views.records(spark, d).where("surname is not null")
    gone, held = r.where("has_emigration_record = 1").select("surname"), r.where("has_tenancy_record = 1").select("surname")
    return gone.intersect(held).withColumn("kind", F.lit("both")).unionByName(gone.exceptAll(held.select("surname")).distinct().join(held, "surname", "left_anti").withColumn("kind", F.lit("gone only")))


def w_count_over_partition(spark, d):
    c = views.catalogue(spark, d).where("parish is not null")
    return c.select("name", "parish", F.count(F.lit(1)).over(W.partitionBy("parish")).alias("in_parish"))


def w_cumulative_first_year(spark, d):
    first = views.records(spark, d).where("has_emigration_record = 1 and year is not null").groupBy("record_id").agg(F.min("year").alias("year"))
    by = first.groupBy("year").agg(F.count(F.lit(1)).alias("new"))
    # one row a year
    return by.withColumn("so_far", F.sum("new").over(W.orderBy("year").rowsBetween(W.unboundedPreceding, 0)))


def w_topn_per_group(spark, d):
    n = views.records(spark, d).where("parish is not null and surname is not null").groupBy("parish", "surname").agg(F.countDistinct("record_id").alias("records"))
    return n.withColumn("rn", F.row_number().over(W.partitionBy("parish").orderBy(F.desc("records"), "surname"))).where("rn <= 3").select("parish", "surname", "records", F.col("rn").cast("int").alias("place"))


def w_nearest_year(spark, d):
    c = views.census(spark, d)
    return c.groupBy("townland_norm").agg(F.min(F.struct(F.abs(F.col("year") - 1848).alias("gap"), "year", "total")).alias("m")).select("townland_norm", F.col("m.year").alias("year"), F.col("m.total").alias("total"))


def w_first_last_change(spark, d):
    c = views.census(spark, d)
    ends = c.groupBy("townland_norm").agg(F.min_by("total", "year").alias("first"), F.max_by("total", "year").alias("last"), F.count(F.lit(1)).alias("years"))
    return ends.select("townland_norm", "first", "last", (F.col("last") - F.col("first")).alias("change"), "years")


def w_lag_year_change(spark, d):
    c = views.clearances(spark, d)
    return c.select("townland_norm", "year", "evictions", (F.col("evictions") - F.lag("evictions").over(W.partitionBy("townland_norm").orderBy("year"))).alias("change"))


def w_rate_window(spark, d):
    """Events of a user in the hour up to each of them."""
    w = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.count(F.lit(1)).over(w).alias("in_hour"))


BINS = 4096


def w_nearest_rank_percentiles(spark, d):
    """Nearest-rank percentiles without sorting a type's events: counts in equal bins find the bin of each rank, and only that bin is looked at again."""
    v = table(spark, d, "events").select("event_type", "value")
    ends = v.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))).otherwise(0).cast("int")
    # the planner measures this side: one row a type
    binned = v.join(ends, "event_type").withColumn("b", F.coalesce(bin_, F.lit(-1)))
    counts = binned.groupBy("event_type", "n", "b").agg(F.count(F.lit(1)).alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(W.partitionBy("event_type").orderBy("b")))
    ranks = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.floor(F.col("n") * p).alias("r")) for p in (0.5, 0.9, 0.95)]))
    wanted = upto.select("event_type", "b", "k", "upto", ranks.alias("w")).where("w.r < upto and w.r >= upto - k").select("event_type", "b", F.col("w.p").alias("p"), (F.col("w.r") - F.col("upto") + F.col("k")).alias("at"))
    inside = binned.join(wanted, ["event_type", "b"]).withColumn("i", F.row_number().over(W.partitionBy("event_type", "p").orderBy(F.col("value").asc_nulls_first())) - 1).where("i = at")
    pick = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    return inside.groupBy("event_type").agg(pick(0.5).alias("p50"), pick(0.9).alias("p90"), pick(0.95).alias("p95"))


def l_page_offset(spark, d):
    return views.records(spark, d).where("has_tenancy_record = 1").select("id", "record_id", "surname", "year").orderBy(F.col("surname").asc_nulls_last(), "id").offset(40).limit(20)


def l_topk_ties(spark, d):
    n = views.records(spark, d).where("surname is not null").groupBy("surname").agg(F.countDistinct("record_id").alias("records"))
    top = n.orderBy(F.desc("records"), "surname").limit(10).agg(F.min("records").alias("least"))
    return n.join(F.broadcast(top), n["records"] >= F.col("least")).select("surname", "records")


def l_people_of_place(spark, d):
    r = views.records(spark, d).join(F.broadcast(_place(spark, d)), "townland_norm")
    return r.select("record_id", person_display("canonical_name", "forename", "surname").alias("person"), "year", "role").distinct()


def l_people_both_events(spark, d):
    r = views.records(spark, d).groupBy("surname", "forename", "townland_norm").agg(F.max("has_emigration_record").alias("gone"), F.max("has_eviction_record").alias("evicted"), F.countDistinct("record_id").alias("records"))
    return r.where("gone = 1 and evicted = 1 and surname is not null").select("surname", "forename", "townland_norm", "records")


def l_heads_of_household(spark, d):
    r = views.records(spark, d)
    return r.where(F.col("relationship_to_head_of_household").ilike("%head%") | F.col("role").ilike("head%")).select("id", "record_id", "surname", "forename", "year")


def l_keyword_search(spark, d):
    """Any of the words in any of six fields, case aside."""
    fields = ["surname", "forename", "townland", "parish", "occupation", "comments"]
    hit = F.lit(False)
    for word in ("slated", "weaver", "cabin"):
        for f in fields:
            hit = hit | F.coalesce(F.col(f).ilike(f"%{word}%"), F.lit(False))
    return views.records(spark, d).where(hit).select("id", "record_id")


def l_surname_suggest(spark, d):
    r = views.records(spark, d)
    names = r.select(F.trim("surname").alias("s")).unionByName(r.select(F.trim("chief_tenant_surname").alias("s")))
    return names.where(F.col("s").rlike(r"^[A-Za-z][A-Za-z' -]+$") & F.lower("s").startswith("d")).select(F.initcap("s").alias("surname")).distinct().orderBy("surname").limit(50)


def l_tenancy_tree(spark, d):
    """Chief tenants with their under-tenants."""
    r = views.records(spark, d).where("trim(chief_tenant_surname) <> '' and trim(under_tenant_surname) <> ''")
    name = lambda p: F.trim(F.concat_ws(" ", F.trim(f"{p}_forename"), F.trim(f"{p}_surname")))
    return r.groupBy(name("chief_tenant").alias("chief"), "townland_norm").agg(F.countDistinct(name("under_tenant")).alias("under_tenants"), F.min(name("under_tenant")).alias("first_under_tenant"))


def l_mode_per_place(spark, d):
    n = views.records(spark, d).where("surname is not null and townland_norm is not null").groupBy("townland_norm", "surname").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("townland_norm").agg(F.min(F.struct((-F.col("n")).alias("k"), "surname")).alias("m")).select("townland_norm", F.col("m.surname").alias("surname"), (-F.col("m.k")).alias("n"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:2] in ("j_", "s_", "w_", "l_") and callable(f)}

SQL = {
    "j_inner_dim": f"WITH {views.CATALOGUE} SELECT id, record_id, year, townland_norm, catalogue.parish, catalogue.county FROM unified_record JOIN catalogue ON name = townland_norm WHERE has_eviction_record = 1",
    "j_left_catalog_counts": f"WITH {views.CATALOGUE} SELECT name, parish, coalesce((SELECT count(DISTINCT record_id) FROM unified_record WHERE townland_norm = name), 0) AS records FROM catalogue",
    "j_left_on_predicate": f"WITH {views.CATALOGUE}, {views.CENSUS} SELECT name, total AS total_1841 FROM catalogue LEFT JOIN census ON townland_norm = name AND year = 1841",
    "j_self_siblings": f"WITH {views.CATALOGUE}, {_PLACE_SQL} SELECT a.name AS asked, b.name, b.parish FROM catalogue a JOIN place ON a.name = townland_norm JOIN catalogue b ON b.parish = a.parish AND b.name <> a.name",
    "j_temporal_change": f"WITH {views.CENSUS} SELECT a.townland_norm, a.total AS before, b.total AS after, b.total - a.total AS change FROM census a JOIN census b USING (townland_norm) WHERE a.year = 1841 AND b.year = 1851",
    "j_pct_change_nullif": f"WITH {views.CENSUS} SELECT townland_norm, floor((b.total - a.total) * 1000.0::DOUBLE / nullif(a.total, 0)) / 10 AS percent FROM census a JOIN census b USING (townland_norm) WHERE a.year = 1841 AND b.year = 1851",
    "j_latest_per_key": "WITH r AS (SELECT * FROM unified_record WHERE has_tenancy_record = 1 AND holding_acres IS NOT NULL AND year IS NOT NULL), m AS (SELECT record_id, max(year) AS y FROM r GROUP BY 1) SELECT r.record_id, m.y AS year, max(holding_acres) AS acres FROM r JOIN m ON r.record_id = m.record_id AND r.year = m.y GROUP BY 1, 2",
    "j_same_place_same_year_both_events": "WITH a AS (SELECT townland_norm, year, count(*) AS emigrants FROM unified_record WHERE has_emigration_record = 1 GROUP BY 1, 2), b AS (SELECT townland_norm, year, count(*) AS evicted FROM unified_record WHERE has_eviction_record = 1 GROUP BY 1, 2) SELECT townland_norm, year, emigrants, evicted FROM a JOIN b USING (townland_norm, year)",
    "j_semi_in_subquery": "SELECT id, record_id, surname, townland_norm FROM unified_record e WHERE has_eviction_record = 1 AND EXISTS (SELECT 1 FROM unified_record g WHERE g.has_emigration_record = 1 AND g.surname = e.surname AND g.townland_norm = e.townland_norm)",
    "j_anti_gaps": f"WITH {views.CATALOGUE} SELECT DISTINCT townland_norm FROM unified_record WHERE townland_norm IS NOT NULL AND townland_norm NOT IN (SELECT name FROM catalogue)",
    "j_cross_top1_compare": f"WITH {views.CENSUS} SELECT * FROM (SELECT townland_norm AS place_1841, total AS total_1841 FROM census WHERE year = 1841 ORDER BY total DESC, 1 LIMIT 1), (SELECT townland_norm AS place_1861, total AS total_1861 FROM census WHERE year = 1861 ORDER BY total DESC, 1 LIMIT 1)",
    "j_three_way_cte": f"WITH {views.CENSUS}, e AS (SELECT townland_norm, count(DISTINCT record_id) AS emigrants FROM unified_record WHERE has_emigration_record = 1 GROUP BY 1) SELECT e.townland_norm, emigrants, a.total AS p1841, b.total AS p1861 FROM e LEFT JOIN census a ON a.townland_norm = e.townland_norm AND a.year = 1841 LEFT JOIN census b ON b.townland_norm = e.townland_norm AND b.year = 1861",
    "j_fanout_literal": f"WITH {views.CENSUS} SELECT c.year, count(DISTINCT record_id) AS emigrants, CAST(sum(total) AS BIGINT) AS fanned_total FROM census c LEFT JOIN (SELECT townland_norm, record_id FROM unified_record WHERE has_emigration_record = 1) e USING (townland_norm) GROUP BY 1",
    "j_preagg_fixed": f"WITH {views.CENSUS}, e AS (SELECT CAST(floor(year / 10) * 10 + 1 AS INTEGER) AS year, count(DISTINCT record_id) AS emigrants FROM unified_record WHERE has_emigration_record = 1 AND year IS NOT NULL GROUP BY 1), c AS (SELECT year, CAST(sum(total) AS BIGINT) AS total FROM census GROUP BY 1) SELECT c.year, total, coalesce(emigrants, 0) AS emigrants FROM c LEFT JOIN e USING (year)",
    "j_group_presence": f"WITH {views.CENSUS}, {views.HERITAGE} SELECT CASE WHEN townland_norm IN (SELECT upper(trim(name)) FROM townland WHERE name IS NOT NULL AND entity_id IN (SELECT entity_id FROM heritage WHERE feature_group = 'ring_fort')) THEN 'with' ELSE 'without' END AS group_label, count(*) AS places, CAST(sum(total) AS BIGINT) AS people, max(total) AS most FROM census WHERE year = 1841 GROUP BY 1",
    "j_range_time": "SELECT s.event_id AS signup_id, e.event_id, e.user_id FROM events e JOIN events s ON s.user_id = e.user_id AND s.event_type = 'signup' AND e.ts >= s.ts AND e.ts < s.ts + INTERVAL 1 HOUR WHERE e.event_type = 'purchase'",
    "j_asof_last": "SELECT event_id, (SELECT c.event_id FROM events c WHERE c.event_type = 'click' AND c.user_id = e.user_id AND c.ts <= e.ts ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) AS click_id FROM events e WHERE event_type = 'error'",
    "s_union_all_metrics": f"WITH {views.CENSUS} SELECT 'evicted' AS metric, CAST(count(DISTINCT record_id) AS VARCHAR) AS value FROM unified_record WHERE has_eviction_record = 1 UNION ALL SELECT 'emigrated', CAST(count(DISTINCT record_id) AS VARCHAR) FROM unified_record WHERE has_emigration_record = 1 UNION ALL SELECT 'first_year', CAST(min(year) AS VARCHAR) FROM unified_record UNION ALL SELECT 'places', CAST(count(*) AS VARCHAR) FROM townland UNION ALL SELECT 'people_1841', CAST(CAST(sum(total) AS BIGINT) AS VARCHAR) FROM census WHERE year = 1841",
    "s_distinct_list": "SELECT DISTINCT ship_name FROM unified_record WHERE has_emigration_record = 1 AND trim(ship_name) <> ''",
    "s_set_operations": "WITH g AS (SELECT DISTINCT surname FROM unified_record WHERE surname IS NOT NULL AND has_emigration_record = 1), h AS (SELECT DISTINCT surname FROM unified_record WHERE surname IS NOT NULL AND has_tenancy_record = 1) SELECT surname, 'both' AS kind FROM (SELECT * FROM g INTERSECT SELECT * FROM h) UNION ALL SELECT surname, 'gone only' FROM (SELECT * FROM g EXCEPT SELECT * FROM h)",
    "w_count_over_partition": f"WITH {views.CATALOGUE} SELECT name, parish, count(*) OVER (PARTITION BY parish) AS in_parish FROM catalogue WHERE parish IS NOT NULL",
    "w_cumulative_first_year": "WITH f AS (SELECT record_id, min(year) AS year FROM unified_record WHERE has_emigration_record = 1 AND year IS NOT NULL GROUP BY 1), b AS (SELECT year, count(*) AS new FROM f GROUP BY 1) SELECT year, new, CAST((SELECT sum(new) FROM b x WHERE x.year <= b.year) AS BIGINT) AS so_far FROM b",
    "w_topn_per_group": "WITH n AS (SELECT parish, surname, count(DISTINCT record_id) AS records FROM unified_record WHERE parish IS NOT NULL AND surname IS NOT NULL GROUP BY 1, 2) SELECT parish, surname, records, CAST(row_number() OVER (PARTITION BY parish ORDER BY records DESC, surname) AS INTEGER) AS place FROM n QUALIFY place <= 3",
    "w_nearest_year": f"WITH {views.CENSUS} SELECT townland_norm, year, total FROM census QUALIFY row_number() OVER (PARTITION BY townland_norm ORDER BY abs(year - 1848), year) = 1",
    "w_first_last_change": f"WITH {views.CENSUS} SELECT townland_norm, arg_min(total, year) AS first, arg_max(total, year) AS last, arg_max(total, year) - arg_min(total, year) AS change, count(*) AS years FROM census GROUP BY 1",
    "w_lag_year_change": f"WITH {views.CLEARANCES} SELECT townland_norm, year, evictions, evictions - lag(evictions) OVER (PARTITION BY townland_norm ORDER BY year) AS change FROM clearances",
    "w_rate_window": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour FROM events",
    "w_nearest_rank_percentiles": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(CASE WHEN i = CAST(floor(n * 0.5) AS BIGINT) THEN value END) AS p50, max(CASE WHEN i = CAST(floor(n * 0.9) AS BIGINT) THEN value END) AS p90, max(CASE WHEN i = CAST(floor(n * 0.95) AS BIGINT) THEN value END) AS p95 FROM r GROUP BY 1",
    "l_page_offset": "SELECT id, record_id, surname, year FROM unified_record WHERE has_tenancy_record = 1 ORDER BY surname NULLS LAST, id LIMIT 20 OFFSET 40",
    "l_topk_ties": "WITH n AS (SELECT surname, count(DISTINCT record_id) AS records FROM unified_record WHERE surname IS NOT NULL GROUP BY 1) SELECT surname, records FROM n WHERE records >= (SELECT min(records) FROM (SELECT records FROM n ORDER BY records DESC LIMIT 10))",
    "l_people_of_place": f"WITH {_PLACE_SQL} SELECT DISTINCT record_id, coalesce(nullif(trim(canonical_name), ''), nullif(trim(coalesce(trim(forename), '') || ' ' || coalesce(trim(surname), '')), '')) AS person, year, role FROM unified_record JOIN place USING (townland_norm)",
    "l_people_both_events": "SELECT surname, forename, townland_norm, count(DISTINCT record_id) AS records FROM unified_record WHERE surname IS NOT NULL GROUP BY 1, 2, 3 HAVING max(has_emigration_record) = 1 AND max(has_eviction_record) = 1",
    "l_heads_of_household": "SELECT id, record_id, surname, forename, year FROM unified_record WHERE relationship_to_head_of_household ILIKE '%head%' OR role ILIKE 'head%'",
    "l_keyword_search": "SELECT id, record_id FROM unified_record WHERE regexp_matches(lower(concat_ws(chr(10), surname, forename, townland, parish, occupation, comments)), 'slated|weaver|cabin')",
    "l_surname_suggest": "WITH s AS (SELECT trim(surname) AS s FROM unified_record UNION ALL SELECT trim(chief_tenant_surname) FROM unified_record) SELECT DISTINCT array_to_string(list_transform(string_split(lower(s), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS surname FROM s WHERE regexp_matches(s, '^[A-Za-z][A-Za-z'' -]+$') AND lower(s) LIKE 'd%' ORDER BY 1 LIMIT 50",
    "l_tenancy_tree": "SELECT trim(coalesce(trim(chief_tenant_forename) || ' ', '') || trim(chief_tenant_surname)) AS chief, townland_norm, count(DISTINCT trim(coalesce(trim(under_tenant_forename) || ' ', '') || trim(under_tenant_surname))) AS under_tenants, min(trim(coalesce(trim(under_tenant_forename) || ' ', '') || trim(under_tenant_surname))) AS first_under_tenant FROM unified_record WHERE trim(chief_tenant_surname) <> '' AND trim(under_tenant_surname) <> '' GROUP BY 1, 2",
    "l_mode_per_place": "WITH n AS (SELECT townland_norm, surname, count(*) AS n FROM unified_record WHERE surname IS NOT NULL AND townland_norm IS NOT NULL GROUP BY 1, 2) SELECT townland_norm, surname, n FROM n QUALIFY row_number() OVER (PARTITION BY townland_norm ORDER BY n DESC, surname) = 1",
}
