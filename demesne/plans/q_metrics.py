"""Queries of the semantic layer and the scalar and grouped counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from demesne.plans import views
from demesne.plans.metrics import Slots, compile_slots
from demesne.runtime import table

_FILLS: dict[str, tuple[Slots, str]] = {
    "q_slotfill_emigration_count": (Slots("emigration_count", ("year", "ship")), "SELECT year, ship_name AS ship, count(DISTINCT record_id) AS value FROM unified_record WHERE has_emigration_record = 1 GROUP BY 1, 2"),
    "q_slotfill_canada_emigration_count": (Slots("canada_emigration_count", ("year",), {"year_range": (1840, 1860)}), "SELECT year, count(DISTINCT record_id) AS value FROM unified_record WHERE has_emigration_record = 1 AND is_canada_destination = 1 AND year BETWEEN 1840 AND 1860 GROUP BY 1"),
    "q_slotfill_eviction_event_count": (Slots("eviction_event_count", ("townland",), limit=20), f"WITH {views.CLEARANCES} SELECT townland_norm AS townland, CAST(sum(evictions) AS BIGINT) AS value FROM clearances GROUP BY 1 ORDER BY value DESC, townland LIMIT 20"),
    "q_slotfill_evicted_person_count": (Slots("evicted_person_count", ("parish",)), "SELECT parish, count(DISTINCT record_id) AS value FROM unified_record WHERE has_eviction_record = 1 GROUP BY 1"),
    "q_slotfill_population": (Slots("population", ("year",)), f"WITH {views.CENSUS} SELECT year, CAST(sum(total) AS BIGINT) AS value FROM census GROUP BY 1"),
    "q_slotfill_population_change": (Slots("population_change", ("townland",)), f"WITH {views.CENSUS} SELECT a.townland_norm AS townland, CAST(sum(b.total) - sum(a.total) AS BIGINT) AS value FROM census a JOIN census b USING (townland_norm) WHERE a.year = 1841 AND b.year = 1851 GROUP BY 1"),
    "q_slotfill_uninhabited_houses": (Slots("uninhabited_houses", ("year",)), f"WITH {views.CENSUS} SELECT year, CAST(sum(uninhabited) AS BIGINT) AS value FROM census WHERE uninhabited > 0 GROUP BY 1"),
    "q_slotfill_tenancy_count": (Slots("tenancy_count", ("townland",)), "SELECT townland_norm AS townland, count(DISTINCT record_id) AS value FROM unified_record WHERE has_tenancy_record = 1 GROUP BY 1"),
    "q_slotfill_avg_holding_acres": (Slots("avg_holding_acres", ("gender",)), "SELECT CASE WHEN upper(trim(gender)) IN ('M', 'MALE') THEN 'Male' WHEN upper(trim(gender)) IN ('F', 'FEMALE') THEN 'Female' ELSE 'Unknown' END AS gender, CAST(round(CAST(sum(CAST(holding_acres AS DECIMAL(18, 3))) / CAST(count(*) AS DECIMAL(18, 0)) AS DECIMAL(18, 7)), 2) AS DOUBLE) AS value FROM unified_record WHERE has_tenancy_record = 1 AND holding_acres IS NOT NULL GROUP BY 1"),
    "q_slotfill_widow_count": (Slots("widow_count", ("year",)), "SELECT year, count(DISTINCT record_id) AS value FROM unified_record WHERE is_widow = 1 GROUP BY 1"),
    "q_slotfill_person_count": (Slots("person_count", ("surname",), {"is_tenant": True}), "SELECT upper(trim(surname)) AS surname, count(DISTINCT record_id) AS value FROM unified_record WHERE coalesce(has_tenancy_record, 0) = 1 GROUP BY 1"),
    "q_slotfill_townland_count": (Slots("townland_count", ("county",)), "SELECT county, count(*) AS value FROM townland GROUP BY 1"),
    "q_slotfill_parish_count": (Slots("parish_count"), "SELECT count(DISTINCT civil_parish) AS value FROM townland WHERE trim(civil_parish) <> ''"),
    "q_slotfill_townland_attribute": (Slots("townland_attribute", ("name", "parish", "barony", "county")), f"WITH {views.CATALOGUE} SELECT name, parish, barony, county, count(*) AS value FROM catalogue GROUP BY 1, 2, 3, 4"),
}


def _fill(slots: Slots):
    return lambda spark, d: compile_slots(spark, d, slots)


def m_count_distinct(spark, d):
    r = views.records(spark, d)
    return r.agg(*[F.countDistinct(F.when(F.col(f) == 1, F.col("record_id"))).alias(a) for f, a in (("has_emigration_record", "emigrated"), ("has_eviction_record", "evicted"), ("has_tenancy_record", "tenants"))], F.countDistinct("record_id").alias("records"))


def m_count_by_year(spark, d):
    return views.records(spark, d).groupBy("year", "role").agg(F.countDistinct("record_id").alias("records"), F.count(F.lit(1)).alias("entries"))


def m_count_by_place(spark, d):
    return views.records(spark, d).where("has_emigration_record = 1").groupBy("townland_norm").agg(F.countDistinct("record_id").alias("emigrants"))


def m_count_by_parent(spark, d):
    r = views.records(spark, d).groupBy("townland_norm").agg(F.countDistinct("record_id").alias("n"))
    c = views.catalogue(spark, d).select(F.col("name").alias("townland_norm"), "parish")
    return r.join(c, "townland_norm").groupBy("parish").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("townlands"))


def m_count_by_role(spark, d):
    return views.records(spark, d).where("trim(role) <> ''").groupBy("role").agg(F.countDistinct("record_id").alias("records"), F.countDistinct("surname").alias("surnames"))


def m_sum_by_year(spark, d):
    return views.clearances(spark, d).groupBy("year").agg(F.sum("evictions").alias("evictions"), F.max("evictions").alias("worst"))


def m_avg_round_by_group(spark, d):
    h = F.col("holding_acres").cast("decimal(18,3)")
    return views.records(spark, d).where("holding_acres is not null").groupBy("townland_norm").agg(F.round(F.avg(h), 2).cast("double").alias("avg_acres"), F.min("holding_acres").alias("least"), F.max("holding_acres").alias("most"))


def m_group_case_alias(spark, d):
    r = views.records(spark, d)
    kind = F.when(F.col("has_emigration_record") == 1, "emigration").when(F.col("has_eviction_record") == 1, "eviction").when(F.col("has_tenancy_record") == 1, "tenancy").otherwise("record")
    return r.groupBy(kind.alias("record_type")).agg(F.countDistinct("record_id").alias("records"))


def m_having_min3(spark, d):
    r = views.records(spark, d).where("has_tenancy_record = 1 and holding_acres is not null")
    return r.groupBy("townland_norm").agg(F.countDistinct("record_id").alias("tenants"), F.min("holding_acres").alias("smallest")).where("tenants >= 3")


def m_worst_year_top1(spark, d):
    return views.clearances(spark, d).groupBy("year").agg(F.sum("evictions").alias("evictions")).orderBy(F.desc("evictions"), "year").limit(1)


def m_flag_combo_counts(spark, d):
    return views.records(spark, d).groupBy("has_emigration_record", "has_eviction_record", "has_tenancy_record").agg(F.count(F.lit(1)).alias("n"))


def m_profile_one_row(spark, d):
    r = views.records(spark, d).agg(F.countDistinct("record_id").alias("records"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("townland_norm").alias("places_named"), F.countDistinct("surname").alias("surnames"))
    t = views.places(spark, d).agg(F.count(F.lit(1)).alias("places"), F.countDistinct("civil_parish").alias("parishes"))
    # two one-row results
    return r.join(F.broadcast(t))


def m_filter_clause_counts(spark, d):
    return views.records(spark, d).groupBy("parish").agg(*[F.countDistinct(F.when(c, F.col("record_id"))).alias(a) for c, a in ((F.col("has_emigration_record") == 1, "emigrants"), (F.col("has_eviction_record") == 1, "evicted"), (F.col("is_widow") == 1, "widows"))])


def m_cond_distinct_ratio(spark, d):
    w = views.records(spark, d).where("is_widow = 1").select("record_id", "children_count").groupBy("record_id").agg(F.max(F.coalesce("children_count", F.lit(0))).alias("c"))
    return w.agg(F.count(F.lit(1)).alias("widows"), F.count(F.when(F.col("c") > 0, 1)).alias("with_children")).withColumn("percent", F.floor(F.col("with_children") * 1000 / F.expr("nullif(widows, 0)")) / 10)


def m_nested_family_range(spark, d):
    f = views.records(spark, d).where("has_eviction_record = 1 and instr(family_key, '|') > 0 and family_size_estimate is not null").groupBy("family_key").agg(F.max("family_size_estimate").alias("size"))
    return f.agg(F.count(F.lit(1)).alias("families"), F.min("size").alias("least"), F.max("size").alias("most"), F.sum("size").alias("people"))


def m_families_by_ship(spark, d):
    r = views.records(spark, d).where("has_emigration_record = 1 and is_canada_destination = 1 and trim(ship_name) <> ''")
    key = F.coalesce(F.expr("nullif(trim(family_key), '')"), F.concat_ws("|", F.coalesce("surname", F.lit("")), F.coalesce("townland_norm", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit(""))))
    return r.groupBy("ship_name").agg(F.countDistinct(key).alias("families"))


def m_order_priority_rollup(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return o.groupBy("year", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.sum(price).cast("double").alias("revenue"))


def m_rollup_place(spark, d):
    c = views.places(spark, d)
    return c.rollup("county", "barony").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


QUERIES = {name: _fill(slots) for name, (slots, _) in _FILLS.items()} | {f.__name__: f for f in (m_count_distinct, m_count_by_year, m_count_by_place, m_count_by_parent, m_count_by_role, m_sum_by_year, m_avg_round_by_group, m_group_case_alias, m_having_min3, m_worst_year_top1, m_flag_combo_counts, m_profile_one_row, m_filter_clause_counts, m_cond_distinct_ratio, m_nested_family_range, m_families_by_ship, m_order_priority_rollup, m_rollup_place)}

_AVG = "CAST(round(CAST(sum(CAST(holding_acres AS DECIMAL(18, 3))) / CAST(count(*) AS DECIMAL(18, 0)) AS DECIMAL(18, 7)), 2) AS DOUBLE)"
SQL = {name: sql for name, (_, sql) in _FILLS.items()} | {
    "m_count_distinct": "SELECT count(DISTINCT CASE WHEN has_emigration_record = 1 THEN record_id END) AS emigrated, count(DISTINCT CASE WHEN has_eviction_record = 1 THEN record_id END) AS evicted, count(DISTINCT CASE WHEN has_tenancy_record = 1 THEN record_id END) AS tenants, count(DISTINCT record_id) AS records FROM unified_record",
    "m_count_by_year": "SELECT year, role, count(DISTINCT record_id) AS records, count(*) AS entries FROM unified_record GROUP BY 1, 2",
    "m_count_by_place": "SELECT townland_norm, count(DISTINCT record_id) AS emigrants FROM unified_record WHERE has_emigration_record = 1 GROUP BY 1",
    "m_count_by_parent": f"WITH {views.CATALOGUE}, r AS (SELECT townland_norm, count(DISTINCT record_id) AS n FROM unified_record GROUP BY 1) SELECT parish, CAST(sum(n) AS BIGINT) AS records, count(*) AS townlands FROM r JOIN catalogue ON name = townland_norm GROUP BY 1",
    "m_count_by_role": "SELECT role, count(DISTINCT record_id) AS records, count(DISTINCT surname) AS surnames FROM unified_record WHERE trim(role) <> '' GROUP BY 1",
    "m_sum_by_year": f"WITH {views.CLEARANCES} SELECT year, CAST(sum(evictions) AS BIGINT) AS evictions, max(evictions) AS worst FROM clearances GROUP BY 1",
    "m_avg_round_by_group": f"SELECT townland_norm, {_AVG} AS avg_acres, min(holding_acres) AS least, max(holding_acres) AS most FROM unified_record WHERE holding_acres IS NOT NULL GROUP BY 1",
    "m_group_case_alias": "SELECT CASE WHEN has_emigration_record = 1 THEN 'emigration' WHEN has_eviction_record = 1 THEN 'eviction' WHEN has_tenancy_record = 1 THEN 'tenancy' ELSE 'record' END AS record_type, count(DISTINCT record_id) AS records FROM unified_record GROUP BY 1",
    "m_having_min3": "SELECT townland_norm, count(DISTINCT record_id) AS tenants, min(holding_acres) AS smallest FROM unified_record WHERE has_tenancy_record = 1 AND holding_acres IS NOT NULL GROUP BY 1 HAVING count(DISTINCT record_id) >= 3",
    "m_worst_year_top1": f"WITH {views.CLEARANCES} SELECT year, CAST(sum(evictions) AS BIGINT) AS evictions FROM clearances GROUP BY 1 ORDER BY evictions DESC, year LIMIT 1",
    "m_flag_combo_counts": "SELECT has_emigration_record, has_eviction_record, has_tenancy_record, count(*) AS n FROM unified_record GROUP BY 1, 2, 3",
    "m_profile_one_row": "SELECT count(DISTINCT record_id) AS records, min(year) AS first_year, max(year) AS last_year, count(DISTINCT townland_norm) AS places_named, count(DISTINCT surname) AS surnames, (SELECT count(*) FROM townland) AS places, (SELECT count(DISTINCT civil_parish) FROM townland) AS parishes FROM unified_record",
    "m_filter_clause_counts": "SELECT parish, count(DISTINCT record_id) FILTER (WHERE has_emigration_record = 1) AS emigrants, count(DISTINCT record_id) FILTER (WHERE has_eviction_record = 1) AS evicted, count(DISTINCT record_id) FILTER (WHERE is_widow = 1) AS widows FROM unified_record GROUP BY 1",
    "m_cond_distinct_ratio": "WITH w AS (SELECT record_id, max(coalesce(children_count, 0)) AS c FROM unified_record WHERE is_widow = 1 GROUP BY 1) SELECT count(*) AS widows, count(CASE WHEN c > 0 THEN 1 END) AS with_children, floor(count(CASE WHEN c > 0 THEN 1 END) * 1000.0::DOUBLE / nullif(count(*), 0)) / 10 AS percent FROM w",
    "m_nested_family_range": "WITH f AS (SELECT family_key, max(family_size_estimate) AS size FROM unified_record WHERE has_eviction_record = 1 AND instr(family_key, '|') > 0 AND family_size_estimate IS NOT NULL GROUP BY 1) SELECT count(*) AS families, min(size) AS least, max(size) AS most, CAST(sum(size) AS BIGINT) AS people FROM f",
    "m_families_by_ship": "SELECT ship_name, count(DISTINCT coalesce(nullif(trim(family_key), ''), coalesce(surname, '') || '|' || coalesce(townland_norm, '') || '|' || coalesce(CAST(year AS VARCHAR), ''))) AS families FROM unified_record WHERE has_emigration_record = 1 AND is_canada_destination = 1 AND trim(ship_name) <> '' GROUP BY 1",
    "m_order_priority_rollup": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue FROM orders GROUP BY 1, 2",
    "m_rollup_place": "SELECT county, barony, count(*) AS n, CAST(grouping_id(county, barony) AS INTEGER) AS level FROM townland GROUP BY ROLLUP (county, barony)",
}
