"""Views of the estate model over the stored tables, as DataFrames and as SQL.

The stored tables hold no census, clearance or heritage table; these are derived
from records and descriptions, so that every operator has data to run on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demesne.runtime import table


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "unified_record")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "townland")


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(townland_norm, year, total, male, female, uninhabited): household sizes summed by place and decade."""
    r = records(spark, sf_dir).where("townland_norm is not null and year is not null")
    head = F.coalesce("family_size_estimate", F.lit(1))
    male = F.upper(F.trim("gender")).isin("M", "MALE")
    female = F.upper(F.trim("gender")).isin("F", "FEMALE")
    return r.groupBy("townland_norm", (F.floor(F.col("year") / 10) * 10 + 1).cast("int").alias("year")).agg(
        F.sum(head).alias("total"),
        F.count(F.when(male, 1)).alias("male"),
        F.count(F.when(female, 1)).alias("female"),
        F.count(F.when(F.col("household_list").isNull(), 1)).alias("uninhabited"),
    )


def clearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(townland_norm, year, evictions): distinct evicted records by place and year."""
    r = records(spark, sf_dir).where("townland_norm is not null and year is not null and has_eviction_record = 1")
    return r.groupBy("townland_norm", "year").agg(F.countDistinct("record_id").alias("evictions"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, parish, barony, county): one row a canonical townland name, the least value of each attribute."""
    p = places(spark, sf_dir).where("name is not null")
    return p.groupBy(F.upper(F.trim("name")).alias("name")).agg(F.min("civil_parish").alias("parish"), F.min("barony").alias("barony"), F.min("county").alias("county"))


def heritage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, feature_group): features that descriptions mention."""
    d = table(spark, sf_dir, "field_provenance").where("field_name = 'description' and field_value is not null")
    low = F.lower("field_value")
    group = F.when(low.contains("fort"), "ring_fort").when(low.contains("well"), "holy_well").when(low.contains("kiln"), "lime_kiln")
    return d.select("entity_id", group.alias("feature_group")).where("feature_group is not null").distinct()


#: The same views for the SQL that checks the queries.
CENSUS = """census AS (SELECT townland_norm, CAST(floor(year / 10) * 10 + 1 AS INTEGER) AS year,
  CAST(sum(coalesce(family_size_estimate, 1)) AS BIGINT) AS total,
  count(CASE WHEN upper(trim(gender)) IN ('M', 'MALE') THEN 1 END) AS male,
  count(CASE WHEN upper(trim(gender)) IN ('F', 'FEMALE') THEN 1 END) AS female,
  count(CASE WHEN household_list IS NULL THEN 1 END) AS uninhabited
  FROM unified_record WHERE townland_norm IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2)"""
CLEARANCES = """clearances AS (SELECT townland_norm, year, count(DISTINCT record_id) AS evictions FROM unified_record
  WHERE townland_norm IS NOT NULL AND year IS NOT NULL AND has_eviction_record = 1 GROUP BY 1, 2)"""
CATALOGUE = """catalogue AS (SELECT upper(trim(name)) AS name, min(civil_parish) AS parish, min(barony) AS barony, min(county) AS county
  FROM townland WHERE name IS NOT NULL GROUP BY 1)"""
HERITAGE = """heritage AS (SELECT DISTINCT entity_id, CASE WHEN lower(field_value) LIKE '%fort%' THEN 'ring_fort'
  WHEN lower(field_value) LIKE '%well%' THEN 'holy_well' WHEN lower(field_value) LIKE '%kiln%' THEN 'lime_kiln' END AS feature_group
  FROM field_provenance WHERE field_name = 'description' AND (lower(field_value) LIKE '%fort%' OR lower(field_value) LIKE '%well%' OR lower(field_value) LIKE '%kiln%'))"""
