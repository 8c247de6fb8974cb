"""Problem 6: areas recorded in different measures, brought to statute acres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demesne.functions.units import HINT, MEASURES, stated_area

TOLERANCE = 0.02


def statute_areas(records: DataFrame) -> DataFrame:
    """Adds ``statute_acres``, ``area_source`` and ``text_unit_acres`` to unified records.

    ``statute_acres`` comes from the first of acres_english (statute),
    acres_irish (Irish acres), acres (statute, or the unit stated in the texts)
    and an area stated in full in the texts; null where none states one.  The
    texts are ``comments`` and ``holding_on_estate``, in this order; only rows
    whose text may state a unit and is needed go through the grammar.  Null,
    empty and other texts state nothing.
    """
    def stated(name: str) -> F.Column:
        needed = F.col(name).rlike(HINT) & F.col("acres_english").isNull() & F.col("acres_irish").isNull()
        return stated_area(F.when(needed, F.col(name)))

    r = records.withColumn("__a", stated("comments")).withColumn("__b", stated("holding_on_estate"))
    unit = F.coalesce("__a.unit_acres", "__b.unit_acres")
    written = F.coalesce(F.col("__a.value") * F.col("__a.unit_acres"), F.col("__b.value") * F.col("__b.unit_acres"))
    acres = F.coalesce(F.col("acres_english"), F.col("acres_irish") * MEASURES["irish"], F.col("acres") * F.coalesce(unit, F.lit(1.0)), written)
    source = F.when(F.col("acres_english").isNotNull(), "acres_english").when(F.col("acres_irish").isNotNull(), "acres_irish").when(F.col("acres").isNotNull(), "acres").when(written.isNotNull(), "text")
    return r.withColumn("statute_acres", acres).withColumn("area_source", source).withColumn("text_unit_acres", unit).drop("__a", "__b")


def misstated_holdings(records: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows whose holding_acres is filled and off by more than ``tolerance`` from the area the other fields give."""
    known = statute_areas(records.where(F.col("holding_acres").isNotNull())).where(F.col("statute_acres").isNotNull())
    return known.where(F.abs(F.col("holding_acres") - F.col("statute_acres")) > tolerance * F.abs(F.col("statute_acres")))
