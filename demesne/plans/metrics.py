"""Semantic layer: metrics, slots and their compilation to DataFrames.

A metric names a view, a measure, a base filter, the dimensions it can be
grouped by and the filters it takes.  ``compile_slots`` validates a ``Slots``
value and builds the plan; ordering rules: by year if grouped by year, else by
the measure descending, then by all dimensions, so every result has one order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demesne.plans import views

DEFAULT_LIMIT = 50
SUPERLATIVE_LIMIT = 10


@dataclass(frozen=True)
class Metric:
    view: Callable[[SparkSession, str], DataFrame]
    measure: Callable[[], Column]
    dims: dict[str, Callable[[], Column]] = field(default_factory=dict)
    filters: dict[str, Callable[[object], Column]] = field(default_factory=dict)
    base: Callable[[], Column] | None = None


@dataclass(frozen=True)
class Slots:
    metric: str
    group_by: tuple[str, ...] = ()
    filters: dict[str, object] = field(default_factory=dict)
    limit: int | None = None


def _col(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def _eq(name: str) -> Callable[[object], Column]:
    return lambda v: F.col(name) == F.lit(v)


def _folded(name: str) -> Callable[[object], Column]:
    return lambda v: F.upper(F.trim(F.col(name))) == F.upper(F.trim(F.lit(v)))


def _range(name: str) -> Callable[[object], Column]:
    return lambda v: F.col(name).between(*v)  # type: ignore[misc]


def _flag(name: str) -> Callable[[object], Column]:
    return lambda v: F.coalesce(F.col(name), F.lit(0)) == F.lit(int(bool(v)))


def gender_group() -> Column:
    g = F.upper(F.trim("gender"))
    return F.when(g.isin("M", "MALE"), "Male").when(g.isin("F", "FEMALE"), "Female").otherwise("Unknown")


def _records_metric(measure: Callable[[], Column], base: str | None, dims: str, filters: str) -> Metric:
    every_dim = {"year": _col("year"), "townland": _col("townland_norm"), "parish": _col("parish"), "ship": _col("ship_name"), "surname": lambda: F.upper(F.trim("surname")), "role": _col("role"), "gender": gender_group}
    every_filter = {
        "townland": _folded("townland_norm"),
        "year": _eq("year"),
        "year_range": _range("year"),
        "surname": _folded("surname"),
        "gender": lambda v: gender_group() == F.lit(str(v).capitalize()),
        "is_canada": _flag("is_canada_destination"),
        "is_widow": _flag("is_widow"),
        "is_emigrant": _flag("has_emigration_record"),
        "is_evicted": _flag("has_eviction_record"),
        "is_tenant": _flag("has_tenancy_record"),
    }
    return Metric(views.records, measure, {d: every_dim[d] for d in dims.split()}, {f: every_filter[f] for f in filters.split()}, (lambda: F.expr(base)) if base else None)


def _people() -> Column:
    return F.countDistinct("record_id")


def _population_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a place: its total in the first and the last census year asked for (1841 and 1851)."""
    c = views.census(spark, sf_dir).where(F.col("year").isin(1841, 1851))
    by = c.groupBy("townland_norm").agg(F.sum(F.when(F.col("year") == 1841, F.col("total"))).alias("a"), F.sum(F.when(F.col("year") == 1851, F.col("total"))).alias("b"))
    return by.where("a is not null and b is not null")


_PLACE = {"townland": _folded("townland_norm"), "year": _eq("year"), "year_range": _range("year")}
METRICS: dict[str, Metric] = {
    "emigration_count": _records_metric(_people, "has_emigration_record = 1", "year townland parish ship surname", "townland year year_range surname is_canada"),
    "canada_emigration_count": _records_metric(_people, "has_emigration_record = 1 and is_canada_destination = 1", "year ship", "year year_range"),
    "eviction_event_count": Metric(views.clearances, lambda: F.sum("evictions"), {"year": _col("year"), "townland": _col("townland_norm")}, _PLACE),
    "evicted_person_count": _records_metric(_people, "has_eviction_record = 1", "year townland parish", "townland year"),
    "population": Metric(views.census, lambda: F.sum("total"), {"year": _col("year"), "townland": _col("townland_norm")}, _PLACE),
    "population_change": Metric(_population_change, lambda: F.sum("b") - F.sum("a"), {"townland": _col("townland_norm")}, {"townland": _folded("townland_norm")}),
    "uninhabited_houses": Metric(views.census, lambda: F.sum("uninhabited"), {"year": _col("year"), "townland": _col("townland_norm")}, _PLACE, lambda: F.col("uninhabited") > 0),
    "tenancy_count": _records_metric(_people, "has_tenancy_record = 1", "year townland parish", "townland year"),
    "avg_holding_acres": _records_metric(lambda: F.round(F.avg(F.col("holding_acres").cast("decimal(18,3)")), 2).cast("double"), "has_tenancy_record = 1 and holding_acres is not null", "gender townland year", "townland gender"),
    "widow_count": _records_metric(_people, "is_widow = 1", "townland year", "townland year"),
    "person_count": _records_metric(_people, None, "year townland parish surname role", "townland year surname is_widow is_emigrant is_evicted is_tenant"),
    "townland_count": Metric(views.places, lambda: F.count(F.lit(1)), {"county": _col("county"), "barony": _col("barony"), "parish": _col("civil_parish")}, {"county": _folded("county"), "barony": _folded("barony"), "parish": _folded("civil_parish")}),
    "parish_count": Metric(views.places, lambda: F.countDistinct("civil_parish"), base=lambda: F.trim("civil_parish") != ""),
    "townland_attribute": Metric(views.catalogue, lambda: F.count(F.lit(1)), {"name": _col("name"), "parish": _col("parish"), "barony": _col("barony"), "county": _col("county")}, {"townland": _folded("name")}),
}


def validate(slots: Slots) -> None:
    m = METRICS.get(slots.metric)
    if m is None:
        raise ValueError(f"unknown metric {slots.metric!r}")
    for what, asked, known in (("dimension", slots.group_by, m.dims), ("filter", slots.filters, m.filters)):
        for name in asked:
            if name not in known:
                raise ValueError(f"{slots.metric} has no {what} {name!r}")
    if slots.limit is not None and slots.limit < 1:
        raise ValueError("a limit is at least 1")


def compile_slots(spark: SparkSession, sf_dir: str, slots: Slots) -> DataFrame:
    """Plan of a slot fill: the dimensions and ``value``."""
    validate(slots)
    m = METRICS[slots.metric]
    df = m.view(spark, sf_dir)
    if m.base:
        df = df.where(m.base())
    for name, v in slots.filters.items():
        df = df.where(m.filters[name](v))
    if not slots.group_by:
        return df.agg(m.measure().alias("value"))
    dims = [m.dims[d]().alias(d) for d in slots.group_by]
    out = df.groupBy(*dims).agg(m.measure().alias("value"))
    if slots.limit is None:
        return out
    by_year = "year" in slots.group_by
    order = [F.col("year").asc_nulls_last()] if by_year else [F.col("value").desc_nulls_last()]
    return out.orderBy(*order, *[F.col(d).asc_nulls_last() for d in slots.group_by]).limit(slots.limit)
