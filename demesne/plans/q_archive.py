"""Result-side queries of the archive: place context, overview, insights, record search, profiles, lists by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demesne.functions import cleaning as C
from demesne.plans import views
from demesne.runtime import lookup_join, table

COUNTY = "WICKLOW"
#: Words of a question and the gap in the data they touch.
COVERAGE = {
    "age": ["age", " old", "years old", "elderly", "children", "child"],
    "gender": ["gender", "male", "female", "men", "women", "sex"],
    "ship": ["ship", "vessel", "voyage", "sailed", "aboard"],
    "religion": ["religion", "catholic", "protestant", "church", "faith", "denomination"],
}


def _flagged(flag: str) -> Column:
    return F.countDistinct(F.when(F.col(flag) == 1, F.col("record_id")))


def _ranked(df: DataFrame, by: list[str], order: list[Column | str], most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("int")).where(F.col("rank") <= most)


def _county(spark: SparkSession, d: str) -> DataFrame:
    return views.places(spark, d).where(F.upper(F.trim("county")) == COUNTY)


def a_context_summary(spark, d):
    """Per place of the catalogue: people, emigrated, evicted, tenants, first and last year."""
    r = views.records(spark, d).groupBy(F.col("townland_norm").alias("name")).agg(F.countDistinct("record_id").alias("people"), _flagged("has_emigration_record").alias("emigrated"), _flagged("has_eviction_record").alias("evicted"), _flagged("has_tenancy_record").alias("tenants"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return lookup_join(views.catalogue(spark, d), r, ["name"], "left").select("name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("people", "emigrated", "evicted", "tenants")], "first_year", "last_year")


def a_context_surnames(spark, d):
    """The twelve commonest surnames of every place."""
    n = views.records(spark, d).where("townland_norm is not null and trim(surname) <> ''").groupBy("townland_norm", "surname").agg(F.countDistinct("record_id").alias("people"))
    return _ranked(n, ["townland_norm"], [F.desc("people"), "surname"], 12)


def a_context_ships(spark, d):
    """The ten ships that took most emigrants of every place."""
    n = views.records(spark, d).where("townland_norm is not null and has_emigration_record = 1 and trim(ship_name) <> ''").groupBy("townland_norm", "ship_name").agg(F.countDistinct("record_id").alias("emigrants"))
    return _ranked(n, ["townland_norm"], [F.desc("emigrants"), "ship_name"], 10)


def a_context_census(spark, d):
    """Census rows of the places of the catalogue, the first fifty by year."""
    c = views.census(spark, d).join(views.catalogue(spark, d).select(F.col("name").alias("townland_norm")), "townland_norm", "left_semi")
    return _ranked(c, ["townland_norm"], ["year"], 50).drop("rank")


def a_context_clearances(spark, d):
    c = views.clearances(spark, d).join(views.catalogue(spark, d).select(F.col("name").alias("townland_norm")), "townland_norm", "left_semi")
    return _ranked(c, ["townland_norm"], ["year"], 50).drop("rank")


def a_context_people(spark, d):
    """Twenty-five people of every place, by year and name."""
    r = views.records(spark, d).where("townland_norm is not null").select("townland_norm", "id", C.person_display("canonical_name", "forename", "surname").alias("person"), "year", "role")
    return _ranked(r, ["townland_norm"], [F.col("year").asc_nulls_first(), F.col("person").asc_nulls_first(), "id"], 25).select("townland_norm", "rank", "person", "year", "role")


def a_record_search(spark, d, surname="mac", forename="a", townland="bally", year="18", estate="e"):
    """Records whose fields hold all the given texts, in any case; an empty text asks nothing."""
    r = views.records(spark, d)
    for field, text in (("surname", surname), ("forename", forename), ("townland", townland), ("year", year), ("estate", estate)):
        if text:
            r = r.where(F.coalesce(F.lower(F.col(field).cast("string")), F.lit("")).contains(text.lower()))
    return r.select("id", "surname", "forename", "townland", "year", "estate")


def a_overview(spark, d):
    """One row of the estate: places of the county and all records."""
    t = _county(spark, d)
    km2 = F.col("area_sqm").cast("decimal(24,6)")
    places = t.agg(
        F.count(F.lit(1)).alias("places"), F.countDistinct("civil_parish").alias("parishes"), F.countDistinct("barony").alias("baronies"), F.count(F.when(F.col("name_gaelic") != "", 1)).alias("gaelic_names"),
        F.count("centroid_lat").alias("located"), F.count(F.when(F.col("area_sqm") > 0, 1)).alias("with_area"), (F.floor(F.sum(km2) / 100000 + 0.5).cast("double") / 10).alias("area_sqkm"),
        F.max_by("name", F.struct(F.coalesce("area_sqm", F.lit(-1.0)), "id")).alias("largest"), F.min_by("name", F.when(F.col("area_sqm") > 0, F.struct("area_sqm", "id"))).alias("smallest"),
    )
    people = views.records(spark, d).agg(F.countDistinct("record_id").alias("records"), _flagged("has_emigration_record").alias("emigrants"), _flagged("has_eviction_record").alias("evicted"), _flagged("has_tenancy_record").alias("tenants"), _flagged("is_canada_destination").alias("to_canada"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    c = views.census(spark, d)
    total = lambda y: F.coalesce(F.sum(F.when(F.col("year") == y, F.col("total"))), F.lit(0))
    pop = c.agg(total(1841).alias("people_1841"), total(1851).alias("people_1851")).withColumn("decline_pct", F.floor((F.col("people_1841") - F.col("people_1851")) * 1000.0 / F.nullif(F.col("people_1841"), F.lit(0)) + 0.5) / 10)
    # three results of one row each
    return places.join(F.broadcast(people)).join(F.broadcast(pop))


def a_overview_top(spark, d):
    """The short lists of the overview: (list, rank, name, value)."""
    t, r = _county(spark, d), views.records(spark, d)
    c = views.census(spark, d).where("year = 1841").join(views.catalogue(spark, d).withColumnRenamed("name", "townland_norm"), "townland_norm")
    lists = [
        ("parishes by places", t.where("civil_parish is not null").groupBy(F.col("civil_parish").alias("name")).agg(F.count(F.lit(1)).alias("value")), 5),
        ("places by people 1841", c.select(F.col("townland_norm").alias("name"), F.col("total").alias("value")), 5),
        ("parishes by people 1841", c.where("parish is not null").groupBy(F.col("parish").alias("name")).agg(F.sum("total").alias("value")), 5),
        ("surnames", r.where("surname <> ''").groupBy(F.col("surname").alias("name")).agg(F.countDistinct("record_id").alias("value")), 10),
        ("baronies by records", lookup_join(r.select("record_id", F.col("townland_norm").alias("name")), views.catalogue(spark, d), ["name"]).where("barony is not null").groupBy(F.col("barony").alias("name")).agg(F.countDistinct("record_id").alias("value")), 5),
    ]
    out = None
    for label, df, most in lists:
        # a top-k before the rank, so that no list is sorted in one task
        top = df.orderBy(F.desc("value"), "name").limit(most)
        part = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("value"), "name")).cast("int")).select(F.lit(label).alias("list"), "rank", "name", F.col("value").cast("long").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def a_insights_widows(spark, d):
    return views.records(spark, d).where("is_widow = 1").agg(F.countDistinct("record_id").alias("widows"), _flagged("has_eviction_record").alias("evicted"), F.countDistinct(F.when(F.col("children_count") > 0, F.col("record_id"))).alias("with_children"))


def a_insights_surnames(spark, d):
    """What is said of each surname: bearers, emigrants, evicted, tenants, first and last year."""
    return views.records(spark, d).where("surname is not null").groupBy(F.upper("surname").alias("surname")).agg(F.countDistinct("record_id").alias("people"), _flagged("has_emigration_record").alias("emigrants"), _flagged("has_eviction_record").alias("evicted"), _flagged("has_tenancy_record").alias("tenants"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def a_insights_peaks(spark, d):
    """Year of most evictions and of most emigrants, and the place of most people in a census: (what, label, value)."""
    r = views.records(spark, d)
    peak = lambda flag, what: r.where(f"{flag} = 1 and year is not null").groupBy("year").agg(F.countDistinct("record_id").alias("n")).agg(F.max(F.struct("n", (-F.col("year")).alias("y"))).alias("m")).select(F.lit(what).alias("what"), (-F.col("m.y")).cast("string").alias("label"), F.col("m.n").alias("value"))
    place = views.census(spark, d).agg(F.max_by(F.concat_ws(" ", "townland_norm", "year"), F.struct("total", "townland_norm", "year")).alias("label"), F.max("total").alias("value")).select(F.lit("most people").alias("what"), "label", "value")
    return peak("has_eviction_record", "most evictions").unionByName(peak("has_emigration_record", "most emigrants")).unionByName(place)


def a_column_profile(spark, d):
    """Values, nulls, least, greatest and mean of the numeric columns of the records."""
    r = views.records(spark, d)
    cols = ["year", "age", "acres_irish", "acres_english", "holding_acres", "rent_owed", "children_count"]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]))
    p = r.select(each.alias("x")).select("x.column", "x.v").groupBy("column")
    mean = (F.sum(F.col("v").cast("decimal(20,4)")) / F.count("v")).cast("double")
    return p.agg(F.count("v").alias("filled"), F.count(F.when(F.col("v").isNull(), 1)).alias("nulls"), F.countDistinct("v").alias("different"), F.min("v").alias("least"), F.max("v").alias("greatest"), (F.floor(mean * 100 + 0.5) / 100).alias("mean"))


def a_holding_acres(spark, d):
    """The holding's area by precedence (Irish, English, plain, second) as stored, and which field gave it."""
    order = ["acres_irish", "acres_english", "acres", "acres_2"]
    best = F.coalesce(*[F.col(c) for c in order])
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in order])
    return views.records(spark, d).select("id", best.alias("best"), source.alias("field")).where("best is not null")


def effective_surname(surname: str = "surname", chief: str = "chief_tenant_surname") -> Column:
    """The surname, else the chief tenant's if that reads as a name."""
    own = F.when(F.trim(surname) != "", F.trim(surname))
    return F.coalesce(own, F.when(F.col(chief).rlike(r"^[A-Za-z][A-Za-z' -]+$"), F.trim(chief)))


def a_effective_surnames(spark, d):
    return views.records(spark, d).select("record_id", effective_surname().alias("surname")).where("surname is not null").groupBy(F.upper("surname").alias("surname")).agg(F.countDistinct("record_id").alias("people"))


def a_county_exclusion(spark, d):
    """Places kept and left out when only the county counts; an unknown county is kept."""
    county = F.upper(F.trim("county"))
    kept = county.isNull() | (county == "") | county.contains(COUNTY)
    return views.places(spark, d).groupBy(F.when(kept, "kept").otherwise("left out").alias("verdict"), "source").agg(F.count(F.lit(1)).alias("n"))


def a_places_in_order(spark, d):
    """Per family its places in order of first appearance, each once."""
    r = views.records(spark, d).where("family_key is not null and townland_norm is not null")
    first = r.groupBy("family_key", "townland_norm").agg(F.min(F.struct(F.coalesce("year", F.lit(9999)).alias("y"), "id")).alias("at"))
    seq = F.array_sort(F.collect_list(F.struct("at", "townland_norm")))
    return first.groupBy("family_key").agg(F.array_join(F.transform(seq, lambda x: x["townland_norm"]), " > ").alias("places"), F.count(F.lit(1)).alias("n"))


def a_gold_join_top30(spark, d):
    """Labelled true pairs with their estate record and its parish, the thirty surest."""
    g = table(spark, d, "er_gold").where("gold_label = 'TRUE_MATCH'").select("gold_id", "wh_raw_name", "u_record_id", "confidence").distinct()
    r = views.records(spark, d).groupBy(F.col("record_id").alias("u_record_id")).agg(F.min("townland_norm").alias("name"), F.min("year").alias("year"))
    out = lookup_join(lookup_join(g, r, ["u_record_id"]), views.catalogue(spark, d).select("name", "parish"), ["name"], "left")
    return out.orderBy(F.desc_nulls_last("confidence"), "gold_id").limit(30).select("gold_id", "wh_raw_name", "u_record_id", "confidence", F.col("name").alias("townland"), "parish", "year")


def a_links_of_record(spark, d):
    """Per estate record the labelled entries linked to it, in order, and whether they are ambiguous."""
    g = table(spark, d, "er_gold").where("gold_label is not null and u_record_id is not null").select("u_record_id", "gold_id", "gold_label").distinct()
    linked = F.array_sort(F.collect_list(F.when(F.col("gold_label") == "TRUE_MATCH", F.col("gold_id"))))
    return g.groupBy("u_record_id").agg(F.array_join(linked, ",").alias("linked"), F.count(F.when(F.col("gold_label") == "TRUE_MATCH", 1)).alias("n"), F.count(F.lit(1)).alias("judged")).withColumn("ambiguous", (F.col("n") > 1).cast("int"))


def a_census_summary(spark, d):
    """Per census year: places, people, men, women; sums of nothing are 0."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return views.census(spark, d).groupBy("year").agg(F.countDistinct("townland_norm").alias("places"), zero("total"), zero("male"), zero("female"))


def a_census_list(spark, d):
    """Census rows of 1841 with parish and barony."""
    return lookup_join(views.census(spark, d).where("year = 1841").withColumnRenamed("townland_norm", "name"), views.catalogue(spark, d), ["name"], "left").select("name", "parish", "barony", "total", "male", "female")


def a_clearance_summary(spark, d):
    return views.clearances(spark, d).groupBy("year").agg(F.countDistinct("townland_norm").alias("places"), F.coalesce(F.sum("evictions"), F.lit(0)).alias("evictions"), F.max("evictions").alias("most"))


def a_place_overlay(spark, d):
    """Place rows of the archive, fields they lack filled from the graph's row of that name; names only the graph has are misses."""
    p = views.places(spark, d).where("name is not null").withColumn("key", F.upper(F.trim("name")))
    fields = ["civil_parish", "barony", "county", "name_gaelic"]
    kg = p.where("source = 'kg'").groupBy("key").agg(*[F.min(c).alias(f"kg_{c}") for c in fields])
    own = p.where("source = 'json'").groupBy("key").agg(*[F.min(c).alias(c) for c in fields])
    both = own.withColumn("own", F.lit(1)).join(kg.withColumn("kg", F.lit(1)), "key", "full_outer")
    state = F.when(F.col("own").isNull(), "miss").when(F.col("kg").isNull(), "archive only").otherwise("overlaid")
    return both.select("key", state.alias("state"), *[F.coalesce(c, f"kg_{c}").alias(c) for c in fields])


def a_availability(spark, d):
    """Per place what a question on people, ships and areas would find: available, partial_unavailable or no_data."""
    r = views.records(spark, d).where("townland_norm is not null").groupBy("townland_norm").agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in ("age", "ship_name", "holding_acres")])
    state = lambda c: F.when(F.col(c) == 0, "no_data").when(F.col(c) < F.col("n"), "partial_unavailable").otherwise("available")
    return r.select("townland_norm", *[state(c).alias(c) for c in ("age", "ship_name", "holding_acres")])


def a_coverage_warnings(spark, d):
    """Gaps in the data that the wording of each test item touches."""
    q = F.lower("text")
    any_of = lambda words: F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: q.contains(w)), F.lit(False))
    found = F.array_compact(F.array(F.when(q.contains("1821") & any_of(["population", "census", "trend"]), "census"), *[F.when(any_of(words), name) for name, words in COVERAGE.items()]))
    return table(spark, d, "eval_items").where("text is not null").select("item_id", F.array_join(found, ",").alias("warnings"))


def a_question_ngrams(spark, d):
    """Candidate names in each test item: runs of four words down to one, longest first, each once, at most eighty."""
    words = F.regexp_extract_all(F.upper("text"), F.lit("([A-Z']+)"), F.lit(1))
    t = table(spark, d, "eval_items").where("text is not null").select("item_id", words.alias("w"))
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    grams = F.slice(F.array_distinct(F.concat(*[runs(n) for n in (4, 3, 2, 1)])), 1, 80)
    return t.select("item_id", grams.alias("g")).select("item_id", F.size("g").alias("n"), F.get("g", F.lit(0)).alias("first"), F.element_at("g", -1).alias("last"))


def a_suggest(spark, d):
    """For every alias the eight canonical names that fit it best: the same, a beginning, a part, or a shared word."""
    names = views.places(spark, d).where("source = 'json' and name is not null").select(F.upper("name").alias("name")).distinct()
    asked = table(spark, d, "townland_aliases").where("trim(alias) <> ''").select(F.upper(F.trim("alias")).alias("asked")).distinct()
    # names and questions meet by their words and by their first four letters
    keys = lambda c: F.array_distinct(F.concat(F.split(c, " "), F.array(F.substring(c, 1, 4))))
    met = asked.select("asked", F.explode(keys(F.col("asked"))).alias("k")).join(names.select("name", F.explode(keys(F.col("name"))).alias("k")), "k").select("asked", "name").distinct()
    a, n = F.col("asked"), F.col("name")
    score = F.when(a == n, 100).when(F.startswith(n, a), 80).when(F.startswith(a, n), 70).when(n.contains(a) | a.contains(n), 60).otherwise(30)
    return _ranked(met.withColumn("score", score), ["asked"], [F.desc("score"), F.length("name"), "name"], 8)


def a_usefulness(spark, d):
    """How much the documents of a place add to what its records say: a score of 1 to 5."""
    docs = table(spark, d, "documents").where("text is not null and townland_norm is not null").groupBy(F.col("townland_norm").alias("name")).agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("sources"))
    r = views.records(spark, d).where("townland_norm is not null").groupBy(F.col("townland_norm").alias("name")).agg(F.countDistinct("record_id").alias("records"))
    both = docs.join(r, "name", "full_outer").na.fill(0)
    score = F.when(F.col("documents") == 0, 1).when(F.col("records") == 0, 2).when(F.col("sources") < 3, 3).when(F.col("documents") < F.col("records"), 4).otherwise(5)
    return both.select("name", "documents", "records", score.alias("score"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("a_") and callable(f)}

_FL = lambda flag: f"count(DISTINCT CASE WHEN {flag} = 1 THEN record_id END)"
_COLS = ["year", "age", "acres_irish", "acres_english", "holding_acres", "rent_owed", "children_count"]
_HAS = lambda words: "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"
SQL = {
    "a_context_summary": f"WITH {views.CATALOGUE}, r AS (SELECT townland_norm AS name, count(DISTINCT record_id) AS people, {_FL('has_emigration_record')} AS emigrated, {_FL('has_eviction_record')} AS evicted, {_FL('has_tenancy_record')} AS tenants, min(year) AS first_year, max(year) AS last_year FROM unified_record GROUP BY 1) SELECT c.name, coalesce(people, 0) AS people, coalesce(emigrated, 0) AS emigrated, coalesce(evicted, 0) AS evicted, coalesce(tenants, 0) AS tenants, first_year, last_year FROM catalogue c LEFT JOIN r USING (name)",
    "a_context_surnames": "SELECT townland_norm, surname, count(DISTINCT record_id) AS people, CAST(row_number() OVER (PARTITION BY townland_norm ORDER BY count(DISTINCT record_id) DESC, surname) AS INTEGER) AS rank FROM unified_record WHERE townland_norm IS NOT NULL AND trim(surname) <> '' GROUP BY 1, 2 QUALIFY rank <= 12",
    "a_context_ships": "SELECT townland_norm, ship_name, count(DISTINCT record_id) AS emigrants, CAST(row_number() OVER (PARTITION BY townland_norm ORDER BY count(DISTINCT record_id) DESC, ship_name) AS INTEGER) AS rank FROM unified_record WHERE townland_norm IS NOT NULL AND has_emigration_record = 1 AND trim(ship_name) <> '' GROUP BY 1, 2 QUALIFY rank <= 10",
    "a_context_census": f"WITH {views.CATALOGUE}, {views.CENSUS} SELECT * FROM census WHERE townland_norm IN (SELECT name FROM catalogue) QUALIFY row_number() OVER (PARTITION BY townland_norm ORDER BY year) <= 50",
    "a_context_clearances": f"WITH {views.CATALOGUE}, {views.CLEARANCES} SELECT * FROM clearances WHERE townland_norm IN (SELECT name FROM catalogue) QUALIFY row_number() OVER (PARTITION BY townland_norm ORDER BY year) <= 50",
    "a_context_people": "WITH p AS (SELECT townland_norm, id, coalesce(nullif(trim(canonical_name), ''), nullif(trim(coalesce(trim(forename), '') || ' ' || coalesce(trim(surname), '')), '')) AS person, year, role FROM unified_record WHERE townland_norm IS NOT NULL) SELECT townland_norm, CAST(row_number() OVER (PARTITION BY townland_norm ORDER BY year NULLS FIRST, person NULLS FIRST, id) AS INTEGER) AS rank, person, year, role FROM p QUALIFY rank <= 25",
    "a_record_search": "SELECT id, surname, forename, townland, year, estate FROM unified_record WHERE contains(lower(surname), 'mac') AND contains(lower(forename), 'a') AND contains(lower(townland), 'bally') AND contains(year::VARCHAR, '18') AND contains(lower(estate), 'e')",
    "a_overview": f"WITH {views.CENSUS}, t AS (SELECT * FROM townland WHERE upper(trim(county)) = '{COUNTY}'), p AS (SELECT count(*) AS places, count(DISTINCT civil_parish) AS parishes, count(DISTINCT barony) AS baronies, count(CASE WHEN name_gaelic <> '' THEN 1 END) AS gaelic_names, count(centroid_lat) AS located, count(CASE WHEN area_sqm > 0 THEN 1 END) AS with_area, floor(CAST(sum(CAST(area_sqm AS DECIMAL(24, 6))) AS DOUBLE) / 100000 + 0.5) / 10 AS area_sqkm, (SELECT name FROM t ORDER BY coalesce(area_sqm, -1) DESC, id DESC LIMIT 1) AS largest, (SELECT name FROM t WHERE area_sqm > 0 ORDER BY area_sqm, id LIMIT 1) AS smallest FROM t), r AS (SELECT count(DISTINCT record_id) AS records, {_FL('has_emigration_record')} AS emigrants, {_FL('has_eviction_record')} AS evicted, {_FL('has_tenancy_record')} AS tenants, {_FL('is_canada_destination')} AS to_canada, min(year) AS first_year, max(year) AS last_year FROM unified_record), c AS (SELECT CAST(coalesce(sum(CASE WHEN year = 1841 THEN total END), 0) AS BIGINT) AS people_1841, CAST(coalesce(sum(CASE WHEN year = 1851 THEN total END), 0) AS BIGINT) AS people_1851 FROM census) SELECT p.*, r.*, c.*, floor((people_1841 - people_1851) * 1000.0::DOUBLE / nullif(people_1841, 0) + 0.5) / 10 AS decline_pct FROM p, r, c",
    "a_overview_top": f"WITH {views.CATALOGUE}, {views.CENSUS}, c AS (SELECT n.name, n.parish, total FROM census JOIN catalogue n ON n.name = townland_norm WHERE year = 1841), l AS (SELECT 'parishes by places' AS list, civil_parish AS name, count(*) AS value, 5 AS k FROM townland WHERE upper(trim(county)) = '{COUNTY}' AND civil_parish IS NOT NULL GROUP BY 2 UNION ALL SELECT 'places by people 1841', name, total, 5 FROM c UNION ALL SELECT 'parishes by people 1841', parish, sum(total), 5 FROM c WHERE parish IS NOT NULL GROUP BY 2 UNION ALL SELECT 'surnames', surname, count(DISTINCT record_id), 10 FROM unified_record WHERE surname <> '' GROUP BY 2 UNION ALL SELECT 'baronies by records', barony, count(DISTINCT record_id), 5 FROM unified_record r JOIN catalogue n ON n.name = r.townland_norm WHERE barony IS NOT NULL GROUP BY 2) SELECT list, CAST(row_number() OVER (PARTITION BY list ORDER BY value DESC, name) AS INTEGER) AS rank, name, CAST(value AS BIGINT) AS value FROM l QUALIFY rank <= k",
    "a_insights_widows": f"SELECT count(DISTINCT record_id) AS widows, {_FL('has_eviction_record')} AS evicted, count(DISTINCT CASE WHEN children_count > 0 THEN record_id END) AS with_children FROM unified_record WHERE is_widow = 1",
    "a_insights_surnames": f"SELECT upper(surname) AS surname, count(DISTINCT record_id) AS people, {_FL('has_emigration_record')} AS emigrants, {_FL('has_eviction_record')} AS evicted, {_FL('has_tenancy_record')} AS tenants, min(year) AS first_year, max(year) AS last_year FROM unified_record WHERE surname IS NOT NULL GROUP BY 1",
    "a_insights_peaks": f"WITH {views.CENSUS}, e AS (SELECT year, count(DISTINCT record_id) AS n FROM unified_record WHERE has_eviction_record = 1 AND year IS NOT NULL GROUP BY 1), m AS (SELECT year, count(DISTINCT record_id) AS n FROM unified_record WHERE has_emigration_record = 1 AND year IS NOT NULL GROUP BY 1) (SELECT 'most evictions' AS what, year::VARCHAR AS label, n AS value FROM e ORDER BY n DESC, year LIMIT 1) UNION ALL (SELECT 'most emigrants', year::VARCHAR, n FROM m ORDER BY n DESC, year LIMIT 1) UNION ALL (SELECT 'most people', townland_norm || ' ' || year, total FROM census ORDER BY total DESC, townland_norm DESC, year DESC LIMIT 1)",
    "a_column_profile": " UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS filled, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS different, min({c})::DOUBLE AS least, max({c})::DOUBLE AS greatest, floor(CAST(sum(CAST({c} AS DECIMAL(20, 4))) AS DOUBLE) / count({c}) * 100 + 0.5) / 100 AS mean FROM unified_record" for c in _COLS),
    "a_holding_acres": "SELECT id, coalesce(acres_irish, acres_english, acres, acres_2) AS best, CASE WHEN acres_irish IS NOT NULL THEN 'acres_irish' WHEN acres_english IS NOT NULL THEN 'acres_english' WHEN acres IS NOT NULL THEN 'acres' ELSE 'acres_2' END AS field FROM unified_record WHERE coalesce(acres_irish, acres_english, acres, acres_2) IS NOT NULL",
    "a_effective_surnames": "WITH s AS (SELECT record_id, coalesce(CASE WHEN trim(surname) <> '' THEN trim(surname) END, CASE WHEN regexp_matches(chief_tenant_surname, '^[A-Za-z][A-Za-z'' -]+$') THEN trim(chief_tenant_surname) END) AS s FROM unified_record) SELECT upper(s) AS surname, count(DISTINCT record_id) AS people FROM s WHERE s IS NOT NULL GROUP BY 1",
    "a_county_exclusion": f"SELECT CASE WHEN county IS NULL OR trim(county) = '' OR contains(upper(county), '{COUNTY}') THEN 'kept' ELSE 'left out' END AS verdict, source, count(*) AS n FROM townland GROUP BY 1, 2",
    "a_places_in_order": "WITH f AS (SELECT family_key, townland_norm, min({'y': coalesce(year, 9999), 'id': id}) AS m FROM unified_record WHERE family_key IS NOT NULL AND townland_norm IS NOT NULL GROUP BY 1, 2) SELECT family_key, string_agg(townland_norm, ' > ' ORDER BY m, townland_norm) AS places, count(*) AS n FROM f GROUP BY 1",
    "a_gold_join_top30": f"WITH {views.CATALOGUE}, g AS (SELECT DISTINCT gold_id, wh_raw_name, u_record_id, confidence FROM er_gold WHERE gold_label = 'TRUE_MATCH'), r AS (SELECT record_id, min(townland_norm) AS name, min(year) AS year FROM unified_record GROUP BY 1) SELECT gold_id, wh_raw_name, u_record_id, confidence, r.name AS townland, parish, r.year FROM g JOIN r ON r.record_id = u_record_id LEFT JOIN catalogue c ON c.name = r.name ORDER BY confidence DESC NULLS LAST, gold_id LIMIT 30",
    "a_links_of_record": "WITH g AS (SELECT DISTINCT u_record_id, gold_id, gold_label FROM er_gold WHERE gold_label IS NOT NULL AND u_record_id IS NOT NULL) SELECT u_record_id, coalesce(string_agg(CASE WHEN gold_label = 'TRUE_MATCH' THEN gold_id END, ',' ORDER BY gold_id), '') AS linked, count(CASE WHEN gold_label = 'TRUE_MATCH' THEN 1 END) AS n, count(*) AS judged, CAST(count(CASE WHEN gold_label = 'TRUE_MATCH' THEN 1 END) > 1 AS INTEGER) AS ambiguous FROM g GROUP BY 1",
    "a_census_summary": f"WITH {views.CENSUS} SELECT year, count(DISTINCT townland_norm) AS places, CAST(coalesce(sum(total), 0) AS BIGINT) AS total, CAST(coalesce(sum(male), 0) AS BIGINT) AS male, CAST(coalesce(sum(female), 0) AS BIGINT) AS female FROM census GROUP BY 1",
    "a_census_list": f"WITH {views.CATALOGUE}, {views.CENSUS} SELECT townland_norm AS name, parish, barony, total, male, female FROM census LEFT JOIN catalogue c ON c.name = townland_norm WHERE year = 1841",
    "a_clearance_summary": f"WITH {views.CLEARANCES} SELECT year, count(DISTINCT townland_norm) AS places, CAST(coalesce(sum(evictions), 0) AS BIGINT) AS evictions, max(evictions) AS most FROM clearances GROUP BY 1",
    "a_place_overlay": "WITH p AS (SELECT *, upper(trim(name)) AS key FROM townland WHERE name IS NOT NULL), k AS (SELECT key, min(civil_parish) AS a, min(barony) AS b, min(county) AS c, min(name_gaelic) AS g, 1 AS kg FROM p WHERE source = 'kg' GROUP BY 1), o AS (SELECT key, min(civil_parish) AS a, min(barony) AS b, min(county) AS c, min(name_gaelic) AS g, 1 AS own FROM p WHERE source = 'json' GROUP BY 1) SELECT coalesce(o.key, k.key) AS key, CASE WHEN own IS NULL THEN 'miss' WHEN kg IS NULL THEN 'archive only' ELSE 'overlaid' END AS state, coalesce(o.a, k.a) AS civil_parish, coalesce(o.b, k.b) AS barony, coalesce(o.c, k.c) AS county, coalesce(o.g, k.g) AS name_gaelic FROM o FULL JOIN k ON o.key = k.key",
    "a_availability": "WITH r AS (SELECT townland_norm, count(*) AS n, count(age) AS a, count(ship_name) AS s, count(holding_acres) AS h FROM unified_record WHERE townland_norm IS NOT NULL GROUP BY 1) SELECT townland_norm, " + ", ".join(f"CASE WHEN {x} = 0 THEN 'no_data' WHEN {x} < n THEN 'partial_unavailable' ELSE 'available' END AS {c}" for x, c in (("a", "age"), ("s", "ship_name"), ("h", "holding_acres"))) + " FROM r",
    "a_coverage_warnings": "WITH e AS (SELECT item_id, lower(text) AS q FROM eval_items WHERE text IS NOT NULL) SELECT item_id, concat_ws(',', CASE WHEN contains(q, '1821') AND " + _HAS(["population", "census", "trend"]) + " THEN 'census' END, " + ", ".join(f"CASE WHEN {_HAS(w)} THEN '{n}' END" for n, w in COVERAGE.items()) + ") AS warnings FROM e",
    "a_question_ngrams": "WITH w AS (SELECT item_id, regexp_extract_all(upper(text), '[A-Z'']+') AS w FROM eval_items WHERE text IS NOT NULL), g AS (SELECT item_id, list_concat(list_concat(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))), list_concat(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')), w)) AS g FROM w), u AS (SELECT item_id, (list_filter(g, lambda x, i: list_position(g, x) = i))[:80] AS g FROM g) SELECT item_id, CAST(len(g) AS INTEGER) AS n, g[1] AS first, g[-1] AS last FROM u",
    "a_suggest": "WITH n AS (SELECT DISTINCT upper(name) AS name FROM townland WHERE source = 'json' AND name IS NOT NULL), a AS (SELECT DISTINCT upper(trim(alias)) AS asked FROM townland_aliases WHERE trim(alias) <> ''), m AS (SELECT asked, name FROM a, n WHERE list_has_any(list_append(string_split(asked, ' '), substr(asked, 1, 4)), list_append(string_split(name, ' '), substr(name, 1, 4)))), s AS (SELECT asked, name, CASE WHEN asked = name THEN 100 WHEN starts_with(name, asked) THEN 80 WHEN starts_with(asked, name) THEN 70 WHEN contains(name, asked) OR contains(asked, name) THEN 60 ELSE 30 END AS score FROM m) SELECT asked, name, score, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, length(name), name) AS INTEGER) AS rank FROM s QUALIFY rank <= 8",
    "a_usefulness": "WITH d AS (SELECT townland_norm AS name, count(*) AS documents, count(DISTINCT source) AS sources FROM documents WHERE text IS NOT NULL AND townland_norm IS NOT NULL GROUP BY 1), r AS (SELECT townland_norm AS name, count(DISTINCT record_id) AS records FROM unified_record WHERE townland_norm IS NOT NULL GROUP BY 1), b AS (SELECT name, coalesce(documents, 0) AS documents, coalesce(sources, 0) AS sources, coalesce(records, 0) AS records FROM d FULL JOIN r USING (name)) SELECT name, documents, records, CASE WHEN documents = 0 THEN 1 WHEN records = 0 THEN 2 WHEN sources < 3 THEN 3 WHEN documents < records THEN 4 ELSE 5 END AS score FROM b",
}
