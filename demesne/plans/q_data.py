"""Cleaning, upserts, provenance and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from demesne.functions import cleaning as C
from demesne.operators import upsert
from demesne.plans import views
from demesne.runtime import table


def c_clean_text_num(spark, d):
    r = views.records(spark, d)
    return r.select("id", C.clean_text(F.col("comments")).alias("comments"), C.clean_gender(F.col("gender")).alias("gender"), C.to_int(F.col("acres").cast("string")).alias("acres_whole"))


def c_norm_place(spark, d):
    return views.records(spark, d).select("id", C.norm_place_unbracketed(F.col("townland_as_shown")).alias("place"))


def c_word_compact_keys(spark, d):
    return table(spark, d, "source_mentions").select("id", C.word_key(F.col("raw_place")).alias("words"), C.compact_key(F.col("raw_place")).alias("compact")).distinct()


def c_extract_year_regex(spark, d):
    return table(spark, d, "documents").select("doc_id", C.extract_year(F.col("text")).alias("year"))


def c_person_name_split(spark, d):
    p = C.split_person(F.regexp_replace(F.col("raw_name"), r"[\[(].*?[\])]", " "), surname_first=True)
    return table(spark, d, "source_mentions").select("id", p.alias("p")).select("id", "p.forename", "p.surname").distinct()


def c_decade_bucket(spark, d):
    return views.records(spark, d).groupBy(C.decade(F.col("year")).alias("decade")).agg(F.count(F.lit(1)).alias("n"))


def c_derived_household(spark, d):
    parts = [F.col(c) for c in ("sons", "daughters", "servants_male", "servants_female", "other_males_in_household", "other_famales_in_household")]
    return views.records(spark, d).select("id", C.children_count(F.col("sons"), F.col("daughters")).alias("children"), C.family_size(*parts).alias("size"), C.is_widow(F.col("forename"), F.col("role"), F.col("comments")).alias("widow"), C.is_canada(F.col("arrival")).alias("canada"))


def c_unpivot_wide_years(spark, d):
    wide = views.census(spark, d).where("year in (1841, 1851)").groupBy("townland_norm").pivot("year", [1841, 1851]).agg(F.sum("male").alias("Male"), F.sum("female").alias("Female"))
    wide = wide.select("townland_norm", *[F.col(c).alias(c.replace("_", " ")) for c in wide.columns if c != "townland_norm"])
    return upsert.unpivot_years(wide, "townland_norm", r"(\d{4}) (Male|Female)")


def c_json_props_map(spark, d):
    e = table(spark, d, "events")
    m = F.from_json("props", "map<string,string>")
    return e.select("event_type", F.explode(m).alias("key", "value")).groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("greatest"))


def c_payload_details(spark, d):
    m = F.from_json("source_payload_json", "map<string,string>")
    return table(spark, d, "source_mentions").where("source_payload_json is not null").select("id", m["register"].alias("register"), m["folio"].alias("folio")).distinct()


def c_html_strip(spark, d):
    return table(spark, d, "documents").select("doc_id", C.strip_html(F.col("text")).alias("text"))


def c_fold_accents(spark, d):
    return table(spark, d, "source_mentions").select("id", C.normalise_text(F.col("raw_place")).alias("place")).distinct()


def c_sanitise_cap(spark, d):
    return table(spark, d, "documents").select("doc_id", C.sanitise(F.col("text"), 300).alias("text"))


def c_estate_fields(spark, d):
    return views.records(spark, d).select("id", C.drop_brackets(F.col("canonical_name")).alias("name"))


def c_expand_forenames(spark, d):
    return views.records(spark, d).where("forename is not null").select("id", C.expand_forename(C.normalise_text(F.col("forename"))).alias("forename"))


def u_survivor_coalesce(spark, d):
    """Places of the dictionary source updated from the authority's, one row a name."""
    p = views.places(spark, d).where("name is not null")
    side = lambda s: p.where(F.col("source") == s).groupBy("name").agg(*[F.min(c).alias(c) for c in ("civil_parish", "barony", "county", "links_json", "logainm_id")])
    return upsert.merge_survivor(side("json"), side("kg"), "name", {"civil_parish": "new", "barony": "old", "county": "overwrite", "links_json": "list", "logainm_id": "new"})


def u_source_precedence(spark, d):
    p = views.places(spark, d).where("name is not null")
    return upsert.by_precedence([p.where(F.col("source") == s).select("name", "source", "id") for s in ("json", "kg", "osm")], ["name"])


def u_hash_diff_sync(spark, d):
    """What turns last year's documents into today's: odd sources as stored, texts as they are now."""
    docs = table(spark, d, "documents").where("text is not null")
    fresh = docs.where("doc_year is null or doc_year <> 1850").select("doc_id", F.sha2(F.trim("text"), 256).alias("content_hash"))
    stored = docs.where("doc_year is null or doc_year <> 1840").select("doc_id", F.sha2(F.col("text"), 256).alias("content_hash"))
    return upsert.hash_diff(stored, fresh, "doc_id")


def u_field_provenance(spark, d):
    return upsert.provenance(views.places(spark, d), "entity_id", ["name", "barony", "civil_parish", "area_sqm", "logainm_id"], F.lower("source"), "first_non_null").groupBy("field_name", "source", "rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("field_value").alias("values"))


def u_latest_delivery(spark, d):
    m = table(spark, d, "source_mentions").select("id", "source_record_id", "raw_place", "updated_at").distinct()
    return upsert.last_wins(m, ["id"], [F.col("updated_at").desc_nulls_last(), F.col("raw_place").asc_nulls_last()]).select("id", "source_record_id", "raw_place")


def u_insert_or_ignore(spark, d):
    """Graph edges of parishes: those of the dictionary stay, other sources add the places they lack."""
    p = views.places(spark, d).where("name is not null and civil_parish is not null").select(F.upper("name").alias("name"), F.col("civil_parish").alias("parish"), "id", "source")
    stored = upsert.last_wins(p.where("source = 'json'"), ["name"], [F.col("id")]).select("name", "parish", "id")
    return upsert.insert_or_ignore(stored, p.where("source <> 'json'").select("name", "parish", "id"), ["name"], [F.col("id")])


def u_clearance_upsert(spark, d):
    """Clearances by place and year: a later delivery's count replaces the earlier, unless it is empty."""
    c = views.clearances(spark, d)
    old = c.select("townland_norm", "year", "evictions")
    new = views.records(spark, d).where("townland_norm is not null and year is not null and year >= 1850").groupBy("townland_norm", "year").agg(F.nullif(F.count(F.when(F.col("has_eviction_record") == 1, 1)), F.lit(0)).alias("evictions"))
    key = F.concat_ws("|", "townland_norm", "year")
    out = upsert.merge_survivor(old.select(key.alias("key"), "evictions"), new.select(key.alias("key"), "evictions"), "key", {"evictions": "new"})
    return out.where("evictions is not null")


def u_census_upsert(spark, d):
    """Male and female summed into a missing total; null, not 0, where both are missing."""
    c = views.census(spark, d)
    old = c.where("year < 1851").select("townland_norm", "year", "male", "female", F.lit(None).cast("long").alias("total"))
    new = c.where("year >= 1841").select("townland_norm", "year", F.lit(None).cast("long").alias("male"), "female", "total")
    both = old.withColumn("seq", F.lit(1)).unionByName(new.withColumn("seq", F.lit(2)))
    agg = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    out = both.groupBy("townland_norm", "year").agg(agg("male"), agg("female"), agg("total"))
    return out.withColumn("total", F.coalesce("total", F.when(F.col("male").isNotNull() | F.col("female").isNotNull(), F.coalesce("male", F.lit(0)) + F.coalesce("female", F.lit(0)))))


def u_quality_report(spark, d):
    p = views.places(spark, d)
    return p.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in ("name", "barony", "civil_parish", "county", "wkt_geometry", "centroid_lat")], F.count(F.lit(1)).alias("rows"), F.countDistinct("entity_id").alias("entities"), (F.count("name") - F.countDistinct("name")).alias("repeated_names"))


def u_review_queue(spark, d):
    r = table(spark, d, "match_review")
    s = F.lower(C.ws_trim(F.col("status")))
    return r.where(s == "pending").select("id", "townland_id_a", "townland_id_b", "score").orderBy(F.desc("score"), "id").limit(100)


def u_status_counts(spark, d):
    return table(spark, d, "match_review").groupBy(F.coalesce(F.lower(C.ws_trim(F.col("status"))), F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def u_name_collisions(spark, d):
    n = views.places(spark, d).where("name is not null").groupBy(F.upper("name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))
    return n.where("n > 1")


QUERIES = {n: f for n, f in list(globals().items()) if n[:2] in ("c_", "u_") and callable(f) and getattr(f, "__module__", "") == __name__}

_TRIM = lambda c: f"regexp_replace({c}, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')"
_SP = lambda c: f"regexp_replace({c}, '\\s+', ' ', 'g')"
_NORM = lambda c: "upper(" + _TRIM(_SP(f"regexp_replace(replace(replace(translate({c}, '{C.ACCENTED}', '{C.PLAIN}'), '’', ''''), '‘', ''''), '[^A-Za-z0-9\\s''-]', ' ', 'g')")) + ")"
_PARTS = ("sons", "daughters", "servants_male", "servants_female", "other_males_in_household", "other_famales_in_household")
_SUM = " + ".join(f"coalesce({c}, 0)" for c in _PARTS)


def _expand_sql(c: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, ' '), lambda t: CASE " + " ".join(f"WHEN t = '{a}' THEN '{b}'" for a, b in C.ABBREVIATIONS.items()) + " ELSE t END), ' ')"


def _split_sql() -> str:
    tokens = f"list_filter(string_split({_NORM(chr(114))}, ' '), lambda t: t <> '' AND NOT regexp_full_match(t, '[-.]+'))"
    surname = "regexp_replace(regexp_replace(regexp_replace(k[1], '\\b(MC|MAC) ', '\\1', 'g'), '^MAC', 'MC'), '\\bO[''\\s]', 'O', 'g')"
    return f"WITH m AS (SELECT DISTINCT id, regexp_replace(raw_name, '[\\[(].*?[\\])]', ' ', 'g') AS r FROM source_mentions), k AS (SELECT id, {tokens} AS k FROM m) SELECT DISTINCT id, CASE WHEN len(k) > 1 THEN {_expand_sql('array_to_string(k[2:], chr(32))')} WHEN len(k) = 1 THEN '' END AS forename, CASE WHEN len(k) > 0 THEN {surname} END AS surname FROM k"


SQL = {
    "c_clean_text_num": f"SELECT id, CASE WHEN {_TRIM('comments')} <> '' AND lower({_TRIM('comments')}) <> 'nan' THEN {_TRIM('comments')} END AS comments, CASE WHEN upper({_TRIM('gender')}) IN ('M', 'MALE') THEN 'M' WHEN upper({_TRIM('gender')}) IN ('F', 'FEMALE') THEN 'F' END AS gender, CAST(trunc(acres) AS INTEGER) AS acres_whole FROM unified_record",
    "c_norm_place": "SELECT id, upper(" + _SP(_TRIM("regexp_replace(townland_as_shown, '\\([^)]*\\)', ' ', 'g')")) + ") AS place FROM unified_record",
    "c_word_compact_keys": "SELECT DISTINCT id, array_to_string(regexp_extract_all(upper(raw_place), '[A-Z0-9]+'), ' ') AS words, regexp_replace(upper(raw_place), '[^A-Z0-9]', '', 'g') AS compact FROM source_mentions",
    "c_extract_year_regex": "SELECT doc_id, try_cast(regexp_extract(text, '\\b(18\\d{2}|19[0-2]\\d)\\b', 1) AS INTEGER) AS year FROM documents",
    "c_person_name_split": _split_sql(),
    "c_decade_bucket": "SELECT CAST(floor(year / 10) * 10 AS INTEGER) AS decade, count(*) AS n FROM unified_record GROUP BY 1",
    "c_derived_household": f"SELECT id, CASE WHEN sons IS NOT NULL OR daughters IS NOT NULL THEN coalesce(sons, 0) + coalesce(daughters, 0) END AS children, CASE WHEN {_SUM} > 0 THEN {_SUM} + 1 END AS size, CAST(contains(' ' || lower(concat_ws(' ', forename, role, comments)), ' widow') AS INTEGER) AS widow, CAST(regexp_matches(lower(concat_ws(' ', arrival)), '" + "|".join(w.replace(".", "\\.") for w in C.CANADA) + "') AS INTEGER) AS canada FROM unified_record",
    "c_unpivot_wide_years": f"WITH {views.CENSUS}, p AS (SELECT DISTINCT townland_norm FROM census WHERE year IN (1841, 1851)), y AS (SELECT unnest([1841, 1851]) AS year), k AS (SELECT unnest(['male', 'female']) AS kind) SELECT p.townland_norm, CAST(y.year AS INTEGER) AS year, kind, CASE kind WHEN 'male' THEN male ELSE female END AS value FROM p CROSS JOIN y CROSS JOIN k LEFT JOIN census c ON c.townland_norm = p.townland_norm AND c.year = y.year",
    "c_json_props_map": "WITH k AS (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) SELECT event_type, key, count(*) AS n, max(json_extract_string(props, '$.' || key)) AS greatest FROM k GROUP BY 1, 2",
    "c_payload_details": "SELECT DISTINCT id, json_extract_string(source_payload_json, '$.register') AS register, json_extract_string(source_payload_json, '$.folio') AS folio FROM source_mentions WHERE source_payload_json IS NOT NULL",
    "c_html_strip": "SELECT doc_id, " + _TRIM(_SP("replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?is)<(script|style)\\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')")) + " AS text FROM documents",
    "c_fold_accents": f"SELECT DISTINCT id, {_NORM('raw_place')} AS place FROM source_mentions",
    "c_sanitise_cap": "SELECT doc_id, substr(regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}]', '', 'g'), 1, 300) AS text FROM documents",
    "c_estate_fields": "WITH n AS (SELECT id, " + _TRIM(_SP("regexp_replace(regexp_replace(regexp_replace(canonical_name, '\\[.*?\\]', '', 'g'), '\\(.*?\\)', '', 'g'), '\\?+', '', 'g')")) + " AS name FROM unified_record) SELECT id, CASE WHEN regexp_full_match(name, '[-\\s.]*') THEN '' ELSE name END AS name FROM n",
    "c_expand_forenames": f"SELECT id, {_expand_sql(_NORM('forename'))} AS forename FROM unified_record WHERE forename IS NOT NULL",
    "u_survivor_coalesce": "WITH o AS (SELECT name, min(civil_parish) AS cp, min(barony) AS b, min(county) AS c, min(links_json) AS l, min(logainm_id) AS g FROM townland WHERE source = 'json' AND name IS NOT NULL GROUP BY 1), n AS (SELECT name, min(civil_parish) AS cp, min(barony) AS b, min(county) AS c, min(links_json) AS l, min(logainm_id) AS g FROM townland WHERE source = 'kg' AND name IS NOT NULL GROUP BY 1) SELECT coalesce(n.name, o.name) AS name, coalesce(n.cp, o.cp) AS civil_parish, coalesce(o.b, n.b) AS barony, CASE WHEN n.name IS NOT NULL THEN n.c ELSE o.c END AS county, CASE WHEN n.l IS NOT NULL AND trim(n.l) <> '[]' THEN n.l ELSE coalesce(o.l, n.l) END AS links_json, coalesce(n.g, o.g) AS logainm_id FROM o FULL OUTER JOIN n ON o.name = n.name",
    "u_source_precedence": "WITH r AS (SELECT name, source, id, CASE source WHEN 'json' THEN 0 WHEN 'kg' THEN 1 ELSE 2 END AS k FROM townland WHERE name IS NOT NULL AND source IN ('json', 'kg', 'osm')) SELECT name, source, id FROM r WHERE k = (SELECT min(k) FROM r x WHERE x.name = r.name)",
    "u_hash_diff_sync": "WITH f AS (SELECT doc_id, trim(text, ' ') AS h FROM documents WHERE text IS NOT NULL AND (doc_year IS NULL OR doc_year <> 1850)), s AS (SELECT doc_id, text AS h FROM documents WHERE text IS NOT NULL AND (doc_year IS NULL OR doc_year <> 1840)) SELECT coalesce(f.doc_id, s.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'insert' WHEN f.doc_id IS NULL THEN 'delete' ELSE 'update' END AS action FROM f FULL OUTER JOIN s ON f.doc_id = s.doc_id WHERE f.doc_id IS NULL OR s.doc_id IS NULL OR f.h <> s.h",
    "u_field_provenance": "WITH l AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field_name, CAST({f} AS VARCHAR) AS v, lower(source) AS source FROM townland WHERE {f} IS NOT NULL" for f in ("name", "barony", "civil_parish", "area_sqm", "logainm_id")) + ") SELECT field_name, source, 'first_non_null' AS rule, count(*) AS n, count(DISTINCT v) AS values FROM l GROUP BY 1, 2",
    "u_latest_delivery": "SELECT id, source_record_id, raw_place FROM source_mentions QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, raw_place NULLS LAST) = 1",
    "u_insert_or_ignore": "WITH p AS (SELECT upper(name) AS name, civil_parish AS parish, id, source FROM townland WHERE name IS NOT NULL AND civil_parish IS NOT NULL) SELECT name, parish, id FROM p QUALIFY row_number() OVER (PARTITION BY name ORDER BY source <> 'json', id) = 1",
    "u_clearance_upsert": "WITH r AS (SELECT townland_norm || '|' || year AS key, count(DISTINCT CASE WHEN has_eviction_record = 1 THEN record_id END) AS a, nullif(count(CASE WHEN has_eviction_record = 1 THEN 1 END), 0) AS b, max(year) AS y, count(CASE WHEN has_eviction_record = 1 THEN 1 END) AS n FROM unified_record WHERE townland_norm IS NOT NULL AND year IS NOT NULL GROUP BY 1) SELECT key, CASE WHEN y >= 1850 THEN coalesce(b, CASE WHEN n > 0 THEN a END) ELSE a END AS evictions FROM r WHERE n > 0",
    "u_census_upsert": f"WITH {views.CENSUS}, o AS (SELECT * FROM census WHERE year < 1851), n AS (SELECT * FROM census WHERE year >= 1841) SELECT coalesce(n.townland_norm, o.townland_norm) AS townland_norm, coalesce(n.year, o.year) AS year, o.male, coalesce(n.female, o.female) AS female, coalesce(n.total, coalesce(o.male, 0) + coalesce(n.female, o.female, 0)) AS total FROM o FULL OUTER JOIN n ON o.townland_norm = n.townland_norm AND o.year = n.year",
    "u_quality_report": "SELECT " + ", ".join(f"count(*) - count({c}) AS null_{c}" for c in ("name", "barony", "civil_parish", "county", "wkt_geometry", "centroid_lat")) + ", count(*) AS rows, count(DISTINCT entity_id) AS entities, count(name) - count(DISTINCT name) AS repeated_names FROM townland",
    "u_review_queue": f"SELECT id, townland_id_a, townland_id_b, score FROM match_review WHERE lower({_TRIM('status')}) = 'pending' ORDER BY score DESC NULLS LAST, id LIMIT 100",
    "u_status_counts": f"SELECT coalesce(lower({_TRIM('status')}), 'none') AS status, count(*) AS n FROM match_review GROUP BY 1",
    "u_name_collisions": "SELECT upper(name) AS name, count(*) AS n, count(DISTINCT source) AS sources FROM townland WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
}
