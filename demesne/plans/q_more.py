"""Tiered matching, name resolution, identity clusters, linearised subgraphs, dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from demesne.functions import cleaning as C
from demesne.functions.geometry import EARTH_KM
from demesne.functions.similarity import jaro_winkler_col
from demesne.operators import er, graph
from demesne.plans import views
from demesne.plans.q_graph import _HOPS, _hierarchy, _seed
from demesne.plans.q_graph import _C as _CENTROIDS_SQL
from demesne.plans.q_graph import _base, _centroids
from demesne.runtime import cut, table


def x_tiered_match(spark, d):
    """Mentions against records: same name, place and year within one is high, name and place medium, name only low; a better tier hides the worse."""
    m = table(spark, d, "source_mentions").select("id", F.upper(F.trim("surname")).alias("surname"), F.upper(F.trim("forename")).alias("forename"), F.upper(F.trim("raw_place")).alias("place"), "event_year").distinct().where("surname is not null and forename is not null")
    r = views.records(spark, d).groupBy(F.upper(F.trim("surname")).alias("surname"), F.upper(F.trim("forename")).alias("forename"), F.upper(F.trim("townland_norm")).alias("rplace"), F.col("year").alias("ryear")).agg(F.countDistinct("record_id").alias("n"))
    met = m.join(r, ["surname", "forename"])
    place = F.coalesce(F.col("place") == F.col("rplace"), F.lit(False))
    near = F.coalesce(F.abs(F.col("event_year") - F.col("ryear")) <= 1, F.lit(False))
    tier = F.when(place & near, 1).when(place, 2).otherwise(3)
    best = met.groupBy("id", tier.alias("tier")).agg(F.sum("n").alias("records")).groupBy("id").agg(F.min(F.struct("tier", "records")).alias("b"))
    return best.select("id", F.element_at(F.array(F.lit("High"), F.lit("Medium"), F.lit("Low")), F.col("b.tier")).alias("confidence"), F.col("b.records").alias("records"))


def x_resolve_names(spark, d):
    """Alias, exact name, then nearest name by trigrams: (query, name, method) of every written name of other sources."""
    p = views.places(spark, d).where("name is not null")
    catalogue = p.where("source = 'json'").select(F.upper("name").alias("name")).distinct()
    aliases = table(spark, d, "townland_aliases").select(F.upper("alias").alias("query"), F.upper("canonical_name").alias("target")).distinct()
    q = p.where("source <> 'json'").select(F.upper("name").alias("query")).unionByName(aliases.select("query")).distinct()
    by_alias = q.join(aliases, "query").select("query", F.col("target").alias("name"), F.lit("alias").alias("method"))
    rest = q.join(by_alias, "query", "left_anti")
    exact = rest.join(catalogue, rest["query"] == catalogue["name"]).select("query", "name", F.lit("exact").alias("method"))
    rest = rest.join(exact, "query", "left_anti")
    near = er.trigram_cosine(rest.select(F.lower("query").alias("query")), catalogue.select(F.lower("name").alias("name")), "query", "name", 1, 0.55).select(F.upper("query").alias("query"), F.upper("name").alias("name"), F.lit("near").alias("method"))
    none = rest.join(near, "query", "left_anti").select("query", F.lit(None).cast("string").alias("name"), F.lit("none").alias("method"))
    return by_alias.unionByName(exact).unionByName(near).unionByName(none)


def x_identity_clusters(spark, d):
    """People of one place and sound key whose names are alike, grouped: likely one identity under several records."""
    r = views.records(spark, d).where("surname is not null and townland_norm is not null").groupBy("surname", "forename", "townland_norm").agg(F.min("record_id").alias("rid"), F.countDistinct("record_id").alias("n"))
    r = r.withColumn("k", F.concat_ws("|", er.skeleton(F.col("surname")), F.substring("forename", 1, 1), "townland_norm"))
    side = lambda s: r.select("k", *[F.col(c).alias(f"{c}_{s}") for c in ("rid", "surname", "forename")])
    pairs = side("a").join(side("b"), "k").where("rid_a < rid_b")
    score = 0.7 * jaro_winkler_col(F.upper("surname_a"), F.upper("surname_b")) + 0.3 * F.coalesce(jaro_winkler_col(F.upper("forename_a"), F.upper("forename_b")), F.lit(0.5))
    groups = graph.components(pairs.where(score >= 0.85), "rid_a", "rid_b")
    return groups.groupBy("component").agg(F.count(F.lit(1)).alias("spellings"))


def x_linearised(spark, d):
    """The pruned neighbourhood of a place as lines of text."""
    e = cut(_hierarchy(spark, d))
    near = graph.induced(e, graph.k_hops(e, _seed(spark, d), 2))
    label = lambda c: F.regexp_replace(c, "^[a-z]+:", "")
    return graph.prune(near, F.lit(1), 200).select(F.concat_ws(" ", label("src"), F.lower(F.regexp_replace("rel", "([a-z])([A-Z])", "$1 $2")), label("dst")).alias("line"))


def x_law_of_cosines(spark, d):
    b = F.broadcast(_base(spark, d))
    c = _centroids(spark, d).join(b).where("id <> base_id")
    inner = F.sin(F.radians("lat")) * F.sin(F.radians("blat")) + F.cos(F.radians("lat")) * F.cos(F.radians("blat")) * F.cos(F.radians(F.col("lon") - F.col("blon")))
    return c.select("id", (F.floor(EARTH_KM * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), inner))) * 100 + 0.5) / 100).alias("km"))


def x_top_forenames(spark, d):
    return views.records(spark, d).where("trim(forename) <> ''").groupBy(F.upper(F.trim("forename")).alias("forename")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "forename").limit(400)


def x_longest_place_in_text(spark, d):
    """Per test item the longest canonical name its text holds: words meet words, so texts aren't held against every name."""
    names = views.places(spark, d).where("source = 'json'").select(F.upper("name").alias("name")).distinct().withColumn("head", F.split("name", " ")[0])
    t = table(spark, d, "eval_items").select("item_id", F.upper("text").alias("t"))
    words = t.select("item_id", "t", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit("([A-Z]+)"), F.lit(1)))).alias("head"))
    hit = words.join(names, "head").where(F.col("t").contains(F.col("name")))
    return hit.groupBy("item_id").agg(F.max(F.struct(F.length("name").alias("l"), "name")).alias("m"), F.countDistinct("name").alias("names")).select("item_id", F.col("m.name").alias("name"), "names")


def x_place_lookup(spark, d):
    """Places found by any of three keys: words, letters only, normalised."""
    p = views.places(spark, d).where("name is not null").select("id", C.word_key(F.col("name")).alias("w"), C.compact_key(F.col("name")).alias("c"), C.norm_place(F.col("name")).alias("n"))
    q = table(spark, d, "source_mentions").select("raw_place").where("raw_place is not null").distinct().select("raw_place", C.compact_key(F.col("raw_place")).alias("c"))
    return q.join(p.groupBy("c").agg(F.min("id").alias("place_id"), F.countDistinct("w").alias("spellings")), "c").where("c <> ''").select("raw_place", "place_id", "spellings")


def x_family_groups(spark, d):
    """Households of a family key: members, span and listed names."""
    r = views.records(spark, d).where("instr(family_key, '|') > 0")
    members = F.size(F.filter(F.split(F.coalesce("household_list", F.lit("")), "[,;]"), lambda x: F.trim(x) != ""))
    return r.groupBy("family_key").agg(F.countDistinct("record_id").alias("records"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.max(members).alias("listed"))


def x_feedback_memory(spark, d):
    """Memory of decisions: per unordered pair how often it was approved and rejected, the verdict by majority, and how often it was asked again."""
    r = table(spark, d, "match_review").where("townland_id_a is not null and townland_id_b is not null")
    status = F.lower(F.trim("status"))
    m = r.groupBy(F.least("townland_id_a", "townland_id_b").alias("u"), F.greatest("townland_id_a", "townland_id_b").alias("v")).agg(F.count(F.when(status == "confirmed", 1)).alias("approved"), F.count(F.when(status == "rejected", 1)).alias("rejected"), (F.count(F.lit(1)) - 1).alias("reused"))
    verdict = F.when(F.col("approved") > F.col("rejected"), "approved").when(F.col("rejected") > F.col("approved"), "rejected").otherwise("open")
    return m.withColumn("verdict", verdict)


def x_area_ratio(spark, d):
    p = views.places(spark, d).where("area_sqm > 0 and name is not null")
    a = p.groupBy("name").agg(F.min("area_sqm").alias("least"), F.max("area_sqm").alias("most"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return a.select("name", (F.floor(F.col("least") / F.col("most") * 10000 + 0.5) / 10000).alias("ratio"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("x_") and callable(f)}

_TG = "list_transform(range(1, length(n) + 3), lambda i: substr('  ' || n || '  ', i, 3))"
SQL = {
    "x_tiered_match": "WITH m AS (SELECT DISTINCT id, upper(trim(surname)) AS surname, upper(trim(forename)) AS forename, upper(trim(raw_place)) AS place, event_year FROM source_mentions WHERE surname IS NOT NULL AND forename IS NOT NULL), r AS (SELECT upper(trim(surname)) AS surname, upper(trim(forename)) AS forename, upper(trim(townland_norm)) AS rplace, year AS ryear, count(DISTINCT record_id) AS n FROM unified_record GROUP BY 1, 2, 3, 4), t AS (SELECT id, CASE WHEN coalesce(place = rplace, false) AND coalesce(abs(event_year - ryear) <= 1, false) THEN 1 WHEN coalesce(place = rplace, false) THEN 2 ELSE 3 END AS tier, n FROM m JOIN r USING (surname, forename)), g AS (SELECT id, tier, CAST(sum(n) AS BIGINT) AS records FROM t GROUP BY 1, 2) SELECT id, ['High', 'Medium', 'Low'][tier] AS confidence, records FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier) = 1",
    "x_resolve_names": f"WITH c AS (SELECT DISTINCT upper(name) AS name FROM townland WHERE source = 'json' AND name IS NOT NULL), al AS (SELECT DISTINCT upper(alias) AS query, upper(canonical_name) AS target FROM townland_aliases), q AS (SELECT DISTINCT upper(name) AS query FROM townland WHERE source <> 'json' AND name IS NOT NULL UNION SELECT query FROM al), r AS (SELECT query FROM q WHERE query NOT IN (SELECT query FROM al) AND query NOT IN (SELECT name FROM c)), qv AS (SELECT n, g, count(*) AS tf FROM (SELECT n, unnest({_TG}) AS g FROM (SELECT lower(query) AS n FROM r)) GROUP BY 1, 2), cv AS (SELECT n, g, count(*) AS tf FROM (SELECT n, unnest({_TG}) AS g FROM (SELECT lower(name) AS n FROM c)) GROUP BY 1, 2), qn AS (SELECT n, sqrt(sum(tf * tf)) AS l FROM qv GROUP BY 1), cn AS (SELECT n, sqrt(sum(tf * tf)) AS l FROM cv GROUP BY 1), s AS (SELECT qv.n AS query, cv.n AS name, sum(qv.tf * cv.tf) / (any_value(qn.l) * any_value(cn.l)) AS cosine FROM qv JOIN cv USING (g) JOIN qn ON qn.n = qv.n JOIN cn ON cn.n = cv.n GROUP BY 1, 2), b AS (SELECT upper(query) AS query, upper(name) AS name FROM s WHERE cosine >= 0.55 QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, name) = 1) SELECT query, target AS name, 'alias' AS method FROM al UNION ALL SELECT query, query, 'exact' FROM q WHERE query NOT IN (SELECT query FROM al) AND query IN (SELECT name FROM c) UNION ALL SELECT r.query, b.name, CASE WHEN b.name IS NULL THEN 'none' ELSE 'near' END FROM r LEFT JOIN b USING (query)",
    "x_linearised": f"WITH {_HOPS}, p AS (SELECT src, dst FROM h WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k) ORDER BY src, dst LIMIT 200) SELECT regexp_replace(src, '^[a-z]+:', '') || ' within ' || regexp_replace(dst, '^[a-z]+:', '') AS line FROM p",
    "x_law_of_cosines": f"WITH {_CENTROIDS_SQL}, b AS (SELECT * FROM c ORDER BY id LIMIT 1) SELECT c.id, floor(6371.0::DOUBLE * acos(least(1.0, greatest(-1.0, sin(radians(c.lat)) * sin(radians(b.lat)) + cos(radians(c.lat)) * cos(radians(b.lat)) * cos(radians(c.lon - b.lon))))) * 100 + 0.5) / 100 AS km FROM c, b WHERE c.id <> b.id",
    "x_top_forenames": "SELECT upper(trim(forename)) AS forename, count(*) AS n FROM unified_record WHERE trim(forename) <> '' GROUP BY 1 ORDER BY n DESC, forename LIMIT 400",
    "x_longest_place_in_text": "WITH c AS (SELECT DISTINCT upper(name) AS name FROM townland WHERE source = 'json'), w AS (SELECT item_id, upper(text) AS t, regexp_extract_all(upper(text), '[A-Z]+') AS ws FROM eval_items), h AS (SELECT item_id, name FROM w JOIN c ON contains(t, name) AND list_contains(ws, string_split(name, ' ')[1])) SELECT item_id, arg_max(name, lpad(length(name)::VARCHAR, 4, '0') || name) AS name, count(DISTINCT name) AS names FROM h GROUP BY 1",
    "x_place_lookup": "WITH p AS (SELECT regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') AS c, min(id) AS place_id, count(DISTINCT array_to_string(regexp_extract_all(upper(name), '[A-Z0-9]+'), ' ')) AS spellings FROM townland WHERE name IS NOT NULL GROUP BY 1) SELECT DISTINCT raw_place, place_id, spellings FROM source_mentions JOIN p ON p.c = regexp_replace(upper(raw_place), '[^A-Z0-9]', '', 'g') WHERE p.c <> ''",
    "x_family_groups": "SELECT family_key, count(DISTINCT record_id) AS records, min(year) AS first_year, max(year) AS last_year, CAST(max(len(list_filter(string_split_regex(coalesce(household_list, ''), '[,;]'), lambda x: trim(x) <> ''))) AS INTEGER) AS listed FROM unified_record WHERE instr(family_key, '|') > 0 GROUP BY 1",
    "x_feedback_memory": "WITH m AS (SELECT least(townland_id_a, townland_id_b) AS u, greatest(townland_id_a, townland_id_b) AS v, count(CASE WHEN lower(trim(status)) = 'confirmed' THEN 1 END) AS approved, count(CASE WHEN lower(trim(status)) = 'rejected' THEN 1 END) AS rejected, count(*) - 1 AS reused FROM match_review WHERE townland_id_a IS NOT NULL AND townland_id_b IS NOT NULL GROUP BY 1, 2) SELECT *, CASE WHEN approved > rejected THEN 'approved' WHEN rejected > approved THEN 'rejected' ELSE 'open' END AS verdict FROM m",
    "x_area_ratio": "SELECT name, floor(min(area_sqm) / max(area_sqm) * 10000 + 0.5) / 10000 AS ratio FROM townland WHERE area_sqm > 0 AND name IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
}
