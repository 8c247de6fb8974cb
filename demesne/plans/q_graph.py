"""Geospatial scalars and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demesne.functions.geometry import apart, bounds_col, haversine_km, iou_col, outline_centres, shape_flag_col, wkt_point
from demesne.operators import geo, graph
from demesne.plans import views
from demesne.plans.q_problems import _FIX, _POINT
from demesne.runtime import cut, hot_join, lookup_join, spread, table

NEAR = 5.0


def _centroids(spark, d):
    """Every place with a true location: errors of entry undone, else the POINT geometry."""
    p = views.places(spark, d)
    return geo.true_locations(p).join(p.select("id", "name"), "id")


def _base(spark, d):
    # one row: the place asked about
    return _centroids(spark, d).orderBy("id").limit(1).select(F.col("id").alias("base_id"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))


def _from_base(spark, d):
    b = F.broadcast(_base(spark, d))
    return _centroids(spark, d).join(b).where("id <> base_id").withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("blat"), F.col("blon")))


def g_haversine_round(spark, d):
    return _from_base(spark, d).select("id", (F.floor(F.col("km") * 1000 + 0.5) / 1000).alias("km"))


def g_radius_count(spark, d):
    """Records of the places within the radius of the base, by year."""
    near = _from_base(spark, d).where(F.col("km") <= NEAR).select(F.upper(F.trim("name")).alias("townland_norm")).distinct()
    return views.records(spark, d).join(near, "townland_norm", "left_semi").groupBy("year").agg(F.countDistinct("record_id").alias("records"))


def g_nearby_topk(spark, d):
    return _from_base(spark, d).withColumn("km", F.floor(F.col("km") * 1000 + 0.5) / 1000).orderBy("km", "id").limit(30).select("id", "name", "km")


def g_radius_pairs(spark, d):
    """Per place the number of other rows within 0.3 km, met through the radius grid."""
    p = geo.near_pairs(_centroids(spark, d), 0.3)
    return p.select(F.col("id_a").alias("id")).unionByName(p.select(F.col("id_b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("near"))


def g_bbox_center(spark, d):
    """Middle of the bounding box of the first part's shell, of every readable outline."""
    at = outline_centres("wkt_geometry")
    fixed = lambda c: (F.floor(F.col(c) * 1e7 + 0.5) / 1e7).alias(c.split(".")[1])
    return views.places(spark, d).where(F.col("wkt_geometry").ilike("%polygon%")).select("id", at.alias("at")).where("at.x is not null").select("id", fixed("at.x"), fixed("at.y"))


def g_point_parse(spark, d):
    at = wkt_point(F.col("wkt_geometry"))
    return views.places(spark, d).select("id", at.alias("at")).where("at is not null").select("id", "at.lat", "at.lon")


def g_valid_coordinates(spark, d):
    p = views.places(spark, d)
    kind = F.when(F.col("centroid_lat").isNull() | F.col("centroid_lon").isNull(), "missing").when((F.col("centroid_lat") == 0) & (F.col("centroid_lon") == 0), "void").when(F.col("centroid_lat").between(51, 56) & F.col("centroid_lon").between(-11, -4), "valid").otherwise("outside")
    return p.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _inside(spark, d, any_ring):
    p = views.places(spark, d)
    return geo.points_in_regions(geo.true_locations(p), geo.region_slabs(p, any_ring=any_ring)).where("id <> region").groupBy("region").agg(F.count(F.lit(1)).alias("inside"))


def g_pip_any_ring(spark, d):
    """Other places inside any ring of each polygon, by slabs of the rings."""
    return _inside(spark, d, True)


def g_pip_even_odd(spark, d):
    """Other places inside each polygon, holes excluded."""
    return _inside(spark, d, False)


def g_polygon_iou(spark, d):
    """Overlap of the outlines that rows of one name give, each pair once.

    An outline that several rows give is measured once; boxes that are apart need no measuring.
    """
    p = views.places(spark, d).where(F.col("wkt_geometry").ilike("%polygon%") & F.col("name").isNotNull()).select("id", F.upper("name").alias("name"), F.col("wkt_geometry").alias("w"))
    # bounded: 500 rows an outline
    p = p.withColumn("part", F.floor((F.row_number().over(W.partitionBy("name", "w").orderBy("id")) - 1) / 500)).groupBy("name", "w", "part").agg(F.collect_list("id").alias("ids"))
    p = cut(spread(p, "name", "w", "part").withColumn("box", bounds_col("w")).select("name", F.monotonically_increasing_id().alias("n"), "ids", "w", "box"))
    side = lambda s: p.select("name", *[F.col(c).alias(f"{c}_{s}") for c in ("n", "ids", "w", "box")])
    far = apart(F.col("box_a"), F.col("box_b"))
    x = hot_join(side("a"), side("b"), ["name"]).where("n_a <= n_b").withColumn("far", far)
    x = x.withColumn("iou", F.round(F.coalesce(F.when(F.col("far"), 0.0), iou_col(F.when(~F.col("far"), F.col("w_a")), F.when(~F.col("far"), F.col("w_b")))), 6))
    x = x.select(F.col("n_a") < F.col("n_b"), "iou", "ids_b", F.explode("ids_a").alias("i")).toDF("other", "iou", "ids_b", "i").select("other", "iou", "i", F.explode("ids_b").alias("k"))
    return x.where(F.col("other") & (F.col("i") != F.col("k")) | (F.col("i") < F.col("k"))).select(F.least("i", "k").alias("id_a"), F.greatest("i", "k").alias("id_b"), "iou")


def g_shape_flags(spark, d):
    return views.places(spark, d).groupBy(shape_flag_col("wkt_geometry").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


def g_mean_centroid(spark, d):
    """Mean of the corners of the first part's shell, the closing corner left out, of every readable outline."""
    at = outline_centres("wkt_geometry")
    return views.places(spark, d).where(F.col("wkt_geometry").ilike("%polygon%")).select("id", at.alias("at")).where("at.mean_x is not null").select("id", (F.floor(F.col("at.mean_x") * 1e6 + 0.5) / 1e6).alias("x"), (F.floor(F.col("at.mean_y") * 1e6 + 0.5) / 1e6).alias("y"))


def g_choropleth_bins(spark, d):
    """Places and people of 1841 by the map's classes: none, up to 40, 80, 140, 220, 350, and more."""
    c = views.census(spark, d).where("year = 1841")
    bins = F.when(F.col("total") > 350, 6).when(F.col("total") > 220, 5).when(F.col("total") > 140, 4).when(F.col("total") > 80, 3).when(F.col("total") > 40, 2).when(F.col("total") > 0, 1).otherwise(0)
    return c.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("places"), F.sum("total").alias("people"))


def nodes(spark, d):
    """(node, label, name) of places, parishes, baronies, counties, persons and events."""
    c, r = views.catalogue(spark, d), views.records(spark, d)
    part = lambda df, prefix, col, label: df.where(F.col(col).isNotNull()).select(F.concat(F.lit(prefix), F.col(col).cast("string")).alias("node"), F.lit(label).alias("label"), F.col(col).cast("string").alias("name")).distinct()
    out = part(c, "t:", "name", "Townland")
    for df, prefix, col, label in ((c, "p:", "parish", "CivilParish"), (c, "b:", "barony", "Barony"), (c, "c:", "county", "County"), (r, "r:", "record_id", "Person"), (r.where("has_emigration_record = 1 and trim(ship_name) <> ''"), "em:", "record_id", "EmigrationEvent"), (r.where("has_eviction_record = 1"), "ev:", "record_id", "EvictionEvent"), (r.where("has_emigration_record = 1 and trim(ship_name) <> ''"), "v:", "ship_name", "Voyage")):
        out = out.unionByName(part(df, prefix, col, label))
    return out


def edges(spark, d):
    """(src, dst, rel): hierarchy with the nearest known parent, persons, events and voyages."""
    c, r = views.catalogue(spark, d), views.records(spark, d)
    e = lambda df, a, pa, b, pb, rel: df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.concat(F.lit(pa), F.col(a).cast("string")).alias("src"), F.concat(F.lit(pb), F.col(b).cast("string")).alias("dst"), F.lit(rel).alias("rel")).distinct()
    em, ev = r.where("has_emigration_record = 1 and trim(ship_name) <> ''"), r.where("has_eviction_record = 1")
    parts = [
        e(c, "name", "t:", "parish", "p:", "WITHIN"),
        e(c.where("parish is null"), "name", "t:", "barony", "b:", "WITHIN"),
        e(c.groupBy("parish").agg(F.min("barony").alias("barony")), "parish", "p:", "barony", "b:", "WITHIN"),
        e(c.groupBy("barony").agg(F.min("county").alias("county")), "barony", "b:", "county", "c:", "WITHIN"),
        e(r, "record_id", "r:", "townland_norm", "t:", "LOCATED_IN"),
        e(em, "record_id", "r:", "record_id", "em:", "HAS_EVENT"),
        e(ev, "record_id", "r:", "record_id", "ev:", "HAS_EVENT"),
        e(ev, "record_id", "ev:", "townland_norm", "t:", "OCCURRED_IN"),
        e(em, "record_id", "em:", "ship_name", "v:", "DEPARTED_VIA"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gr_nodes_by_label(spark, d):
    return nodes(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def gr_edges_by_type(spark, d):
    return edges(spark, d).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def _hierarchy(spark, d):
    return edges(spark, d).where("rel = 'WITHIN'")


def _seed(spark, d):
    return views.catalogue(spark, d).agg(F.concat(F.lit("t:"), F.min("name")).alias("node"))


def gr_khop2(spark, d):
    return graph.k_hops(_hierarchy(spark, d), _seed(spark, d), 2)


def gr_induced_edges(spark, d):
    e = cut(_hierarchy(spark, d))
    return graph.induced(e, graph.k_hops(e, _seed(spark, d), 2)).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def gr_prune_priority(spark, d):
    e = cut(_hierarchy(spark, d))
    near = graph.induced(e, graph.k_hops(e, _seed(spark, d), 2))
    priority = F.when(F.col("dst").startswith("p:"), 3).when(F.col("dst").startswith("b:"), 2).otherwise(1)
    return graph.prune(near, priority, 40).select("src", "rel", "dst", "priority")


def gr_orphans_dangling(spark, d):
    n, e = cut(nodes(spark, d)), cut(edges(spark, d))
    o = graph.orphans(n, e).groupBy(F.lit("orphan").alias("kind"), F.col("label").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    g = graph.dangling(n, e).groupBy(F.lit("dangling").alias("kind"), F.col("rel").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return o.unionByName(g)


def gr_reachability(spark, d):
    """Places from which no county is reached over the hierarchy."""
    e = cut(_hierarchy(spark, d).select("src", "dst").distinct())
    step = lambda df: df.select("node", F.col("at").alias("src")).join(e, "src").select("node", F.col("dst").alias("at")).distinct()
    start = views.catalogue(spark, d).select(F.concat(F.lit("t:"), "name").alias("node")).withColumn("at", F.col("node"))
    one = step(start)
    two = step(one)
    three = step(two)
    ok = one.unionByName(two).unionByName(three).where(F.col("at").startswith("c:")).select("node").distinct()
    return start.select("node").join(ok, "node", "left_anti")


def triples(spark, d):
    r = views.records(spark, d).groupBy("record_id").agg(*[F.min(c).alias(c) for c in ("surname", "year", "townland_norm")], *[F.max(c).alias(c) for c in ("has_eviction_record", "has_emigration_record")])
    kind = F.when(F.col("has_emigration_record") == 1, "Emigration").when(F.col("has_eviction_record") == 1, "Eviction")
    people = graph.triples_of(r, F.concat(F.lit("person:"), "record_id"), {"surname": F.col("surname"), "livedIn": F.concat(F.lit("place:"), "townland_norm"), "year": F.col("year"), "event": kind})
    c = views.catalogue(spark, d)
    return people.unionByName(graph.triples_of(c, F.concat(F.lit("place:"), "name"), {"inParish": F.col("parish"), "inBarony": F.col("barony"), "inCounty": F.col("county")}))


def gr_triples_count(spark, d):
    return triples(spark, d).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o").alias("objects"))


def gr_bgp_join(spark, d):
    """People evicted, counted by the parish of the place they lived in."""
    c = views.catalogue(spark, d)
    r = views.records(spark, d).where("has_eviction_record = 1").select("record_id", "townland_norm").distinct()
    t = graph.triples_of(r, F.concat(F.lit("person:"), "record_id"), {"livedIn": F.concat(F.lit("place:"), "townland_norm"), "event": F.lit("Eviction")}).unionByName(graph.triples_of(c, F.concat(F.lit("place:"), "name"), {"inParish": F.col("parish")})).distinct()
    found = graph.match_pattern(t, ("?x", "event", "Eviction"), ("?x", "livedIn", "?place"), ("?place", "inParish", "?parish"))
    return found.groupBy("parish").agg(F.countDistinct("x").alias("evicted"))


def gr_bgp_optional(spark, d):
    """People recorded before 1850 with the parish of their place, where it is known: optional and filtered patterns."""
    found = graph.match_pattern(cut(triples(spark, d)), ("?x", "livedIn", "?place"), ("?x", "year", "?year"), optional=(("?place", "inParish", "?parish"),), where=F.col("year").cast("int") < 1850)
    return found.groupBy("parish").agg(F.countDistinct("x").alias("people"))


def observations(spark, d):
    """(src, dst, rel) of census and clearance observations, of workhouse entries linked to estate records, and of parish communities."""
    census = views.census(spark, d).select(F.concat(F.lit("t:"), "townland_norm").alias("src"), F.concat(F.lit("co:"), "townland_norm", F.lit(":"), F.col("year").cast("string")).alias("dst"), F.lit("HAS_OBSERVATION").alias("rel"))
    clear = views.clearances(spark, d).select(F.concat(F.lit("t:"), "townland_norm").alias("src"), F.concat(F.lit("cl:"), "townland_norm", F.lit(":"), F.col("year").cast("string")).alias("dst"), F.lit("HAS_OBSERVATION").alias("rel"))
    g = table(spark, d, "er_gold").where("gold_label = 'TRUE_MATCH' and u_record_id is not null").select(F.concat(F.lit("wh:"), "gold_id").alias("src"), F.concat(F.lit("r:"), "u_record_id").alias("dst"), F.lit("LINKED_TO").alias("rel"))
    home = views.records(spark, d).where("record_id is not null").select("record_id", F.col("townland_norm").alias("name"))
    member = lookup_join(home, views.catalogue(spark, d).select("name", "parish"), ["name"]).where("parish is not null").select(F.concat(F.lit("r:"), "record_id").alias("src"), F.concat(F.lit("com:"), "parish").alias("dst"), F.lit("MEMBER_OF").alias("rel"))
    return census.unionByName(clear).unionByName(g).unionByName(member).distinct()


def gr_observation_edges(spark, d):
    o = observations(spark, d)
    return o.groupBy("rel", F.substring_index("dst", ":", 1).alias("to")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("subjects"))


def gr_prune_nodes(spark, d):
    """The 120 best nodes within two steps of the seed, and how many edges lead from each to another of them."""
    e = cut(_hierarchy(spark, d))
    near = graph.k_hops(e, _seed(spark, d), 2)
    priority = F.when(F.col("node").startswith("p:"), 3).when(F.col("node").startswith("b:"), 2).otherwise(1)
    kept, between = graph.prune_nodes(near, e, priority, 120)
    n = between.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("edges"))
    return kept.join(n, "node", "left").select("node", "hop", "priority", F.coalesce("edges", F.lit(0)).alias("edges"))


def gr_person_without_place(spark, d):
    """Persons of the records that no place of the catalogue holds."""
    r = views.records(spark, d).where("record_id is not null").groupBy("record_id").agg(F.max("townland_norm").alias("name"))
    lost = r.join(views.catalogue(spark, d).select("name"), "name", "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("persons"), F.count("name").alias("of_unknown_place"))


def gr_shape_checks(spark, d):
    """Shape constraints as counts of subjects that break them."""
    r = views.records(spark, d)
    return r.agg(F.count(F.when(F.col("record_id").isNull(), 1)).alias("no_id"), F.count(F.when(F.col("townland_norm").isNull(), 1)).alias("no_place"), F.count(F.when(~F.col("year").between(1800, 1929), 1)).alias("year_outside"), (F.count("record_id") - F.countDistinct("record_id")).alias("repeated_id"))


def gr_siblings(spark, d):
    c = views.catalogue(spark, d).where("parish is not null")
    return graph.ranked_siblings(c.select("parish", "name"), "parish", "name", 30)


def gr_communities_lpa(spark, d):
    e = edges(spark, d).where("rel in ('WITHIN', 'LOCATED_IN')").select("src", "dst")
    return graph.label_propagation(e, 3).groupBy("community").agg(F.count(F.lit(1)).alias("members"))


def gr_communities_louvain(spark, d):
    """Communities of places, records and events by modularity, with their sizes."""
    e = edges(spark, d).where("rel in ('LOCATED_IN', 'HAS_EVENT', 'WITHIN')").select("src", "dst")
    return graph.louvain(e).groupBy("community").agg(F.count(F.lit(1)).alias("members"))


def gr_place_context(spark, d):
    """What is known about every place, in one row."""
    r = views.records(spark, d).groupBy(F.col("townland_norm").alias("name")).agg(F.countDistinct("record_id").alias("records"), F.countDistinct("surname").alias("surnames"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.when(F.col("is_widow") == 1, 1)).alias("widow_entries"))
    return lookup_join(views.catalogue(spark, d), r, ["name"], "left").select("name", "parish", "records", "surnames", "first_year", "last_year", "widow_entries")


QUERIES = {n: f for n, f in list(globals().items()) if (n.startswith("g_") or n.startswith("gr_")) and callable(f)}

_C = f"""c0 AS (SELECT id, name, centroid_lat, centroid_lon, regexp_extract(wkt_geometry, '{_POINT}', ['x', 'y']) AS m FROM townland),
c1 AS (SELECT *, try_cast(m.x AS DOUBLE) AS px, try_cast(m.y AS DOUBLE) AS py FROM c0), c2 AS (SELECT id, name, coalesce({_FIX.format(a="centroid_lat", o="centroid_lon")}, {_FIX.format(a="py", o="px")}) AS pos FROM c1),
c AS (SELECT id, name, pos[1] AS lat, pos[2] AS lon FROM c2 WHERE pos IS NOT NULL)"""
_RINGS = r"""w AS (SELECT id, regexp_extract(wkt_geometry, '\(([^()]+)\)', 1) AS ring FROM townland WHERE regexp_matches(wkt_geometry, '(?i)polygon\s*z?m?\s*\(') AND regexp_matches(wkt_geometry, '\)\s*$') AND length(replace(wkt_geometry, '(', '')) = length(replace(wkt_geometry, ')', ''))),
x AS (SELECT id, list_transform(string_split(ring, ','), lambda t: string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ')) AS q FROM w WHERE ring <> ''),
y AS (SELECT id, CASE WHEN q[1][1]::DOUBLE > 50 THEN list_transform(q, lambda t: t[2]::DOUBLE) ELSE list_transform(q, lambda t: t[1]::DOUBLE) END AS xs, CASE WHEN q[1][1]::DOUBLE > 50 THEN list_transform(q, lambda t: t[1]::DOUBLE) ELSE list_transform(q, lambda t: t[2]::DOUBLE) END AS ys FROM x WHERE len(q) >= 4)"""
_KM = lambda a, b: f"2 * 6371.0::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
_FB = f"{_C}, b AS (SELECT * FROM c ORDER BY id LIMIT 1), f AS (SELECT c.id, c.name, {_KM('c', 'b')} AS km FROM c, b WHERE c.id <> b.id)"
_EDGES = f"""{views.CATALOGUE}, pb AS (SELECT parish, min(barony) AS barony FROM catalogue GROUP BY 1), bc AS (SELECT barony, min(county) AS county FROM catalogue GROUP BY 1),
h AS (SELECT DISTINCT 't:' || name AS src, 'p:' || parish AS dst FROM catalogue WHERE parish IS NOT NULL UNION SELECT 't:' || name, 'b:' || barony FROM catalogue WHERE parish IS NULL AND barony IS NOT NULL
 UNION SELECT 'p:' || parish, 'b:' || barony FROM pb WHERE parish IS NOT NULL AND barony IS NOT NULL UNION SELECT 'b:' || barony, 'c:' || county FROM bc WHERE barony IS NOT NULL AND county IS NOT NULL)"""
_ALL_EDGES = f"""{_EDGES}, e AS (SELECT src, dst, 'WITHIN' AS rel FROM h UNION SELECT 'r:' || record_id, 't:' || townland_norm, 'LOCATED_IN' FROM unified_record WHERE record_id IS NOT NULL AND townland_norm IS NOT NULL
 UNION SELECT 'r:' || record_id, 'em:' || record_id, 'HAS_EVENT' FROM unified_record WHERE has_emigration_record = 1 AND trim(ship_name) <> '' UNION SELECT 'r:' || record_id, 'ev:' || record_id, 'HAS_EVENT' FROM unified_record WHERE has_eviction_record = 1
 UNION SELECT 'ev:' || record_id, 't:' || townland_norm, 'OCCURRED_IN' FROM unified_record WHERE has_eviction_record = 1 AND townland_norm IS NOT NULL UNION SELECT 'em:' || record_id, 'v:' || ship_name, 'DEPARTED_VIA' FROM unified_record WHERE has_emigration_record = 1 AND trim(ship_name) <> '')"""
_NODES = """n AS (SELECT DISTINCT 't:' || name AS node, 'Townland' AS label FROM catalogue UNION SELECT 'p:' || parish, 'CivilParish' FROM catalogue WHERE parish IS NOT NULL UNION SELECT 'b:' || barony, 'Barony' FROM catalogue WHERE barony IS NOT NULL UNION SELECT 'c:' || county, 'County' FROM catalogue WHERE county IS NOT NULL
 UNION SELECT 'r:' || record_id, 'Person' FROM unified_record WHERE record_id IS NOT NULL UNION SELECT 'em:' || record_id, 'EmigrationEvent' FROM unified_record WHERE has_emigration_record = 1 AND trim(ship_name) <> '' UNION SELECT 'ev:' || record_id, 'EvictionEvent' FROM unified_record WHERE has_eviction_record = 1 UNION SELECT 'v:' || ship_name, 'Voyage' FROM unified_record WHERE has_emigration_record = 1 AND trim(ship_name) <> '')"""
_HOPS = f"{_EDGES}, u AS (SELECT src, dst FROM h UNION SELECT dst, src FROM h), s AS (SELECT 't:' || min(name) AS node FROM catalogue), r1 AS (SELECT DISTINCT u.dst AS node FROM u JOIN s ON u.src = s.node), r2 AS (SELECT DISTINCT u.dst AS node FROM u JOIN r1 ON u.src = r1.node), k AS (SELECT node, min(hop) AS hop FROM (SELECT node, 0 AS hop FROM s UNION ALL SELECT node, 1 FROM r1 UNION ALL SELECT node, 2 FROM r2) GROUP BY 1)"
_PEOPLE_SQL = "pe AS (SELECT record_id, min(surname) AS surname, min(year) AS year, min(townland_norm) AS place, max(has_eviction_record) AS ev, max(has_emigration_record) AS em FROM unified_record WHERE record_id IS NOT NULL GROUP BY 1)"
SQL = {
    "g_haversine_round": f"WITH {_FB} SELECT id, floor(km * 1000 + 0.5) / 1000 AS km FROM f",
    "g_radius_count": f"WITH {_FB} SELECT year, count(DISTINCT record_id) AS records FROM unified_record WHERE townland_norm IN (SELECT upper(trim(name)) FROM f WHERE km <= {NEAR} AND name IS NOT NULL) GROUP BY 1",
    "g_nearby_topk": f"WITH {_FB} SELECT id, name, floor(km * 1000 + 0.5) / 1000 AS km FROM f ORDER BY km, id LIMIT 30",
    "g_radius_pairs": f"WITH {_C}, p AS (SELECT a.id AS x, b.id AS y FROM c a JOIN c b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.003 WHERE {_KM('a', 'b')} <= 0.3) SELECT x AS id, count(*) AS near FROM p GROUP BY 1",
    "g_bbox_center": f"WITH {_RINGS} SELECT id, floor((list_min(xs) + list_max(xs)) / 2 * 1e7 + 0.5) / 1e7 AS x, floor((list_min(ys) + list_max(ys)) / 2 * 1e7 + 0.5) / 1e7 AS y FROM y",
    "g_mean_centroid": f"WITH {_RINGS} SELECT id, floor(list_sum(xs[:len(xs) - 1]) / (len(xs) - 1) * 1e6 + 0.5) / 1e6 AS x, floor(list_sum(ys[:len(ys) - 1]) / (len(ys) - 1) * 1e6 + 0.5) / 1e6 AS y FROM y",
    "g_point_parse": "WITH p AS (SELECT id, regexp_extract(wkt_geometry, '(?is)^\\s*(?:srid\\s*=\\s*\\d+\\s*;)?\\s*point\\s*z?\\s*\\(\\s*([-+0-9.]+)\\s+([-+0-9.]+)(?:\\s+[-+0-9.]+)?\\s*\\)\\s*$', ['x', 'y']) AS m FROM townland) SELECT id, m.y::DOUBLE AS lat, m.x::DOUBLE AS lon FROM p WHERE m.x <> ''",
    "g_valid_coordinates": "SELECT CASE WHEN centroid_lat IS NULL OR centroid_lon IS NULL THEN 'missing' WHEN centroid_lat = 0 AND centroid_lon = 0 THEN 'void' WHEN centroid_lat BETWEEN 51 AND 56 AND centroid_lon BETWEEN -11 AND -4 THEN 'valid' ELSE 'outside' END AS kind, count(*) AS n FROM townland GROUP BY 1",
    "g_choropleth_bins": f"WITH {views.CENSUS} SELECT CASE WHEN total > 350 THEN 6 WHEN total > 220 THEN 5 WHEN total > 140 THEN 4 WHEN total > 80 THEN 3 WHEN total > 40 THEN 2 WHEN total > 0 THEN 1 ELSE 0 END AS bin, count(*) AS places, CAST(sum(total) AS BIGINT) AS people FROM census WHERE year = 1841 GROUP BY 1",
    "gr_nodes_by_label": f"WITH {views.CATALOGUE}, {_NODES} SELECT label, count(*) AS n FROM n GROUP BY 1",
    "gr_edges_by_type": f"WITH {_ALL_EDGES} SELECT rel, count(*) AS n FROM e GROUP BY 1",
    "gr_khop2": f"WITH {_HOPS} SELECT node, CAST(hop AS INTEGER) AS hop FROM k",
    "gr_induced_edges": f"WITH {_HOPS} SELECT 'WITHIN' AS rel, count(*) AS n FROM h WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)",
    "gr_prune_priority": f"WITH {_HOPS} SELECT src, 'WITHIN' AS rel, dst, CASE WHEN dst LIKE 'p:%' THEN 3 WHEN dst LIKE 'b:%' THEN 2 ELSE 1 END AS priority FROM h WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k) ORDER BY priority DESC, src, dst LIMIT 40",
    "gr_orphans_dangling": f"WITH {_ALL_EDGES}, {_NODES} SELECT 'orphan' AS kind, label AS what, count(*) AS n FROM n WHERE node NOT IN (SELECT src FROM e UNION SELECT dst FROM e) GROUP BY 2 UNION ALL SELECT 'dangling', rel, count(*) FROM e WHERE src NOT IN (SELECT node FROM n) OR dst NOT IN (SELECT node FROM n) GROUP BY 2",
    "gr_reachability": f"WITH RECURSIVE {_EDGES}, r(node, place) AS (SELECT 't:' || name, 't:' || name FROM catalogue UNION SELECT r.node, h.dst FROM r JOIN h ON h.src = r.place) SELECT 't:' || name AS node FROM catalogue WHERE 't:' || name NOT IN (SELECT node FROM r WHERE place LIKE 'c:%')",
    "gr_triples_count": f"WITH {views.CATALOGUE}, {_PEOPLE_SQL}, t AS (SELECT 'inParish' AS p, parish AS o FROM catalogue UNION ALL SELECT 'inBarony', barony FROM catalogue UNION ALL SELECT 'inCounty', county FROM catalogue UNION ALL SELECT 'surname', surname FROM pe UNION ALL SELECT 'livedIn', 'place:' || place FROM pe UNION ALL SELECT 'year', year::VARCHAR FROM pe UNION ALL SELECT 'event', CASE WHEN em = 1 THEN 'Emigration' WHEN ev = 1 THEN 'Eviction' END FROM pe) SELECT p, count(*) AS n, count(DISTINCT o) AS objects FROM t WHERE o IS NOT NULL GROUP BY 1",
    "gr_bgp_optional": f"WITH {views.CATALOGUE}, {_PEOPLE_SQL} SELECT parish, count(DISTINCT record_id) AS people FROM pe LEFT JOIN catalogue c ON c.name = place WHERE place IS NOT NULL AND year < 1850 GROUP BY 1",
    "gr_observation_edges": f"WITH {views.CATALOGUE}, {views.CENSUS}, {views.CLEARANCES}, o AS (SELECT 't:' || townland_norm AS src, 'co' AS t, year::VARCHAR || townland_norm AS dst, 'HAS_OBSERVATION' AS rel FROM census UNION SELECT 't:' || townland_norm, 'cl', year::VARCHAR || townland_norm, 'HAS_OBSERVATION' FROM clearances UNION SELECT gold_id, 'r', u_record_id, 'LINKED_TO' FROM er_gold WHERE gold_label = 'TRUE_MATCH' AND u_record_id IS NOT NULL UNION SELECT record_id, 'com', c.parish, 'MEMBER_OF' FROM unified_record r JOIN catalogue c ON c.name = r.townland_norm WHERE record_id IS NOT NULL AND c.parish IS NOT NULL) SELECT rel, t AS \"to\", count(*) AS n, count(DISTINCT src) AS subjects FROM o GROUP BY 1, 2",
    "gr_prune_nodes": f"WITH {_HOPS}, q AS (SELECT node, hop, CASE WHEN node LIKE 'p:%' THEN 3 WHEN node LIKE 'b:%' THEN 2 ELSE 1 END AS priority FROM k ORDER BY priority DESC, node LIMIT 120) SELECT node, CAST(hop AS INTEGER) AS hop, priority, (SELECT count(*) FROM h WHERE h.src = q.node AND h.dst IN (SELECT node FROM q)) AS edges FROM q",
    "gr_person_without_place": f"WITH {views.CATALOGUE}, r AS (SELECT record_id, max(townland_norm) AS name FROM unified_record WHERE record_id IS NOT NULL GROUP BY 1) SELECT count(*) AS persons, count(name) AS of_unknown_place FROM r WHERE name IS NULL OR name NOT IN (SELECT name FROM catalogue)",
    "gr_bgp_join": f"WITH {views.CATALOGUE} SELECT c.parish, count(DISTINCT record_id) AS evicted FROM unified_record r JOIN catalogue c ON c.name = r.townland_norm WHERE has_eviction_record = 1 AND c.parish IS NOT NULL GROUP BY 1",
    "gr_shape_checks": "SELECT count(*) - count(record_id) AS no_id, count(*) - count(townland_norm) AS no_place, count(CASE WHEN NOT (year BETWEEN 1800 AND 1929) THEN 1 END) AS year_outside, count(record_id) - count(DISTINCT record_id) AS repeated_id FROM unified_record",
    "gr_siblings": f"WITH {views.CATALOGUE} SELECT parish, name FROM catalogue WHERE parish IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parish ORDER BY name) <= 30",
    "gr_place_context": f"WITH {views.CATALOGUE}, r AS (SELECT townland_norm AS name, count(DISTINCT record_id) AS records, count(DISTINCT surname) AS surnames, min(year) AS first_year, max(year) AS last_year, count(CASE WHEN is_widow = 1 THEN 1 END) AS widow_entries FROM unified_record GROUP BY 1) SELECT c.name, c.parish, records, surnames, first_year, last_year, widow_entries FROM catalogue c LEFT JOIN r USING (name)",
}
