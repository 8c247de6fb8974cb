"""Queries of the general problems 4 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demesne.operators import geo, measures
from demesne.runtime import table


NEAR_KM = 0.1


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = geo.neighbours(table(spark, sf_dir, "townland"), NEAR_KM)
    return pairs.select(F.col("id_a").alias("townland_id_a"), F.col("id_b").alias("townland_id_b"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.misstated_holdings(table(spark, sf_dir, "unified_record")).select("id")


def p6_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statute acres of every record that states an area, in thousandths."""
    r = measures.statute_areas(table(spark, sf_dir, "unified_record").select("id", "acres", "acres_irish", "acres_english", "comments", "holding_on_estate"))
    return r.where("statute_acres is not null").select("id", "area_source", (F.floor(F.col("statute_acres") * 1000 + 0.5) / 1000).alias("statute_acres"))


QUERIES = {"p4_found": p4_found, "p6_found": p6_found, "p6_areas": p6_areas}

_UNIT_SQL = """CASE
  WHEN regexp_matches({t}, '\\b(irish plantation|old irish|irish|ir|plantation|plantn)\\.? *(acres?|measure|meas)\\b|\\bi\\. ?m\\b') THEN 196.0 / 121
  WHEN regexp_matches({t}, '\\b(cunningham|cunn)\\.? *(acres?|measure|meas)\\b') THEN 625.0 / 484
  WHEN regexp_matches({t}, '\\b(statute|stat|english)\\.? *(acres?|measure|meas)\\b|\\be\\. ?m\\b') THEN 1.0
  WHEN regexp_matches({t}, '\\bhectares?\\b|\\bha\\b') THEN 10000 / 4046.8564224
  WHEN regexp_matches({t}, '\\bsq(uare|\\.) perches|perches of land') THEN 1.0 / 160
  WHEN regexp_matches({t}, '([0-9] *|[[]|figure in |area is in )(roods|rds)\\b') AND NOT regexp_matches({t}, '[0-9] acres, ') THEN 0.25
END"""
_ARP_SQL = "regexp_extract({t}, '([0-9]+) ?(?:a|ac|acres)[.,]? ([0-9]+) ?(?:r|ro|roods)[.,]? ([0-9]+) ?(?:p|per|perches)\\b', {i})"
_ARP2_SQL = "regexp_extract({t}, 'a[.]([0-9]+) r[.]([0-9]+) p[.]([0-9]+)', {i})"
_NUM_SQL = "regexp_extract({t}, '([0-9]+(?:[.][0-9]+)?) (?:by the |old |irish|ir\\b|plantation|plantn|i[.] ?m|cunn|stat|english|e[.] ?m|hectare|ha\\b|sq|perches of land|roods|rds)', 1)"


def _written(t: str) -> str:
    def arp(sql: str) -> str:
        a, r, p = (f"try_cast({sql.format(t=t, i=i)} AS DOUBLE)" for i in (1, 2, 3))
        return f"({a} + {r} / 4 + {p} / 160)"

    return f"coalesce({arp(_ARP_SQL)}, {arp(_ARP2_SQL)}, try_cast({_NUM_SQL.format(t=t)} AS DOUBLE))"


_AREAS_SQL = f"""
WITH t AS (SELECT *, lower(comments) AS c, lower(holding_on_estate) AS h FROM unified_record),
u AS (SELECT *, {_UNIT_SQL.format(t="c")} AS uc, {_UNIT_SQL.format(t="h")} AS uh, {_written("c")} AS vc, {_written("h")} AS vh FROM t),
w AS (SELECT *, coalesce(acres_english, acres_irish * 196.0 / 121, acres * coalesce(uc, uh, 1.0), vc * uc, vh * uh) AS statute,
  CASE WHEN acres_english IS NOT NULL THEN 'acres_english' WHEN acres_irish IS NOT NULL THEN 'acres_irish' WHEN acres IS NOT NULL THEN 'acres' ELSE 'text' END AS area_source FROM u)
"""
_FIX = """CASE WHEN {a} BETWEEN 51 AND 56 AND {o} BETWEEN -11 AND -4 THEN [{a}, {o}] WHEN {o} BETWEEN 51 AND 56 AND {a} BETWEEN -11 AND -4 THEN [{o}, {a}]
  WHEN {a} BETWEEN 51 AND 56 AND -{o} BETWEEN -11 AND -4 THEN [{a}, -{o}] WHEN {o} BETWEEN 51 AND 56 AND -{a} BETWEEN -11 AND -4 THEN [{o}, -{a}] END"""
_POINT = r"(?is)^\s*(?:srid\s*=\s*\d+\s*;)?\s*point\s*z?\s*\(\s*([-+0-9.]+)\s+([-+0-9.]+)(?:\s+[-+0-9.]+)?\s*\)\s*$"
_P4_SQL = rf"""
WITH g AS (SELECT *, regexp_extract(wkt_geometry, '{_POINT}', ['x', 'y']) AS m FROM townland),
h AS (SELECT *, try_cast(m.x AS DOUBLE) AS px, try_cast(m.y AS DOUBLE) AS py FROM g),
l AS (SELECT id, coalesce({_FIX.format(a="centroid_lat", o="centroid_lon")}, {_FIX.format(a="py", o="px")}) AS pos FROM h),
p AS (SELECT id, pos[1] AS lat, pos[2] AS lon FROM l WHERE pos IS NOT NULL),
w AS (SELECT id, string_split_regex(wkt_geometry, '\)\s*\)\s*,\s*\(') AS parts FROM townland
  WHERE regexp_matches(wkt_geometry, '(?i)polygon\s*z?\s*\(') AND regexp_matches(wkt_geometry, '\)\s*$') AND length(replace(wkt_geometry, '(', '')) = length(replace(wkt_geometry, ')', ''))),
o AS (SELECT id, unnest(range(1, len(parts) + 1)) AS part, unnest(parts) || ')' AS t FROM w),
r AS (SELECT id, part, unnest(regexp_extract_all('(' || t, '\(([^()]+)\)', 1)) AS ring FROM o),
c AS (SELECT id, part, list_transform(string_split(ring, ','), lambda t: string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ')) AS q FROM r),
d AS (SELECT id, part, CASE WHEN q[1][1]::DOUBLE > 50 THEN list_transform(q, lambda t: [t[2]::DOUBLE, t[1]::DOUBLE]) ELSE list_transform(q, lambda t: [t[1]::DOUBLE, t[2]::DOUBLE]) END AS q FROM c),
e AS (SELECT id, part, unnest(list_zip(q[:len(q) - 1], q[2:])) AS s FROM d),
k AS (SELECT id, part, s[1][1] AS x0, s[1][2] AS y0, s[2][1] AS x1, s[2][2] AS y1 FROM e),
b AS (SELECT id, part, min(x0) AS xa, max(x0) AS xb, min(y0) AS ya, max(y0) AS yb FROM k GROUP BY 1, 2),
i AS (SELECT p.id AS a, k.id AS b, k.part FROM p JOIN b ON p.id <> b.id AND p.lon BETWEEN xa AND xb AND p.lat BETWEEN ya AND yb
  JOIN k ON k.id = b.id AND k.part = b.part WHERE (k.x0 > p.lon) <> (k.x1 > p.lon) AND k.y0 + (p.lon - k.x0) * (k.y1 - k.y0) / (k.x1 - k.x0) <= p.lat GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
n AS (SELECT u.id AS a, v.id AS b FROM p u JOIN p v ON u.id < v.id AND abs(u.lat - v.lat) < 0.001
  WHERE 2 * 6371.0::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians(v.lat - u.lat) / 2), 2) + cos(radians(u.lat)) * cos(radians(v.lat)) * pow(sin(radians(v.lon - u.lon) / 2), 2)))) <= {NEAR_KM})
SELECT a AS townland_id_a, b AS townland_id_b FROM n UNION SELECT least(a, b), greatest(a, b) FROM i
"""
SQL = {
    "p4_found": _P4_SQL,
    "p6_found": _AREAS_SQL + "SELECT id FROM w WHERE abs(holding_acres - statute) > 0.02 * abs(statute)",
    "p6_areas": _AREAS_SQL + "SELECT id, area_source, floor(statute * 1000 + 0.5) / 1000 AS statute_acres FROM w WHERE statute IS NOT NULL",
}
