"""Near points and regions against brute force."""

import math

import duckdb
import pytest

from demesne.functions.geometry import polygon_parts
from demesne.operators import geo

COLUMNS = "id long, centroid_lat double, centroid_lon double, wkt_geometry string, name string"


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


def fixed(lat, lon):
    if lat is None or lon is None or lat != lat or lon != lon:
        return None
    for a, b in ((lat, lon), (lon, lat), (lat, -lon), (-lat, lon), (lon, -lat), (-lon, lat)):
        if 51 <= a <= 56 and -11 <= b <= -4:
            return a, b
    return None


def located(row):
    import re

    at = fixed(row[1], row[2])
    m = re.match(r"(?i)\s*(?:srid=\d+;)?\s*point\s*z?\s*\(\s*(\S+)\s+([^\s)]+)", row[3] or "")
    return at or (fixed(float(m[2]), float(m[1])) if m else None)


def in_ring(y, x, ring):
    odd = False
    for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:]):
        if (x0 > x) != (x1 > x) and y0 + (x - x0) * (y1 - y0) / (x1 - x0) < y:
            odd = not odd
    return odd


def brute(rows, reach):
    at = {r[0]: located(r) for r in rows}
    parts = {r[0]: polygon_parts(r[3]) for r in rows}
    box = {i: (min(q[0][:, 0].min() for q in p), max(q[0][:, 0].max() for q in p)) for i, p in parts.items() if p}
    inside = lambda p, i: i in box and box[i][0] <= p[1] <= box[i][1] and any(sum(in_ring(*p, r) for r in part) % 2 for part in parts[i])
    ids = sorted(i for i in at if at[i])
    out = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if abs(at[a][0] - at[b][0]) < 0.001 * reach / 0.1 and km(at[a], at[b]) <= reach}
    return out | {(min(a, b), max(a, b)) for a in ids for b in box if a != b and inside(at[a], b)}


def test_neighbours_match_brute_force(spark):
    rows = duckdb.connect().sql("select id, centroid_lat, centroid_lon, wkt_geometry, name from '/root/testdata/sf0.01/townland.parquet'").fetchall()
    got = {tuple(r) for r in geo.neighbours(spark.createDataFrame(rows, COLUMNS), 0.1).select("id_a", "id_b").collect()}
    want = brute(rows, 0.1)
    assert got == want and len(want) > 100


def test_many_points_at_one_spot_and_dirty_rows(spark, monkeypatch):
    monkeypatch.setattr(geo, "BLOCK", 4)
    shape = "POLYGON ((-6.4 52.8, -6.3 52.8, -6.3 52.9, -6.4 52.9, -6.4 52.8), (-6.36 52.84, -6.34 52.84, -6.34 52.86, -6.36 52.86, -6.36 52.84))"
    rows = [(i, 52.5, -6.5, None, "x") for i in range(15)]
    rows += [(20, 52.85, -6.35, None, "in the hole"), (21, -6.39, 52.81, None, "swapped"), (22, None, None, "Point(-6.39 52.81)", ""), (23, 0.0, 0.0, shape, "void")]
    rows += [(24, 52.81, 6.39, "POLYGON ((1 2", "sign lost"), (25, None, 52.0, "n/a", None), (None, 52.5, -6.5, shape, None), (26, 53.0, -7.0, "", "alone"), (26, 53.0, -7.0, "POLYGON EMPTY", "again")]
    got = {tuple(r) for r in geo.neighbours(spark.createDataFrame(rows, COLUMNS), 0.1).collect()}
    want = {(a, b) for a in range(15) for b in range(a + 1, 15)} | {(21, 22), (21, 23), (21, 24), (22, 23), (22, 24), (23, 24)}
    assert got == want


def test_no_rows(spark):
    assert geo.neighbours(spark.createDataFrame([], COLUMNS), 0.1).count() == 0
    assert geo.neighbours(spark.createDataFrame([(1, None, None, None, None)], COLUMNS), 0.1).count() == 0


@pytest.mark.parametrize("lon", [179.9999, -179.9999])
def test_date_line(spark, lon):
    p = spark.createDataFrame([(1, 10.0, lon), (2, 10.0, -lon), (3, 10.0, 0.0)], "id long, lat double, lon double")
    assert [tuple(r)[:2] for r in geo.near_pairs(p, 1.0).collect()] == [(1, 2)]


def test_any_ring_and_even_odd_against_brute_force(spark):
    import random

    rng = random.Random(3)
    square = lambda x, y, w: f"({x} {y}, {x + w} {y}, {x + w} {y + w}, {x} {y + w}, {x} {y})"
    rows = []
    for i in range(8):
        x, y = -7 + rng.random(), 52 + rng.random()
        rows.append((i, None, None, f"POLYGON ({square(x, y, 0.4)}, {square(x + 0.1, y + 0.1, 0.2)})", "r"))
    points = [(100 + i, 52 + 1.4 * rng.random(), -7 + 1.4 * rng.random(), None, "p") for i in range(300)]
    df = spark.createDataFrame(rows + points, COLUMNS)
    at = geo.true_locations(df)
    for any_ring in (False, True):
        got = {(r["id"], r["region"]) for r in geo.points_in_regions(at, geo.region_slabs(df, any_ring=any_ring)).collect()}
        want = set()
        for i, lat, lon, _, _ in points:
            for k, _, _, wkt, _ in rows:
                hits = [in_ring(lat, lon, [tuple(c) for c in ring]) for ring in polygon_parts(wkt)[0]]
                if any(hits) if any_ring else sum(hits) % 2 == 1:
                    want.add((i, k))
        assert got == want and want


def test_outline_centres_read_every_dialect(spark):
    from demesne.functions.geometry import outline_centres

    texts = ["POLYGON ((-6 52, -5.8 52, -5.8 52.2, -6 52.2, -6 52))", "srid=4326;multipolygon z (((52 -6 1, 52 -5.8 1, 52.2 -5.8 1, 52.2 -6 1, 52 -6 1)), ((53 -6 1, 53 -5 1, 54 -5 1, 53 -6 1)))", "POINT (-6 52)", "POLYGON EMPTY", "POLYGON ((-6 52, x y))", None]
    got = [r["c"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, w string").orderBy("i").select(outline_centres("w").alias("c")).collect()]
    for c in got[:2]:
        assert abs(c["x"] + 5.9) < 1e-9 and abs(c["y"] - 52.1) < 1e-9 and abs(c["mean_x"] + 5.9) < 1e-9 and abs(c["mean_y"] - 52.1) < 1e-9
    assert all(c["x"] is None for c in got[2:])


def test_iou_measures_shared_outlines_once_and_none_apart(spark, tmp_path):
    from demesne.functions.geometry import apart, bounds_col, iou
    from demesne.plans.q_graph import g_polygon_iou
    from pyspark.sql import functions as F

    box = lambda x, y, w: f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + w}, {x} {y + w}, {x} {y}))"
    texts = [box(-7, 52, 1), box(-6.5, 52.5, 1), box(-5, 54, 0.5), "MULTIPOLYGON (((-7 52, -6 52, -6 53, -7 52)), ((-5 54, -4.5 54, -4.5 54.5, -5 54)))", "POLYGON ((1 2", "POLYGON ((-7 52, -7 53, -7 52.5, -7 52))"]
    rows = [(3 * i + k, "A" if i < 25 else "b", t) for i, t in enumerate(texts * 5) for k in range(2)]
    df = spark.createDataFrame(rows, "id long, name string, wkt_geometry string")
    df.write.parquet(f"{tmp_path}/townland.parquet")
    got = {(r["id_a"], r["id_b"]): r["iou"] for r in g_polygon_iou(spark, str(tmp_path)).collect()}
    want = {(i, k): iou(v, w) for i, m, v in rows for k, n, w in rows if i < k and m == n}
    assert got.keys() == want.keys() and all(got[p] == (None if w is None else pytest.approx(w, abs=1e-6)) for p, w in want.items())
    boxes = df.select("id", bounds_col("wkt_geometry").alias("a")).where("id in (0, 3, 6)")
    far = {tuple(r) for r in boxes.crossJoin(boxes.toDF("k", "b")).where("id < k").select("id", "k", apart(F.col("a"), F.col("b"))).collect()}
    assert far == {(0, 3, False), (0, 6, True), (3, 6, True)}
