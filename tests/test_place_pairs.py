"""Place pairs scored block by block against SQL, whatever the size of a block."""

import random

import duckdb
import numpy as np

from demesne.functions.geometry import iou
from demesne.functions.similarity import jaro_winkler
from demesne.operators import place_pairs
from demesne.operators.er import edits
from demesne.plans import q_er

DIR = "/root/testdata/sf0.001"


def test_pairs_of_small_blocks_match_sql(spark, monkeypatch):
    monkeypatch.setattr(place_pairs, "ROWS", 3)
    con = duckdb.connect()
    con.execute(f"create view townland as select * from read_parquet('{DIR}/townland.parquet')")
    want = sorted(con.execute(q_er.SQL["e_townland_pairs"]).fetchall())
    assert sorted(map(tuple, q_er.e_townland_pairs(spark, DIR).collect())) == want and want


def test_full_pairs_do_not_depend_on_blocks(spark, monkeypatch):
    whole = sorted(map(tuple, q_er.e_townland_pairs_full(spark, DIR).collect()))
    monkeypatch.setattr(place_pairs, "ROWS", 3)
    assert sorted(map(tuple, q_er.e_townland_pairs_full(spark, DIR).collect())) == whole and whole


def test_full_pairs_are_worked_out_a_few_at_a_time(monkeypatch):
    """Only rows of like names are paired, PAIRS at a time, with the scores of each pair by itself."""
    rng = random.Random(3)
    square = "POLYGON (({0} 53, {1} 53, {1} 53.1, {0} 53.1, {0} 53))"

    def rows(ids):
        out = {c: [] for c in ("id", "size", "area_sqm", *place_pairs._BOX, *place_pairs._TEXTS, "w")}
        for i in ids:
            name, west = rng.choice(["kilmore", "kilmory", "kilbride", "ballina", "i̇da"]), -7 + rng.randrange(30) / 100
            outline = rng.random() < 0.7
            box = (west, 53.0, west + 0.1, 53.1) if outline else (np.nan,) * 4
            of = {"id": i, "size": len(name) - (name[0] == "i"), "area_sqm": rng.choice([np.nan, 5.0, 9.0]), "name": name, "w": square.format(west, west + 0.1) if outline else place_pairs._NONE}
            of |= dict(zip(place_pairs._BOX, box)) | {c: rng.choice([place_pairs._NONE, "dun", "dunn"]) for c in ("name_gaelic", "civil_parish", "barony")}
            of |= {c: rng.choice([place_pairs._NONE] * 9 + ["x1"]) for c in place_pairs.IDS}
            for c in out:
                out[c].append(of[c])
        return {c: np.array(v, dtype=object if isinstance(v[0], str) else None) for c, v in out.items()}

    def alone(a, b):
        both = lambda c: a[c] != place_pairs._NONE and b[c] != place_pairs._NONE
        like = lambda c: jaro_winkler(a[c], b[c]) if both(c) else 0.0
        same = lambda c: both(c) and a[c] == b[c]
        area = min(a["area_sqm"], b["area_sqm"]) / max(a["area_sqm"], b["area_sqm"]) if a["area_sqm"] == a["area_sqm"] and b["area_sqm"] == b["area_sqm"] else (1.0 if a["area_sqm"] == a["area_sqm"] or b["area_sqm"] == b["area_sqm"] else 0.0)
        score = 0.35 * like("name") + 0.10 * like("name_gaelic") + 0.15 * same("civil_parish") + 0.10 * same("barony") + 0.10 * area + 0.20 * (iou(a["w"], b["w"]) or 0.0 if both("w") else 0.0)
        return 0.99 if any(same(c) for c in place_pairs.IDS) else score

    monkeypatch.setattr(place_pairs, "PAIRS", 7)
    a, b = rows(range(0, 80, 2)), rows(range(1, 81, 2))
    rows_of = lambda x: [{c: v[k] for c, v in x.items()} for k in range(len(x["id"]))]
    for x, y, own in ((a, b, False), (a, a, True)):
        batches = list(place_pairs._full_scores(x, y, own))
        assert max(p.num_rows for p in batches) <= 7
        got = {(r["id_a"], r["id_b"]): r["score"] for p in batches for r in p.to_pylist()}
        want = {}
        for u in rows_of(x):
            for v in rows_of(y):
                if (u["id"] < v["id"] if own else u["id"] != v["id"]) and edits([u["name"]], [v["name"]])[0, 0] <= max(u["size"], v["size"]) * 0.4:
                    low, high = (u, v) if u["id"] < v["id"] else (v, u)
                    want[low["id"], high["id"]] = alone(low, high)
        assert got.keys() == want.keys() and sum(p.num_rows for p in batches) == len(want) > 100
        assert all(abs(got[k] - want[k]) <= 5.1e-5 for k in want)
