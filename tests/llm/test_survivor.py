import random
from datetime import datetime, timedelta

from demesne.llm import survivor as S

SCHEMA = "id long, entity_id string, field_name string, field_value string, source string, rule string, created_at timestamp_ntz, __n string, n long"
T0 = datetime(2022, 1, 1)


def run(spark, rows, trust=(("manual", "reviewed", 1), ("kg", "auto", 2))):
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)
    t = spark.createDataFrame(list(trust), "source string, rule string, trust_rank int")
    return {(r["entity_id"], r["field_name"]): r for r in S.survivors(df, ["entity_id", "field_name"], "field_value", t).collect()}


def brute(rows, trust):
    ranks = {(s, r): k for s, r, k in trust}
    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[2]), []).append(r)
    out = {}
    for key, g in groups.items():
        stems = {}
        for r in g:
            v = (r[3] or "").strip().lower()
            if v and v not in S.HOLLOW and any(c.isalnum() for c in v):
                stems[r[0]] = v.rstrip(".… ")
        whole = [r for r in g if r[0] in stems and not any(o.startswith(stems[r[0]]) and len(o) > len(stems[r[0]]) for o in stems.values())]
        if whole:
            out[key] = min(whole, key=lambda r: (ranks.get(((r[4] or "").strip().lower(), (r[5] or "").strip().lower()), 10**9), -(r[6] or datetime(1, 1, 1)).toordinal() * 86400 - ((r[6] or T0).hour * 3600), r[0]))[0]
    return out


def test_random_groups_match_brute_force(spark):
    rng = random.Random(5)
    values = ["Tessin", "tessin...", "Tes", "Lower Tessin", "Lower Tes…", "unknown", "N/A", None, "", " ? ", "Crannagh", "crannagh ", "nan", "Ballisk", "Bal"]
    trust = [("manual", "reviewed", 1), ("kg", "auto", 2), ("osm", "geo", 3)]
    rows = [(i, f"e{rng.randrange(60)}", rng.choice(["barony", "parish"]), rng.choice(values), rng.choice(["manual", " KG", "osm ", "odd", None]), rng.choice(["reviewed", "AUTO", "geo"]), rng.choice([None, T0, T0 + timedelta(hours=5)])) for i in range(600)]
    got = {k: r["id"] for k, r in run(spark, rows, trust).items() if r["id"] is not None}
    assert got == brute(rows, trust)


def test_hot_group_ties_and_long_values(spark):
    rows = [(i, "hot", "d", "x" * (i % 40 + 1), "kg", "auto", T0) for i in range(400)]  # each a beginning of a longer one
    rows += [(1000, "hot", "d", "x" * 40 + "y" * 50_000, "odd", "odd", None)]
    got = run(spark, rows)[("hot", "d")]
    assert (got["id"], got["n"]) == (1000, 401)
    tie = run(spark, [(7, "a", "f", "v", "kg", "auto", T0), (3, "a", "f", "V ", "KG", "Auto", T0)])
    assert tie[("a", "f")]["id"] == 3


def test_null_keys_hollow_groups_and_empty(spark):
    got = run(spark, [(1, None, "f", "a", "kg", "auto", T0), (2, None, "f", "b", "manual", "reviewed", None), (3, "e", None, "-", "kg", "auto", T0), (4, "e", None, None, None, None, None)])
    assert got[(None, "f")]["id"] == 2 and got[("e", None)]["id"] is None
    assert run(spark, []) == {}


def test_golden_fills_from_later_layers(spark):
    trust = spark.createDataFrame([("a", "r", 1), ("b", "r", 2), ("c", "r", 3)], "source string, rule string, trust_rank int")
    rows = [(1, "e", "x", "X1", "a", "r", T0, "", 1), (2, "e", "x", "X2", "b", "r", T0, "", 1), (3, "e", "y", "Y2", "b", "r", T0 - timedelta(days=9), "", 1), (4, "e", "z", "Z3", "c", "r", T0 - timedelta(days=99), "", 1), (5, "e", "z", "n/a", "a", "r", T0, "", 1)]
    got = S.golden_records(spark.createDataFrame(rows, SCHEMA), "entity_id", "field_name", "field_value", trust).first()
    assert (got["record"], got["base_rank"], got["n_records"], got["n_layers"]) == ('{"x":"X1","y":"Y2","z":"Z3"}', 1, 3, 2)


def golden_by_hand(rows, ranks):
    out = {}
    for e in {r[1] for r in rows}:
        cells = {}
        for r in rows:
            if r[1] == e:
                key = (ranks.get((r[4], r[5]), 2147483647), r[2])
                cells[key] = max(cells.get(key, (datetime(1, 1, 1), -(10**9), "")), (r[6] or datetime(1, 1, 1), -r[0], r[3]))
        recs = []
        for k in {k for k, _ in cells}:
            m = {f: c[2] for (j, f), c in cells.items() if j == k}
            recs.append((len(m), max(c[0] for (j, _), c in cells.items() if j == k), -k, m))
        left, layers = list(recs), []
        while left:
            top = [r for r in left if not any(all(x >= y for x, y in zip(o[:3], r[:3])) and o[:3] != r[:3] for o in left)]
            layers.append(sorted(top, key=lambda r: (-r[2], -r[1].timestamp() if r[1].year > 1 else 10**12, -r[0])))
            left = [r for r in left if r not in top]
        record = {}
        for layer in layers:
            for r in layer:
                for f, v in r[3].items():
                    record.setdefault(f, v)
        out[e] = (len(recs), len(layers), -layers[0][0][2], record)
    return out


def test_golden_records_match_layers_peeled_by_hand(spark):
    import json

    rng = random.Random(8)
    trust = [(s, "r", i + 1) for i, s in enumerate("abcdefgh")]
    rows = [(i, f"e{rng.randrange(25)}", f"f{rng.randrange(5)}", f"V{i}q", rng.choice("abcdefghz"), "r", rng.choice([None, T0, T0 + timedelta(days=1), T0 + timedelta(days=2)])) for i in range(300)]
    got = S.golden_records(spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA), "entity_id", "field_name", "field_value", spark.createDataFrame(trust, "source string, rule string, trust_rank int")).collect()
    assert {r["entity_id"]: (r["n_records"], r["n_layers"], r["base_rank"], json.loads(r["record"])) for r in got} == golden_by_hand(rows, {(s, r): k for s, r, k in trust})


def test_long_values_and_a_long_trust_list(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_RANKS", 1)
    rng = random.Random(9)
    words = ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 40))).strip() or "a" for _ in range(300)]
    words += [w[: rng.randrange(1, len(w) + 1)] for w in words]
    trust = [("manual", "reviewed", 1), ("kg", "auto", 2)]
    rows = [(i, f"e{i % 3}", "f", w, rng.choice(["manual", "kg"]), rng.choice(["reviewed", "auto"]), T0) for i, w in enumerate(words)]
    assert {k: r["id"] for k, r in run(spark, rows, trust).items() if r["id"] is not None} == brute(rows, trust)
