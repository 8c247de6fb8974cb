"""Small fixtures for operators of the core: areas, upserts, graphs, retrieval, diagnostics, streams."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from demesne.operators import graph, measures, quality, upsert
from demesne.operators import retrieval as R
from demesne.runtime import cut, hot_join, lookup_join, spread
from demesne.streaming import events as S

AREA = "id long, acres double, acres_irish double, acres_english double, holding_acres double, comments string, holding_on_estate string, statute_acres double"


def test_areas(spark):
    rows = [
        (1, None, None, 10.0, 10.1, None, None, 0.0), (2, None, 10.0, None, 10.0, "", None, 0.0), (3, 10.0, None, None, 10.0, "[Irish plantation acres]", None, 0.0), (4, 160.0, None, None, 1.0, "Wife is sickly.", "sq. perches", 0.0),
        (5, 160.0, None, None, 1.0, None, "[sq. perches]", 0.0), (6, None, None, None, 7.719, "7a 2r 35p old Irish acres", None, 0.0), (7, None, None, None, 5.0, "Irish speaker, per clerk.", None, 0.0), (8, None, None, None, None, "3 acres", None, 0.0), (9, 5.0, 5.0, 8.1, 5.0, None, None, 0.0),
        (10, None, None, 0.0, 1.0, None, None, 0.0), (11, 3.0, None, None, 3.0, "x" * 100_000, None, 0.0), (None, None, None, None, None, None, None, None), (2, None, 10.0, None, 10.0, "", None, 0.0),
    ]
    got = sorted(r["id"] for r in measures.misstated_holdings(spark.createDataFrame(rows, AREA)).collect())
    assert got == [2, 2, 3, 4, 6, 9, 10]
    assert measures.misstated_holdings(spark.createDataFrame([], AREA)).count() == 0


def test_lookup_join_with_a_hot_key(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, -1)], "k long, x long")
    right = spark.createDataFrame([(1, "one"), (3, "three")], "k long, y string")
    inner = lookup_join(left, right, ["k"]).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in inner} == {"one": 200, "three": 1}
    assert lookup_join(left, right, ["k"], "left").count() == 301


def test_merge_rules(spark):
    s = "k string, a string, b string, c string, l string"
    old = spark.createDataFrame([("x", "1", "1", "1", '["o"]'), ("y", None, "2", "2", None)], s)
    new = spark.createDataFrame([("x", None, "9", None, "[]"), ("z", "3", "3", "3", '["n"]')], s)
    got = {r["k"]: tuple(r)[1:] for r in upsert.merge_survivor(old, new, "k", {"a": "new", "b": "old", "c": "overwrite", "l": "list"}).collect()}
    assert got == {"x": ("1", "1", None, '["o"]'), "y": (None, "2", "2", None), "z": ("3", "3", "3", '["n"]')}


def test_hash_diff_and_precedence(spark):
    a = spark.createDataFrame([(1, "h"), (2, "h"), (3, "h")], "id long, content_hash string")
    b = spark.createDataFrame([(2, "h"), (3, "new"), (4, "h")], "id long, content_hash string")
    assert {r["id"]: r["action"] for r in upsert.hash_diff(a, b, "id").collect()} == {1: "delete", 3: "update", 4: "insert"}
    first = spark.createDataFrame([("p", 1)], "k string, v long")
    second = spark.createDataFrame([("p", 9), ("q", 2)], "k string, v long")
    assert {tuple(r) for r in upsert.by_precedence([first, second], ["k"]).collect()} == {("p", 1), ("q", 2)}


def test_graph_walks_and_patterns(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r"), ("x", "y", "r")], "src string, dst string, rel string")
    hops = {r["node"]: r["hop"] for r in graph.k_hops(e, spark.createDataFrame([("b",)], "node string"), 2).collect()}
    assert hops == {"b": 0, "a": 1, "c": 1, "d": 2}
    nodes = spark.createDataFrame([(n,) for n in "abcz"], "node string")
    assert [r["node"] for r in graph.orphans(nodes, e).collect()] == ["z"]
    assert {(r["src"], r["dst"]) for r in graph.dangling(nodes, e).collect()} == {("c", "d"), ("x", "y")}
    assert {r["vertex"]: r["component"] for r in graph.components(e, "src", "dst").collect()} == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("xy", "x")}
    t = spark.createDataFrame([("p1", "livedIn", "x"), ("x", "inParish", "k"), ("p2", "livedIn", "y")], "s string, p string, o string")
    assert [tuple(r) for r in graph.match_pattern(t, ("?p", "livedIn", "?t"), ("?t", "inParish", "?k")).select("p", "k").collect()] == [("p1", "k")]
    with pytest.raises(ValueError):
        graph.match_pattern(t, ("?a", "livedIn", "?b"), ("?c", "inParish", "?d"))


def test_fusion_and_cosine(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q long, d long, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "q long, d long, rank int")
    got = {r["d"]: r["score"] for r in R.fuse(a, b, "q", "d").collect()}
    assert got[11] == pytest.approx(1 / 62 + 1 / 61) and got[10] == pytest.approx(1 / 61)
    weighted = {r["d"]: r["score"] for r in R.fuse(a, b, "q", "d", (0.6, 0.4)).collect()}
    assert weighted[10] == pytest.approx(0.6 / 61 + 0.4 / (60 + 1 + 60))
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in v.select(R.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 0.0]


def test_vector_search_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(200)] + [(999, None)], "vec_id long, embedding array<double>").repartition(5)
    q = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r["query_id"], r["vec_id"]) for r in R.vector_search(q, df, 5).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert got == {(i, int(j)) for i in range(0, 200, 50) for j in np.argsort(-(u[i] @ u.T))[:5]}
    assert R.vector_search(q.limit(0), df, 5).count() == 0


def test_diagnostics(spark):
    df = spark.createDataFrame([(None, 1)] * 6 + [("a", 2)], "x string, y long")
    got = {r["column"]: (r["nulls"], r["warn"]) for r in quality.null_rates(df, ["x", "y"]).collect()}
    assert got == {"x": (6, 1), "y": (0, 0)}
    assert quality.null_rates(df.limit(0), ["x"]).first()["rate"] is None
    a = spark.createDataFrame([("p", 100), ("q", 100), ("r", 100), ("s", 1)], "k string, v long")
    b = spark.createDataFrame([("p", 98), ("q", 90), ("r", 10), ("t", 1)], "k string, v long")
    assert {r["k"]: r["verdict"] for r in quality.lane_discrepancy(a, b, "k", "v").collect()} == {"p": "agree", "q": "close", "r": "differ", "s": "missing", "t": "missing"}


def test_stream_drops_late_rows(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    os.makedirs(tmp_path / "events.parquet")
    rows = lambda at: spark.createDataFrame([(i, t0 + datetime.timedelta(minutes=m), 1, "click", 1.0, "{}") for i, m in at], schema)
    rows([(1, 0), (2, 30), (1, 0)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = S.event_stream(spark, str(tmp_path))
    assert S.drain(S.deduplicated(stream)).count() == 2
    assert [r["n"] for r in S.drain(S.tumbling(stream, "1 hour"), "complete").collect()] == [3]


def test_hot_join_cuts_hot_keys_and_loses_nothing(spark):
    left = spark.createDataFrame([(1 if i % 3 else i % 40, i) for i in range(900)] + [(None, -1)], "k long, x long")
    right = spark.createDataFrame([(1 if i % 2 else i % 50, i) for i in range(500)] + [(None, -2)], "k long, y long")
    want = sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))
    for least in (10, 100, 10_000):
        assert sorted(map(tuple, hot_join(left, right, ["k"], least).select("k", "x", "y").collect())) == want
    assert hot_join(left.limit(0), right, ["k"], 10).count() == 0 and hot_join(left, right.limit(0), ["k"], 10).count() == 0


def test_spread_is_not_planned_away(spark):
    df = spark.range(4000).selectExpr("id % 1000 as k").distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def size(batches):
        import pandas as pd

        yield pd.DataFrame({"n": [sum(len(b) for b in batches)]})

    sizes = spread(df, "k").mapInPandas(size, "n long").collect()
    filled = [r["n"] for r in sizes if r["n"]]
    assert len(filled) >= min(n, spark.sparkContext.defaultParallelism) and sum(filled) == 1000 and max(filled) < 500


def test_a_long_loop_of_joins_and_cuts_stays_quick(spark):
    import time

    df = cut(spark.range(20).withColumnRenamed("id", "a"))
    took = []
    for _ in range(34):
        began = time.time()
        df = cut(df.join(df.withColumnRenamed("a", "b"), F.col("a") == F.col("b")).select("a").distinct())
        took.append(time.time() - began)
    assert df.count() == 20 and max(took[-5:]) < 5 * max(1.0, sorted(took)[len(took) // 2])


def test_components_raise_rather_than_stop(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["component"] for r in graph.components(chain, "a", "b").collect()} == {0}
    monkeypatch.setattr(graph, "MAX_STEPS", 1)
    with pytest.raises(RuntimeError):
        graph.components(chain, "a", "b")


def test_optional_and_filtered_patterns(spark):
    t = spark.createDataFrame([("x", "in", "A"), ("y", "in", "B"), ("A", "of", "P"), ("x", "year", "1840"), ("y", "year", "1860")], "s string, p string, o string")
    found = graph.match_pattern(t, ("?w", "in", "?p"), ("?w", "year", "?y"), optional=(("?p", "of", "?q"),)).collect()
    assert {(r["w"], r["q"]) for r in found} == {("x", "P"), ("y", None)}
    assert [r["w"] for r in graph.match_pattern(t, ("?w", "in", "?p"), ("?w", "year", "?y"), where=F.col("y").cast("int") < 1850).collect()] == ["x"]


def test_prune_nodes(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r")], "src string, dst string, rel string")
    kept, between = graph.prune_nodes(nodes, edges, F.when(F.col("node") == "c", 5).otherwise(1), 2)
    assert {r["node"] for r in kept.collect()} == {"a", "c"} and between.count() == 0


def test_random_projection_index_recalls_nine_tenths(spark):
    from demesne.plans import q_retrieval

    assert q_retrieval.r_lsh_recall(spark, "/root/testdata/sf0.001").first()["recall"] >= 0.9


def test_ladder_with_gender_and_sounds(spark):
    from demesne.functions.similarity import metaphone_col, token_sort_col
    from demesne.operators import er

    f = ["name", "surname", "forename", "place", "birth", "gender", "year", "age"]
    rows = [
        ("JOHN BYRNE", "BYRNE", "JOHN", "KILROE", 1800, "M", 1840, 40, "BYRNE JOHN", "BYRNE", "JOHN", "KILROE", 1801, "M", 1841, 41),
        ("JOHN BYRNE", "BYRNE", "JOHN", "KILROE", 1800, "M", 1840, 40, "MARY BIRNE", "BIRNE", "MARY", "KILROE UPPER", 1830, "F", 1841, 11),
        ("JOHN BYRNE", "BYRNE", "JOHN", None, None, None, None, None, "X", "X", None, None, None, None, None, None),
    ]
    schema = ", ".join(f"{c}_{s} {'int' if c in ('birth', 'year', 'age') else 'string'}" for s in "ab" for c in f)
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    df = spark.createDataFrame(rows, schema)
    got = df.select(er.match_score(a, b, token_sort_col, metaphone_col).alias("s"), er.evidence(a, b, token_sort_col, metaphone_col).alias("e")).collect()
    # 10 + 10 + 10 + 10 + 5 + 10 + 5; then an impossible one, capped; then one of which little is known
    assert got[0]["s"]["score"] == 1.0 and got[1]["s"]["impossible"] and got[1]["s"]["score"] <= 0.39 and abs(got[2]["s"]["score"] - 10 / 60) < 1e-9
    assert "gender same" in got[0]["e"]["evidence"] and {"birth impossible", "gender differs", "forename differs"} <= set(got[1]["e"]["conflicts"]) and {"birth", "gender", "time", "place"} <= set(got[2]["e"]["missing"])


def test_louvain_finds_cliques(spark):
    import itertools

    cliques = [list(itertools.combinations(range(10 * c, 10 * c + 6), 2)) for c in range(5)]
    bridges = [(10 * c, 10 * ((c + 1) % 5) + 1) for c in range(5)]
    e = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}") for a, b in [*itertools.chain(*cliques), *bridges]], "src string, dst string")
    got = graph.louvain(e)
    groups = {}
    for r in got.collect():
        groups.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[f"n{10 * c + i:02d}" for i in range(6)] for c in range(5)]
    assert all(k == min(g) for k, g in groups.items()) and graph.modularity(e, got) > 0.7
    assert graph.louvain(e.limit(0)).count() == 0
