"""Strategy queries against SQL over odd tables, without their pairs being listed."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from demesne.functions.similarity import levenshtein_ratio
from demesne.operators import candidates, er
from demesne.plans import q_er
from pyspark.sql import functions as F

MENTIONS = "id long, forename string, surname string, raw_place string, event_year int, updated_at timestamp_ntz"
RECORDS = "record_id string, forename string, surname string, townland_norm string, year int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(5)
    fore = ["Mary", "Mary Ann", "Márta", "John", "Jon", "J", "", None, "Óscar", "Ann"]
    sur = ["Byrne", "Birne", "Ann Byrne", "O'Byrne", "Beirne", "Kavanagh", "Kavanah", "123", "É", "", None, "Kinsella"]
    place = ["Ballina", "Ballinacor", "Balli", "Upper Ballina", "Ba", "Kil", "Kilmore", "", None, "?"]
    year = [1840, 1845, 1851, 1862, None]
    row = lambda: (rng.choice(fore), rng.choice(sur), rng.choice(place), rng.choice(year))
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, *row(), datetime(2021, 1, 1) + timedelta(days=k)) for k, i in enumerate([*range(300), *range(20)])], MENTIONS).write.parquet(f"{d}/source_mentions.parquet")
    spark.createDataFrame([(f"U{i}", *row()) for i in [*range(400), *range(20)]], RECORDS).write.parquet(f"{d}/unified_record.parquet")
    return d


@pytest.mark.parametrize("name", ["e_link_summary", "e_strategy_counts"])
def test_strategies_counted_without_listing_pairs(spark, odd, monkeypatch, name):
    def listed(*_):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(q_er, "_strategy_pairs", listed)
    con = duckdb.connect()
    for t in ("source_mentions", "unified_record"):
        con.execute(f"create view {t} as select * from read_parquet('{odd}/{t}.parquet/*.parquet')")
    res = con.execute(q_er.SQL[name])
    cols = [c[0] for c in res.description]
    want = sorted(tuple(r) for r in res.fetchall())
    got = sorted(tuple(r[c] for c in cols) for r in q_er.QUERIES[name](spark, odd).collect())
    assert got == want and len(want) > 2


def test_near_names_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(er, "NAMES", 7)
    rng = random.Random(2)
    names = sorted({"".join(rng.choice("AB C") for _ in range(rng.randrange(1, 14))) for _ in range(120)})
    df = lambda xs: spark.createDataFrame([(n[0], n) for n in xs], "group string, name string")
    left, right = df(names[::2]), df(names)
    every = left.withColumnRenamed("name", "name_a").join(right.withColumnRenamed("name", "name_b"), "group").where(levenshtein_ratio(F.col("name_a"), F.col("name_b")) >= 82).select("name_a", "name_b")
    assert {tuple(r) for r in er.near_names(left, right, 82.0).collect()} == {tuple(r) for r in every.collect()}


@pytest.mark.parametrize("most,left,right", [(25, 1000, 4000), (25, 5, 7), (3, 1000, 4000)])
def test_best_candidates_without_listing_pairs(spark, odd, monkeypatch, most, left, right):
    """The best of small blocks, and of contents that many ids share, are those of SQL, ties by id included."""
    def listed(*_):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(q_er, "_strategy_pairs", listed)
    monkeypatch.setattr(candidates, "LEFT", left)
    monkeypatch.setattr(candidates, "RIGHT", right)
    monkeypatch.setattr(candidates, "SMALL", left * right // 2)
    con = duckdb.connect()
    for t in ("source_mentions", "unified_record"):
        con.execute(f"create view {t} as select * from read_parquet('{odd}/{t}.parquet/*.parquet')")
    res = con.execute(q_er.SQL["e_strategy_candidates"].replace("rank <= 25", f"rank <= {most}"))
    cols = [c[0] for c in res.description]
    want = sorted(tuple(r) for r in res.fetchall())
    got = q_er.e_strategy_candidates(spark, odd) if most == 25 else candidates.best_candidates(*q_er._sides(spark, odd), "id", "record_id", q_er._sounded, most)
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == want and len(want) > 500
    assert dict(got.dtypes) == {"id": "bigint", "record_id": "string", "n": "int", "apart": "double", "rank": "int"}


def test_best_of_records_of_one_content(spark):
    """Of a thousand records alike the first ids are given, in any number of blocks."""
    m = spark.createDataFrame([(1, "ANN", "BYRNE", "KIL", 1850), (2, "ANN", "BYRNE", "KIL", 1850), (3, "", "BYRNE", "", 1850)], "id long, forename string, surname string, place string, year int")
    r = spark.createDataFrame([(f"R{i:04d}", "ANN", "BYRNE", "KIL", None) for i in range(1000)] + [("R00005", "ANN", "BYRNE", "KILMORE", None)], "record_id string, forename string, surname string, place string, year int")
    got = sorted(map(tuple, candidates.best_candidates(m, r, "id", "record_id", q_er._sounded).collect()))
    assert got == [(i, f"R{k:04d}", 5, 0.0, k + 1) for i in (1, 2) for k in range(25)]


def test_distances_of_many_lists_together(monkeypatch):
    monkeypatch.setattr(candidates, "STEP", 17)
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("ABÉ 😀") for _ in range(rng.randrange(9)))
    sides = [([text() for _ in range(rng.randrange(1, 7))], [text() for _ in range(rng.randrange(1, 7))]) for _ in range(30)]
    assert all((got == er.edits(*s)).all() for got, s in zip(candidates._distances(sides), sides))
