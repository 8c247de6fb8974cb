import json

from demesne.sources import readers, sinks


def test_delimited_is_cleaned(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('Name,Age,Gender,Flag,Place\n"  Ann, of X ",31.7,female,yes," cool  bawn "\nnan,x,?,0,\n', encoding="utf-8")
    rows = readers.read_delimited(spark, str(f), {"name": "text", "age": "int", "gender": "gender", "flag": "flag", "place": "place", "absent": "float"}).collect()
    assert tuple(rows[0]) == ("Ann, of X", 31, "F", 1, "COOL BAWN", None)
    assert tuple(rows[1])[:4] == (None, None, None, 0)


def test_wide_census_unpivots(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_text("Townland,1841 Male,1841 Female,1851 Male,Note\nA,1,2,,x\nA,3,,,y\nB,,,,z\n", encoding="utf-8")
    got = {(r["Townland"], r["year"], r["kind"]): r["value"] for r in readers.read_wide_census(spark, str(f)).collect()}
    assert got[("A", 1841, "male")] == 4 and got[("A", 1841, "female")] == 2 and got[("A", 1851, "male")] is None and got[("B", 1841, "male")] is None


def test_features(spark, tmp_path):
    feature = lambda name, kind, xy: {"type": "Feature", "properties": {"name": name, "monument_class": kind}, "geometry": {"type": "Point", "coordinates": xy}}
    f = tmp_path / "m.geojson"
    f.write_text(json.dumps({"type": "FeatureCollection", "features": [feature("a", "Ritual site - holy well", [-6.3, 52.8]), feature("b", "Ringfort - rath", [-6.2, 52.7]), feature("c", "Castle", [-6.2, 52.7]), feature("d", "Ringfort", [0, 0])]}), encoding="utf-8")
    got = readers.point_features(readers.read_features(spark, str(f)), {"holy_well": ["holy well"], "ring_fort": ["ringfort", "rath"]})
    assert sorted((r["feature_group"], r["name"]) for r in got.collect()) == [("holy_well", "a"), ("ring_fort", "b")]


def test_aliases_columns_and_files(spark, tmp_path):
    f = tmp_path / "a.json"
    f.write_text('{"Old Name": "NAME"}', encoding="utf-8")
    assert [tuple(r) for r in readers.read_aliases(spark, str(f)).collect()] == [("Old Name", "NAME")]
    assert readers.pick_column(["Year ", "Ship name"], ["ship"]) == "Ship name" and readers.pick_column(["a"], ["b"]) is None
    assert readers.find_file("a.json", ["/none", str(tmp_path)]) == str(f)


def test_turtle_round_trip(spark, tmp_path):
    rows = [("person:1", "surname", 'O"Neill \\ x'), ("person:1", "note", "two\nlines")]
    sinks.export_turtle(spark.createDataFrame(rows, "s string, p string, o string"), str(tmp_path / "t"), base="")
    got = {r["p"]: r["o"] for r in readers.read_turtle(spark, str(tmp_path / "t")).collect()}
    assert got["surname"].replace('\\"', '"').replace("\\\\", "\\") == 'O"Neill \\ x' and got["note"] == "two\\nlines"


def test_exports_and_append(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, x string")
    sinks.export_delimited(df, str(tmp_path / "e"), {"scope": "all"})
    assert spark.read.option("header", True).csv(str(tmp_path / "e/data")).count() == 3
    assert spark.read.json(str(tmp_path / "e/meta")).first()["scope"] == "all"
    assert sinks.append_new(df, str(tmp_path / "p"), ["id"]) == 2
    assert sinks.append_new(spark.createDataFrame([(2, "z"), (3, "c")], "id long, x string"), str(tmp_path / "p"), ["id"]) == 1
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    sinks.export_features(spark.createDataFrame([("a", -6.0, 52.0)], "name string, lon double, lat double"), str(tmp_path / "g"), "lon", "lat", ["name"])
    assert json.loads(spark.read.text(str(tmp_path / "g")).first()[0])["geometry"]["coordinates"] == [-6.0, 52.0]


def test_snapshot_and_fingerprint(spark, tmp_path):
    f = tmp_path / "s.json"
    assert readers.read_snapshot(spark, str(f)).count() == 0 and readers.fingerprint(spark, str(f), "1") == "1:absent"
    f.write_text(json.dumps([{"name": " A ", "area_ha": "12.5", "other": 1}, {"name": "nan", "barony": "B", "area_ha": None}]), encoding="utf-8")
    rows = readers.read_snapshot(spark, str(f)).collect()
    assert [(r["name"], r["barony"], r["area_ha"]) for r in rows] == [("A", None, 12.5), (None, "B", None)]
    before = readers.fingerprint(spark, str(f), "1")
    assert before == readers.fingerprint(spark, str(f), "1") != readers.fingerprint(spark, str(f), "2")
    f.write_text("[]", encoding="utf-8")
    assert readers.fingerprint(spark, str(f), "1") != before and readers.read_snapshot(spark, str(f)).count() == 0
    sinks.export_snapshot(spark.createDataFrame([("A", 1.0), ("B", None)], "name string, area_ha double"), str(tmp_path / "o"))
    assert sorted(json.loads(r[0]).get("area_ha") or 0 for r in spark.read.text(str(tmp_path / "o")).collect()) == [0, 1.0]
