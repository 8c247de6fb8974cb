"""Units, similarities, cleaning, geometry text, guard, router and evaluation measures."""

import math

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from demesne.functions import similarity as S
from demesne.functions import units as U
from demesne.functions.geometry import polygon_parts, slabs
from demesne.plans import evaluation as E
from demesne.plans import router
from demesne.plans.metrics import METRICS, Slots, validate

DB = duckdb.connect()


@pytest.mark.parametrize(
    ("text", "value", "acres"),
    [
        ("5.12 hectares.", 5.12, 10000 / U.STATUTE_ACRE), ("Holding entered as 11.73 ha.", 11.73, 10000 / U.STATUTE_ACRE), ("Survey gives 3.55 I.M.", 3.55, 196 / 121), ("7a 2r 35p old Irish acres", 7.71875, 196 / 121), ("A.17 R.3 P.24 statute acres", 17.9, 1.0),
        ("12 acres, 1 roods, 13 perches E.M.", 12.33125, 1.0), ("13 ac. 1 ro. 0 per. Cunn. meas.", 13.25, 625 / 484), ("66.56 roods, not acres", 66.56, 0.25), ("1092.8 square perches.", 1092.8, 1 / 160), ("2,472.0 perches of land", 2472.0, 1 / 160),
        ("Figure in Cunningham measure.", None, 625 / 484), ("[hectares (modern survey)]", None, 10000 / U.STATUTE_ACRE), ("Area is in by the Irish acre; see map", None, 196 / 121), ("To get timber. 3 ½ acres", 3.5, 1.0),
        ("Irish speaker, per clerk.", None, None), ("An Irish bible found in the house.", None, None), ("Statute of limitations pleaded in court.", None, None), ("Turf bank of forty perches frontage noted on map only.", None, None), ("40 perches of ditch", None, None), ("Acres of bog let in common, not measured.", None, None), ("", None, None), (None, None, None), ("House to be slated by the estate.", None, None),
    ],
)
def test_stated_areas(text, value, acres):
    got = U.area(text)
    assert got[0] == pytest.approx(value) if value is not None else got[0] is None
    assert got[1] == pytest.approx(acres) if acres is not None else got[1] is None


def test_dimensions_and_offsets():
    (speed,) = [q for q in U.quantities("rent of 3 pounds per acre")]
    assert speed.unit.dim == U.dim(money=1, length=-2)
    (warm,) = U.quantities("212 fahrenheit")
    assert warm.canonical == pytest.approx(373.15)
    assert U.quantities("10 cwt")[0].canonical == pytest.approx(508.0234544) and U.quantities("x" * 50_000) == ()


@settings(max_examples=60, deadline=None)
@given(a=st.integers(0, 500), r=st.integers(0, 3), p=st.integers(0, 39))
def test_compound_round_trip(a, r, p):
    assert U.area(f"{a}a. {r}r. {p}p. statute measure")[0] == pytest.approx(a + r / 4 + p / 160)


@settings(max_examples=80, deadline=None)
@given(a=st.text("abcdef ", min_size=1, max_size=10), b=st.text("abcdef ", min_size=1, max_size=10))
def test_similarities(a, b):
    want = DB.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0]
    assert S.jaro_winkler(a, b) == pytest.approx(want, abs=1e-9)
    assert 0 <= S.token_sort_ratio(a, b) <= 100 and S.token_sort_ratio(a, b) == pytest.approx(S.token_sort_ratio(b, a))


def test_known_similarities():
    assert S.token_sort_ratio("john doe", "doe john") == 100 and S.matcher_ratio("abcd", "bcde") == 0.75 and S.indel_ratio("", "") == 100
    assert S.metaphone("Knight").startswith("N") and S.jaro_winkler("", "") == 1.0 and S.jaro_winkler("", "a") == 0.0
    assert S.metaphone("Philip") == "FLP" and S.metaphone("Thomas")[0] in "0T" and S.metaphone("") == ""


def test_polygon_texts():
    ring = "(-6 52, -6 53, -5 53, -5 52, -6 52)"
    for text in (f"POLYGON ({ring})", f"srid=4326; polygon({ring})", "POLYGON Z ((-6 52 0, -6 53 0, -5 53 0, -5 52 0, -6 52 0))", "POLYGON((52 -6, 53 -6, 53 -5, 52 -5, 52 -6))"):
        (part,) = polygon_parts(text)
        assert part[0][:, 0].min() == -6 and part[0][:, 1].max() == 53
    assert len(polygon_parts(f"MULTIPOLYGON (({ring}), ({ring}))")) == 2
    for text in (None, "", "n/a", "POLYGON EMPTY", "POLYGON ((-6 52, -6 53", "POINT (-6 52)", "POLYGON ((-6 52, -6 53, -5 53))", "POLYGON ((a b, c d, e f, a b))", f"POLYGON ({ring}"):
        assert polygon_parts(text) == []
    assert [s[:2] for s in slabs(polygon_parts(f"POLYGON ({ring})")[0])] == [(-6.0, -5.0)]


@pytest.mark.parametrize(("question", "metric", "dims", "filters"), [("How many people emigrated in 1848?", "emigration_count", (), {"year": 1848}), ("Show evictions per year", "eviction_event_count", ("year",), {}), ("How many widows are recorded?", "widow_count", (), {}), ("Average holding of female tenants", "avg_holding_acres", (), {"gender": "Female"}), ("How many people sailed to Canada between 1847 and 1851?", "canada_emigration_count", (), {"year_range": (1847, 1851)})])
def test_questions(question, metric, dims, filters):
    r = router.read_question(question)
    assert (r.slots.metric, r.slots.group_by, r.slots.filters) == (metric, dims, filters)


def test_refusals_places_and_wording():
    assert router.read_question("What was the weather like?").slots is None and router.read_question("Tell me a story").slots is None
    assert router.read_question("How many people emigrated from Cool Bawn?", ["Cool", "Cool Bawn"]).slots.filters == {"townland": "Cool Bawn"}
    assert router.answer_text("q", []) == "No record answers this." and router.answer_text("q", [{"value": 3}]) == "3"
    assert router.chart_spec([{"year": 1847, "value": 1}, {"year": 1848, "value": 2}])["kind"] == "line" and router.chart_spec([{"a": 1}]) is None


def test_slots_are_validated():
    assert len(METRICS) == 14
    for bad in (Slots("nothing"), Slots("population", ("ship",)), Slots("population", (), {"gender": "x"}), Slots("population", (), {}, 0)):
        with pytest.raises(ValueError):
            validate(bad)


def test_guard(spark):
    assert router.guarded(spark, "select :x as x", {"x": 3}).first()["x"] == 3
    for sql in ("drop table a", "select 1; select 2", "", "delete from a"):
        with pytest.raises(ValueError):
            router.guarded(spark, sql)


def test_evaluation():
    assert E.same_scalar("6,016", 6010) and not E.same_scalar(100, 90) and E.same_scalar(" Kilbride", "KILBRIDE")
    assert E.same_row_value([{"y": 1847, "n": 2211}], 1847, 2211) and not E.same_row_value([{"y": 1848, "n": 2211}], 1847, 2211)
    assert E.same_total([{"a": "x", "n": 2}, {"a": "y", "n": 3}], 5) and E.nearest_rank([3, 1, 2], 0.5) == 2 and E.nearest_rank([], 0.5) is None and E.recall_of([1], [1, 2]) == 0.5
    assert math.isclose(E.recall_of([], []), 1.0)


def test_overlap_of_outlines():
    from demesne.functions.geometry import iou, shape_flag

    box = lambda x, y, w: f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + w}, {x} {y + w}, {x} {y}))"
    assert iou(box(-7, 52, 1), box(-7, 52, 1)) == pytest.approx(1.0) and iou(box(-7, 52, 1), box(-5.5, 52, 1)) == 0.0
    assert iou(box(-7, 52, 1), box(-6.5, 52.5, 1)) == pytest.approx(0.25 / 1.75)
    holed = "POLYGON ((-7 52, -6 52, -6 53, -7 53, -7 52), (-6.75 52.25, -6.25 52.25, -6.25 52.75, -6.75 52.75, -6.75 52.25))"
    assert iou(box(-7, 52, 1), holed) == pytest.approx(0.75) and iou(None, holed) is None and iou("n/a", "x") is None
    diamond = "POLYGON ((-6.5 52, -6 52.5, -6.5 53, -7 52.5, -6.5 52))"
    assert iou(box(-7, 52, 1), diamond) == pytest.approx(0.5)
    flags = [shape_flag(t) for t in (None, "POINT (1 2)", "POLYGON EMPTY", "POLYGON ((1 2", box(-7, 52, 1), box(20, 20, 1), "POLYGON ((52 -7, 53 -7, 53 -6, 52 -6, 52 -7))")]
    assert flags == ["missing", "point", "empty", "broken", "valid", "outside", "repaired"]
