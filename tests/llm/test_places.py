import pytest

from demesne.llm import places as P
from demesne.llm.text import osa

NAMES = ["BALLYGLASS", "KNOCKTANVEA LOWER", "KNOCKTANVEA UPPER", "DERRYSORUR", "COOLJINTORDUFF", "AGHADILVEA"]
ALIASES = [("Fort Huldila", "DERRYSORUR"), ("Nowhere", "NOT A NAME")]


@pytest.mark.parametrize(
    ("raw", "name"),
    [
        ("ballyglass", "BALLYGLASS"), ("Bállýglass.", "BALLYGLASS"), ("B'glass", "BALLYGLASS"), ("BA1LYG1ASS", "BALLYGLASS"), ("the lands of Ballyglass, Wicklow", "BALLYGLASS"), ("Ballygalss [Estate]", "BALLYGLASS"),
        ("Knocktanvea, Lwr", "KNOCKTANVEA LOWER"), ("Up. Knocktanvea", "KNOCKTANVEA UPPER"), ("Knock-Tanvea (Upr.)", "KNOCKTANVEA UPPER"), ("Knocktanvea", None),
        ("D'rysorur (Dunfesk)", "DERRYSORUR"), ("fort huldila", "DERRYSORUR"), ("Cool Jintorduf, Parish of X", "COOLJINTORDUFF"), ("C0OLJ1NT0RDUFF", "COOLJINTORDUFF"), ("Ahadilvai", "AGHADILVEA"),
        ("12 Slate Lane, Pembdale", None), ("Born in this workhouse", None), ("", None), (None, None), ("?", None), ("x" * 20_000, None), ("Nowhere", None),
    ],
)
def test_spellings(raw, name):
    book = P.Dictionary([(n, n, 1) for n in NAMES] + [(a, n, 1) for a, n in ALIASES if n in NAMES])
    assert book.best(raw)[0] == name


def test_distance_is_weighted():
    assert osa("abcd", "abdc") == 0.8 and osa("abcd", "abdc", weighted=False) == 1 and osa("aab", "ab") == 0.5 and osa("o1", "0i") == 1.2
    assert osa("abc", "xyz", 1.0) > 1.0 and osa("", "") == 0 and osa("", "abc") == 3


def test_blocks_of_the_reference_and_dirty_tables(spark, monkeypatch):
    names = spark.createDataFrame([(n, 1) for n in [*NAMES, None, " "]], "name string, freq long")
    aliases = spark.createDataFrame([*ALIASES, (None, "x"), ("y", None)], "alias string, canonical_name string")
    rows = spark.createDataFrame([(1, "ballyglas", "x"), (2, None, "y"), (3, "ballyglas", "z"), (4, "", None)], "id long, raw string, name string")
    whole = {r["raw"]: r["name"] for r in P.map_spellings(rows, "raw", names, aliases).collect()}
    monkeypatch.setattr(P, "MAX_NAMES", 2)
    parts = {r["raw"]: r["name"] for r in P.map_spellings(rows, "raw", names, aliases).collect()}
    assert whole == parts == {"ballyglas": "BALLYGLASS", "": None}
    nothing = P.map_spellings(rows, "raw", names.where("freq > 1"), aliases.limit(0)).collect()
    assert all(r["name"] is None for r in nothing)
    assert P.map_spellings(rows.limit(0), "raw", names, aliases).count() == 0


RAW = ["kilrobin", "Kilrobin Upr.", "Kilrobn Lower", "kilrobin west", "ballyglass", "Balyglass", "dunmore", "Dunmoor", "x", "", "Robinstown", "Kilrabin"]


@pytest.mark.parametrize("size", [1, 2, 3])
def test_any_number_of_blocks_gives_the_same(spark, monkeypatch, size):
    listed = [("KILROBIN UPPER", 2), ("KILROBIN LOWER", 5), ("BALLYGLASS", 1), ("DUNMORE", 3), ("DUNMOOR", 9), ("KILRABEN", 1), ("ROBINSTOWN", 1)]
    names = spark.createDataFrame(listed, "name string, freq long")
    aliases = spark.createDataFrame([("Kilrobin West", "KILROBIN LOWER"), ("Robin", "ROBINSTOWN")], "alias string, canonical_name string")
    rows = spark.createDataFrame([(r,) for r in RAW], "raw string")
    whole = {r["raw"]: tuple(r) for r in P.map_spellings(rows, "raw", names, aliases).collect()}
    assert whole["kilrobin"][1] is None and whole["Kilrobin Upr."][1] == "KILROBIN UPPER" and len(whole) == len(RAW)
    monkeypatch.setattr(P, "MAX_NAMES", size)
    assert {r["raw"]: tuple(r) for r in P.map_spellings(rows, "raw", names, aliases).collect()} == whole


def test_dictionary_is_compact():
    names = [f"BALLY{a}{b}{c}" for a in ("GLASS", "KNOCK", "MORE", "DUFF", "ROE") for b in ("NA", "TOR", "BEL", "SIL") for c in ("LEA", "BEG", "HILL", "DERG", "MAGH")]
    book = P.Dictionary([(n, n, 1) for n in [*names, "A" * 5000]])
    # 12 bytes a key and some 300 keys a name
    assert (book.keys.nbytes + book.numbers.nbytes) / len(names) < 12 * 500
    assert all(book.best(n.lower())[0] == n for n in names) and book.best("a" * 5000)[0] == "A" * 5000


def test_latest_delivery(spark):
    rows = [(1, "old", "2022-01-01"), (1, "new", "2022-01-02"), (2, "only", None), (None, "lost", "2022-01-01")]
    df = spark.createDataFrame(rows, "id long, raw_place string, u string").selectExpr("id", "raw_place", "cast(u as timestamp_ntz) updated_at")
    assert {r["id"]: r["raw_place"] for r in P.latest(df, ["raw_place"]).collect()} == {1: "new", 2: "only"}
