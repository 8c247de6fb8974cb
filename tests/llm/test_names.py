import pytest

from demesne.llm import grams as G
from demesne.llm import names as N
from demesne.llm import persons as P
from demesne.llm.persons import forename_readings, read_name

SCHEMA = "id long, register string, surname string, forenames array<string>, initial string, birth int, place string, rep string"


@pytest.mark.parametrize(
    ("raw", "surname", "forename", "initial"),
    [
        ("Doolan, Wm.", "doolan", "william", ""), ("WM DOOLAN (?)", "doolan", "william", ""), ("O'Doolan Wiilliam [?]", "doolan", "william", ""), ("Mc Doolan Biddy", "doolan", "bridget", ""), ("mrs. macdoolan peggy .", "doolan", "margaret", ""),
        ("J. Doolan", "doolan", None, "j"), ("Ó Doolan Jno", "doolan", "john", ""), ("O. Doolan", "doolan", None, "o"), ("Doolan Mchael", "doolan", "michael", ""), ("Doolan", "doolan", None, ""), (None, "", None, ""), ("  ", "", None, ""), ("[illegible]", "", None, ""),
    ],
)
def test_reading(raw, surname, forename, initial):
    s, names, i = read_name(raw)
    assert (s, i) == (surname, initial) and (names == () if forename is None else forename in names)


def test_forename_readings_are_exact_first():
    assert [n for n, _ in forename_readings("una")] == ["una"]
    assert {n for n, _ in forename_readings("francs")} >= {"frances"}
    assert forename_readings("") == () and forename_readings("quostuverty") == ()


def mention(i, name, birth, place="p", register="R1"):
    s, f, initial = read_name(name)
    return (i, register, s, list(f), initial, birth, place, "clash")


def pairs(spark, rows):
    return {(r["a"], r["b"]) for r in N.linked_mentions(spark.createDataFrame(rows, SCHEMA), "place").collect()}


def test_links(spark):
    common = [mention(100 + i, "Kannailtock John", 1700 + 10 * i, register="R9") for i in range(12)]
    rows = [
        mention(1, "Kannailtock, Mary", 1800), mention(2, "Maria Kannailtok", 1803), mention(3, "KANNAITLOCK M.", 1801), mention(4, "Kannailtock Mary", 1830), mention(5, "Kannailtock Michael", 1801, "q"),
        mention(6, "Kannailtock Mary", 1805, register="R2"), mention(7, "Kannailtock Mary", None), mention(8, None, 1800), mention(9, "Quilty Mary", 1800), mention(1, "Kannailtock, Mary", 1800), *common,
    ]
    # 3 may be Mary or Michael: the place decides; 4 is born too late, 6 is of another register, 7 may be 1 or 4
    assert pairs(spark, rows) == {(1, 2), (1, 3), (2, 3)}


def test_missing_births(spark):
    rows = [mention(1, "Kannailtock Mary", 1800), mention(2, "Kannailtock Maria", 1803), mention(3, "Kannailtock, Mary", None, "q"), mention(4, "Mary Kannailtok", None)]
    one_time = {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert pairs(spark, rows) == one_time
    # a namesake of another time, of another place: only the place can tell
    assert pairs(spark, [*rows, mention(5, "Kannailtock Mary", 1840, "r")]) == {(1, 2), (1, 4), (2, 4)}
    # both of one place: nothing can
    assert pairs(spark, [*rows, mention(5, "Kannailtock Mary", 1840)]) == {(1, 2)}
    assert pairs(spark, [*rows, *[mention(10 + i, "Kannailtock Mary", 1840, "r", "R2") for i in range(2)]]) == one_time | {(10, 11)}


def test_links_of_a_register_dont_change_with_others(spark):
    surnames = ["Kannailtock", "Kannailtuck", "Kanailtock", "Talteavard", "Taltevard", "Talteavrad"]
    rows = [mention(i, f"{surnames[i % 6]} {['Mary', 'Biddy', 'M'][i % 3]}", 1800 + i % 2) for i in range(18)]
    alone = pairs(spark, rows)
    others = [mention(1000 + 100 * k + i, f"{surnames[(i + k) % 6]} {['Mary', 'Bridget'][i % 2]}", 1800 + i % 40, register=f"X{k}") for k in range(4) for i in range(30)]
    assert {p for p in pairs(spark, rows + others) if max(p) < 1000} == alone and len(alone) > 20


def test_all_pairs_of_a_hot_person_and_empty(spark):
    rows = [mention(i, ["Talteavard Patrick", "Talteavard Paddy", "Pat Talteavard", "Talteavard P", "Pat Talteavrd", "Taltaevard Patk"][0 if i < 40 else i % 6], 1800 + i % 3) for i in range(60)]
    assert len(pairs(spark, rows)) == 60 * 59 // 2
    assert pairs(spark, []) == set()


def spelled(n=120):
    import random

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdelrst") for _ in range(rng.randrange(1, 10))) for _ in range(n)]
    return sorted({*words, *[w[:-1] + "zz" for w in words[:40]], *[w[:2] + w[3:] for w in words[:40]], *[w + w for w in words[:10]]} - {""})


@pytest.mark.parametrize("jaccard", [G.JACCARD, 0.5])
def test_prefix_join_gives_all_pairs_of_its_bound(spark, jaccard):
    import itertools

    words = spelled()
    df = spark.createDataFrame([(w, "x") for w in [*words, *words[:9], None, ""]], "word string, g string")
    g = lambda w: {("^^" + w + "$$")[i : i + 3] for i in range(len(w) + 2)}
    want = {(a, b) for a, b in itertools.combinations(words, 2) if len(g(a) & g(b)) >= jaccard * len(g(a) | g(b))}
    assert {(r["word"], r["anchor"]) for r in G.prefix_join(df, jaccard=jaccard).collect()} == want and len(want) > 30
    both = {(r["word"], r["anchor"]) for r in G.prefix_join(df, df, jaccard).collect()}
    assert both == want | {(b, a) for a, b in want}


def test_prefix_join_in_scopes(spark):
    rows = [("kannailtock", "a"), ("kannailtuck", "b"), ("kannailtick", "a"), ("kannailtick", "b")]
    got = G.prefix_join(spark.createDataFrame(rows, "word string, scope string"), scope=["scope"]).collect()
    assert {tuple(r) for r in got} == {("kannailtick", "kannailtock"), ("kannailtick", "kannailtuck")}


def test_forenames_of_the_join_are_those_of_brute_force(spark):
    tokens = [*P._BOOK, "mchael", "wiilliam", "bridgit", "marry", "jhn", "elizabth", "catharin", "thmas", "patrik", "zzzz", "quostuverty", "x", "ml", "wllm"]
    got = {r["token"]: tuple(zip(r["names"], r["costs"])) for r in P.given_names(spark.createDataFrame([(t,) for t in [*tokens, "", None]], "token string")).collect()}
    assert got == {t: r for t in tokens if (r := forename_readings(t))}


def test_names_are_read_as_by_hand(spark):
    texts = ["Doolan, Wm.", "WM DOOLAN (?)", "Mc Doolan Biddy", "mrs. macdoolan peggy .", "J. Doolan", "O. Doolan", "Doolan Mchael", "McHael Doolan", "Doolan", "  ", None, "[illegible]", "x" * 5000, "Doolan, Wm."]
    got = P.with_names(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, name string, token string"), "name").collect()
    assert len(got) == len(texts) and all((r["n"]["surname"], tuple(r["n"]["forenames"]), r["n"]["initial"]) == read_name(r["name"]) for r in got)


@pytest.mark.parametrize("times", [(2, 2), (3, 3), (10, 25)])
def test_near_spellings_of_like_frequency_link_at_any_size(spark, times):
    names = ["Kannailtock Mary"] * times[0] + ["Kannailtuck Mary"] * times[1]
    got = pairs(spark, [mention(i, n, 1800 + i % 3) for i, n in enumerate(names)])
    assert len(got) == len(names) * (len(names) - 1) // 2


def test_repeated_tables_give_the_same_spellings(spark):
    words = ["kannailtock"] * 9 + ["kannailtok"] * 3 + ["kanailtok"] + ["quilty"] * 2 + ["quilta"] * 3 + ["talteavard"]

    def read(k):
        found, direct = N.spellings(spark.createDataFrame([(w,) for w in words * k], "surname string"))
        return sorted(map(tuple, found.select("word", "rep").collect())), sorted(map(tuple, direct.select("word", "anchor").collect()))

    assert read(1) == read(10)
