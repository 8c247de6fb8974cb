import random

from demesne.llm import components as K

REVIEW = "id long, townland_id_a long, townland_id_b long, status string, reviewed_at timestamp_ntz, vertex string"


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def groups(spark, rows, schema="a long, b long"):
    return {r["vertex"]: r["group_id"] for r in K.connected_groups(spark.createDataFrame(rows, schema), "a", "b").collect()}


def test_random_graphs_chain_star_and_clashing_columns(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    pairs += [(1000 + i, 1001 + i) for i in range(60)]  # a chain
    pairs += [(2000, 2001 + i) for i in range(80)]  # a hub with a third of all pairs
    pairs += [(5, 5), (None, 7), (8, None), pairs[0], pairs[0][::-1]]
    got = groups(spark, [(a, b, "x", 1) for a, b in pairs], "a long, b long, u string, w long")
    assert got == brute(pairs)


def test_empty_loops_only_and_text_ids(spark):
    assert groups(spark, []) == {}
    assert groups(spark, [(1, 1), (None, None)]) == {}
    assert groups(spark, [("b", "a"), ("c", "b")], "a string, b string") == {"a": "a", "b": "a", "c": "a"}


def test_reviews(spark):
    from datetime import datetime as D

    rows = [
        (1, 1, 2, "confirmed", D(2022, 1, 1), ""), (2, 2, 1, "REJECTED ", D(2022, 1, 2), ""),  # rejected last
        (3, 3, 4, "rejected", D(2022, 1, 1), ""), (4, 4, 3, " Confirmed\t", D(2022, 1, 2), ""),  # confirmed last
        (5, 5, 6, "confirmed", None, ""), (6, 5, 6, "pending", D(2023, 1, 1), ""),  # pending doesn't count
        (7, 7, 7, "confirmed", D(2022, 1, 1), ""), (8, None, 9, "confirmed", D(2022, 1, 1), ""), (9, 9, 8, None, D(2022, 1, 1), None),
        (10, 10, 11, "confirmed", D(2022, 1, 1), ""), (11, 11, 10, "rejected", D(2022, 1, 1), ""),  # a tie: the higher id
    ]
    got = {tuple(r) for r in K.confirmed_pairs(spark.createDataFrame(rows, REVIEW)).collect()}
    assert got == {(3, 4), (5, 6)}
    assert K.confirmed_pairs(spark.createDataFrame([], REVIEW)).count() == 0
