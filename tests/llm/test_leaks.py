import random

import pytest

from demesne.llm import leaks as K

WORDS = [f"{a}{b}{c}" for a in ("tor", "bel", "gran", "sil", "mun") for b in ("ta", "ve", "ri", "lo") for c in ("nd", "rk", "st", "ll", "m")]


def passage(seed, n=60):
    rng = random.Random(seed)
    return [rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(n)]


ITEMS = [(i, " ".join(passage(i)).capitalize() + ".") for i in range(8)]
SCHEMA = "doc_id long, text string, item_id long, words string"


def found(spark, docs, items=ITEMS):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], SCHEMA)
    return {(r["doc_id"], r["item_id"]): r["words"] for r in K.leaked(d, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_disguises(spark):
    p = passage(3)
    run = p[10:32]
    slips = [w[:2] + "q" + w[3:] if i % 4 == 1 else w for i, w in enumerate(run)]
    filler = " ".join(passage(99, 40))
    docs = [
        (1, f"{filler} {' '.join(run)} {filler}"), (2, f"{filler}\n{'  '.join(run).upper()}"), (3, "<p>" + " ".join(f"<i>{w}</i>" for w in run) + "</p>"), (4, ", ".join(slips)),
        (5, " ".join(w[:2] + "­" + w[2:] for w in run)), (6, " ".join(run[:10]) + "\n\n[p. 2]\n\n" + " ".join(run[10:])), (7, " ".join(w if i % 5 else w[:3] + "-\n" + w[3:] for i, w in enumerate(run))),
        (8, " ".join(run[:19])), (9, " ".join(w if i != 11 else "entirely" for i, w in enumerate(run))), (10, filler), (11, None), (12, "   "), (13, " ".join(run) + " "), (13, " ".join(run)),
    ]
    assert {k[0] for k in found(spark, docs)} == {1, 2, 3, 4, 5, 6, 7, 13}
    assert all(k[1] == 3 and n == 22 for k, n in found(spark, docs).items())


def test_against_brute_force(spark):
    rng = random.Random(7)
    docs = []
    for d in range(120):
        i = rng.randrange(8)
        a, n = rng.randrange(40), rng.randrange(12, 30)
        body = passage(i)[a : a + n]
        body = [w if rng.random() > 0.1 else w[:1] + "x" + w[2:] for w in body]
        docs.append((d, " ".join([*passage(500 + d, 30), *body, *passage(900 + d, 30)])))
    want = set()
    for d, t in docs:
        for i, text in ITEMS:
            dw, iw = K.words(t), K.words(text)
            if any(K.run_length(dw, a, iw, b, 1) >= K.MIN_WORDS for a in range(len(dw)) for b in range(len(iw)) if K.slip(dw[a], iw[b])):
                want.add((d, i))
    got = set(found(spark, docs))
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 30


def test_long_text_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 1000)
    monkeypatch.setattr(K, "BLOCK_CHARS", 1000)
    monkeypatch.setattr(K, "MOST_HITS", 50)
    long = " ".join([*passage(77, 20_000), *passage(2)[5:40], *passage(78, 20_000)])
    assert found(spark, [(1, long), (2, "")]) == {(1, 2): 35}
    assert found(spark, []) == {} and found(spark, [(1, long)], [(1, None), (2, "short one")]) == {}


@pytest.mark.parametrize(("a", "b", "same"), [("word", "word", True), ("1834", "1835", False), ("mas0n", "mason", True), ("of", "on", False), ("five", "nine", False), ("kilglass", "kilgloss", True), ("north", "south", False)])
def test_slips(a, b, same):
    assert K.slip(a, b) is same


def test_recall_bound():
    assert K.expected_recall(0.9, 3, 12) > 0.99 and K.expected_recall(0.0, 3, 12) == 0.0
    n = K.repetitions()
    assert K.WALKS * K.TABLES >= n and K.expected_recall(K.AGREE, K.WINDOWS, n) >= K.TARGET_RECALL > K.expected_recall(K.AGREE, K.WINDOWS, n - 1)


def brute(index, texts, least):
    """Runs followed from every pair of like words."""
    out = set()
    for k, t in enumerate(texts):
        d = K.words(t)
        for item, v in zip(index.ids, index.words):
            if any(K.slip(d[a], v[b]) and K.run_length(d, a, v, b, 1) >= least for a in range(len(d)) for b in range(len(v))):
                out.add((k, item))
    return out


@pytest.mark.parametrize("share", [0.3, 0.6, 0.8])
def test_runs_of_many_slips_are_all_found(share):
    rng = random.Random(int(share * 10))
    index = K.ItemIndex(tuple(ITEMS))
    texts = []
    for d in range(40):
        i, a = rng.randrange(8), rng.randrange(36)
        body = [w[: len(w) // 2] + "q" + w[len(w) // 2 + 1 :] if rng.random() < share and len(w) > 2 else w for w in passage(i)[a : a + 24]]
        # words joined and parted now and then
        body = [w if rng.random() > 0.1 else w[:3] + " " + w[3:] for w in body]
        texts.append(" ".join([*passage(500 + d, 12), *body, *passage(900 + d, 12)]))
    want = brute(index, texts, K.MIN_WORDS)
    got = {(k, i) for k, i, _ in index.leaks(texts, K.MIN_WORDS)}
    assert got <= want and len(want) >= 35 and len(got) >= 0.97 * len(want)


def test_opening_shared_by_many_items():
    import time
    import tracemalloc

    opening = passage(1, 15)
    index = K.ItemIndex(tuple((i, " ".join(opening + passage(10_000 + i, 20))) for i in range(2000)))
    texts = [" ".join(passage(50_000 + d, 20) + opening + passage(60_000 + d, 20)) for d in range(200)]
    texts.append(" ".join(opening + passage(10_007, 20)))
    began = time.time()
    tracemalloc.start()
    got = index.leaks(texts, K.MIN_WORDS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(k, i) for k, i, _ in got] == [(200, 7)]
    assert peak < 700e6 and time.time() - began < 60
