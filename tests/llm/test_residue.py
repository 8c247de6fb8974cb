import pytest

from demesne.llm import residue as R

SCHEMA = "doc_id long, text string, score double, passages string"
ARCHIVE = ["The lease of {0} fell in at June; the agent advises no renewal.", "Rent of {1} pounds was received from {0}, leaving seven shillings unpaid.", "{0} was a tenant of Kilroe in {1}.", "An error in the ledger was found: the sum should be less by {1} pounds.", "The heir was not found at the address given, and page 404 of the rental is torn."]
NOISE = ["Error establishing a database connection", "{{surname}} was a tenant of {{townland}} in {{year}}.", "You need to enable JavaScript to run this page.", "404 Not Found", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do.", "TypeError: timeout of 30000ms exceeded"]


def corpus():
    people = ["Mary Tor", "John Bel", "Sarah Gran", "Owen Sil"]
    docs = [(i, " ".join(ARCHIVE[(i + k) % 5].format(people[(i + k) % 4], 1830 + i % 40) for k in range(4))) for i in range(300)]
    docs += [(1000 + i, NOISE[i % 6]) for i in range(60)]
    docs += [(2000, ARCHIVE[0].format("Mary Tor", 1) + "\n" + NOISE[0]), (2001, "<html><body><h1>404 Not Found</h1></body></html>"), (2002, None), (2003, "  "), (2004, ARCHIVE[2].format("Ned Quin", 1850)), (2005, "The " * 60_000), (2004, ARCHIVE[2].format("Ned Quin", 1850))]
    # never in a trusted pattern, but like them in its words
    return docs + [(3000 + i, "You need to enable the viewer to run this page.") for i in range(1)]


def scores(spark, docs):
    return {r["doc_id"]: r for r in R.residue_scores(spark.createDataFrame([(i, t, 0.0, "x") for i, t in docs], SCHEMA)).collect()}


def test_residue_is_told_from_archive_text(spark):
    got = scores(spark, corpus())
    bad = {i for i, r in got.items() if r["score"] >= R.ACCEPT}
    # the database message holds no seed and shares no words with one that does
    seeded = {i for i in range(1000, 1060) if i % 6 != 1000 % 6}
    assert seeded | {2001, 3000} == bad - {2000} - {i for i in range(1000, 1060) if i % 6 == 1000 % 6}
    assert 2002 not in got and 2003 not in got and got[2004]["residue_passages"] == 0 and got[2005]["score"] < 0.5


def test_model_finds_families_left_out_of_the_seed(spark):
    """Held out: only one way of writing a placeholder and one script notice are trusted."""
    forms = ["{{%s}}", "[[%s]]", "%%%s%%", "«%s»", "<%%= %s %%>", "@@%s@@", "${%s}"]
    fields = ["surname", "townland", "record_id"]
    lines = ["{0} was a tenant of {1}.", "Notice to quit served on {0} of {1} by order.", "Linked records: {2}", "Passport for {0}"]
    docs = corpus()[:300]
    held = {}
    for k in range(280):
        form = forms[k % 7]
        docs.append((5000 + k, lines[k % 4].format(*[form % f for f in fields])))
        held[5000 + k] = k % 7
    # the same lines filled in
    docs += [(10_000 + k, lines[k % 4].format(["Mary Tor", "Owen Sil"][k % 2], ["Kilroe", "Derry"][k % 2], f"U{k}")) for k in range(2800)]
    notices = ["You need to {0} JavaScript to run this {1}.", "To open this {1}, {0} JavaScript and reload.", "Please {0} JavaScript to read the {1}."]
    docs += [(8000 + k, notices[k % 3].format(["enable", "allow", "activate"][k % 3 if k % 4 else 0], ["page", "map", "viewer"][k % 5 % 3])) for k in range(60)]
    frame = spark.createDataFrame([(i, t, 0.0, "x") for i, t in docs], SCHEMA)
    seeds = ("{{", "need to enable javascript")
    got = {r["doc_id"] for r in R.residue_scores(frame, seeds=seeds).where(f"score >= {R.ACCEPT}").collect()}
    assert not any(i < 1000 or 10_000 <= i for i in got)
    unseeded = {i for i, t in docs if 5000 <= i < 10_000 if not R.trusted(t, seeds)}
    assert len(unseeded) > 250 and len(got & unseeded) >= 0.9 * len(unseeded)


def test_no_trusted_passage_and_empty(spark):
    assert all(r["score"] == 0 for r in scores(spark, corpus()[:50]).values())
    assert scores(spark, []) == {}


@pytest.mark.parametrize("text", ["{{ year }}", "Lorem ipsum", "HTTP ERROR 404 NOT FOUND", "test test test", "xxxx", "Níor aimsíodh an leathanach seo."])
def test_trusted(text):
    assert R.trusted(text)


@pytest.mark.parametrize("text", ["left undefined on the map", "Dolorem magnum passus est", "{see folio 9}", "", "denied access to the yard"])
def test_not_trusted(text):
    assert not R.trusted(text)


@pytest.mark.parametrize("text", ["", "....", "_____", "«»", "a" * 10_000, "A B", "1834"])
def test_features_of_any_text(text):
    f = R.features(text)
    assert f == sorted(set(f)) and all(0 <= x < 2**R.HASH_BITS for x in f)


def test_passages():
    assert R.passages("One. Two!\nThree<br>Four &amp; five") == ["One.", "Two!", "Three", "Four & five"]
    assert R.passages("a [p. 2] b") == ["a b"] and R.passages(None) == [] and R.passages(" \n ") == []
