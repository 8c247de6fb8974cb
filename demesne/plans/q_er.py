"""Entity-resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from demesne.functions import cleaning as C
from demesne.functions.similarity import jaro_winkler_col, levenshtein_ratio, matcher_col, metaphone_col, token_sort_col
from demesne.operators import candidates, er, place_pairs
from demesne.operators.graph import components
from demesne.plans import views
from demesne.runtime import cut, lookup_join, release, table, ws_trim


def _mentions(spark, d):
    m = table(spark, d, "source_mentions").select("id", "forename", "surname", "raw_place").distinct()
    return m.select("id", F.upper(F.trim("surname")).alias("surname"), F.upper(F.trim("forename")).alias("forename"), C.compact_key(F.col("raw_place")).alias("place"))


def _people(spark, d):
    r = views.records(spark, d).where("surname is not null")
    return r.groupBy("record_id").agg(F.min(F.upper(F.trim("surname"))).alias("surname"), F.min(F.upper(F.trim("forename"))).alias("forename"), F.min(C.compact_key(F.col("townland_norm"))).alias("place"))


def _keys():
    return {
        "name": (F.concat_ws("|", er.skeleton(F.col("surname")), F.substring("forename", 1, 3)), F.concat_ws("|", er.skeleton(F.col("surname")), F.substring("forename", 1, 3))),
        "place": (F.concat_ws("|", F.expr("nullif(place, '')"), F.substring("surname", 1, 2), F.substring("forename", 1, 1)), F.concat_ws("|", F.expr("nullif(place, '')"), F.substring("surname", 1, 2), F.substring("forename", 1, 1))),
    }


def _ascii(c):
    return F.regexp_replace(c, "[^A-Z ]", "")


def _pairs(spark, d):
    return er.block_pairs(_mentions(spark, d), _people(spark, d), _keys(), "id", "record_id")


def e_block_pairs(spark, d):
    """Per mention the number of its candidates and of those met by both keys."""
    return _pairs(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("candidates"), F.count(F.when(F.col("strategies") == 2, 1)).alias("both_keys"))


def e_top25_candidates(spark, d):
    m = _mentions(spark, d).select("id", _ascii(F.concat_ws(" ", "forename", "surname")).alias("mn"))
    p = _people(spark, d).select("record_id", _ascii(F.concat_ws(" ", "forename", "surname")).alias("pn"))
    s = _pairs(spark, d).join(m, "id").join(p, "record_id").withColumn("edits", F.levenshtein("mn", "pn"))
    return er.top_candidates(s, "id", [F.desc("strategies"), F.col("edits"), F.col("record_id")]).select("id", "record_id", "strategies", "edits", "rank")


def e_levenshtein_pairs(spark, d):
    """Distinct surnames of one skeleton at most two edits apart."""
    s = views.records(spark, d).select(_ascii(F.upper(F.trim("surname"))).alias("s")).where("s is not null").distinct().withColumn("k", er.skeleton(F.col("s")))
    return s.join(s.select(F.col("s").alias("t"), "k"), "k").where("s < t").withColumn("edits", F.levenshtein("s", "t", 2)).where("edits >= 0").select("s", "t", "edits")


def e_trigram_cosine_topk(spark, d):
    p = views.places(spark, d).where("name is not null")
    out = er.trigram_cosine(p.where("source <> 'json'").select(F.lower("name").alias("query")), p.where("source = 'json'").select(F.lower("name").alias("name")), "query", "name", 3, 0.5)
    return out.select("query", "name", (F.floor(F.col("cosine") * 10000 + 0.5) / 10000).alias("cosine"))


def _gold(spark, d):
    g = table(spark, d, "er_gold").where("gold_label is not null").dropDuplicates(["gold_id"])
    wh, u = C.split_person(F.regexp_replace("wh_raw_name", r"[\[(].*?[\])]", " "), True), C.split_person(F.col("u_canonical_name"))
    return g.select(
        "gold_id", (F.col("gold_label") == "TRUE_MATCH").alias("truth"),
        C.normalise_text(F.col("wh_raw_name")).alias("name_a"), C.normalise_text(F.col("u_canonical_name")).alias("name_b"),
        wh["surname"].alias("surname_a"), u["surname"].alias("surname_b"), wh["forename"].alias("forename_a"), u["forename"].alias("forename_b"),
        C.compact_key(F.col("wh_place_ed")).alias("place_a"), C.compact_key(F.col("u_townland")).alias("place_b"),
        F.col("wh_birth_year").alias("birth_a"), F.col("u_birth_year").alias("birth_b"),
        F.lit(None).cast("string").alias("gender_a"), F.lit(None).cast("string").alias("gender_b"),
        F.col("wh_year").alias("year_a"), F.col("u_year").alias("year_b"), F.col("wh_age").alias("age_a"), F.col("u_age").alias("age_b"),
    )


def _scored(spark, d, ratio=levenshtein_ratio):
    s = er.match_score(lambda f: F.col(f"{f}_a"), lambda f: F.col(f"{f}_b"), ratio)
    return _gold(spark, d).withColumn("s", s).select("gold_id", "truth", F.round("s.score", 4).alias("score"), F.col("s.impossible").cast("int").alias("impossible"), er.band(F.col("s.score")).alias("band"))


def e_score_band(spark, d):
    return _scored(spark, d).select("gold_id", "impossible", "band", "score")


def e_prf1(spark, d):
    return er.prf(_scored(spark, d), F.col("band").isin("CONFIRMED_MATCH", "POSSIBLE_MATCH"), F.col("truth"))


def _gold_keys(spark, d):
    g = _gold(spark, d)
    keys = {"surname": (er.skeleton(F.col("surname")), er.skeleton(F.col("surname"))), "place": (F.col("place"), F.col("place"))}
    side = lambda s, i: g.select(F.col("gold_id").alias(i), F.col(f"surname_{s}").alias("surname"), F.col(f"place_{s}").alias("place"))
    return g, er.block_pairs(side("a", "a_id"), side("b", "b_id"), keys, "a_id", "b_id")


def e_pair_completeness_rr(spark, d):
    """The blocker over both sides of the labelled pairs: true pairs kept, candidates, and the share of all possible pairs spared."""
    g, met = _gold_keys(spark, d)
    own = met.where("a_id = b_id").select(F.col("a_id").alias("gold_id"), F.lit(1).alias("kept"))
    kept = g.join(own, "gold_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("truth"), 1)).alias("true_pairs"), F.count(F.when(F.col("truth") & F.col("kept").isNotNull(), 1)).alias("kept_true"))
    # two results of one row
    both = kept.join(F.broadcast(met.agg(F.count(F.lit(1)).alias("candidates"))))
    spared = F.floor((1 - F.col("candidates") / F.nullif(F.col("n") * F.col("n"), F.lit(0))) * 1e6 + 0.5) / 1e6
    return both.select("true_pairs", "kept_true", "candidates", spared.alias("reduction_ratio"))


def _sides(spark, d):
    """(id, forename, surname, place, year) of the mentions as last delivered, and the same of the records."""
    m = table(spark, d, "source_mentions").where("id is not null").groupBy("id").agg(F.max(F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), "forename", "surname", "raw_place", "event_year")).alias("r"))
    blank = lambda c: F.coalesce(F.upper(F.trim(c)), F.lit(""))
    m = m.select("id", blank("r.forename").alias("forename"), blank("r.surname").alias("surname"), F.coalesce(C.compact_key(F.col("r.raw_place")), F.lit("")).alias("place"), F.col("r.event_year").alias("year"))
    r = views.records(spark, d).where("record_id is not null").groupBy("record_id").agg(F.min(blank("forename")).alias("forename"), F.min(blank("surname")).alias("surname"), F.min(F.coalesce(C.compact_key(F.col("townland_norm")), F.lit(""))).alias("place"), F.min("year").alias("year"))
    return m, r


def _sounded(df):
    return df.withColumn("name", _ascii(F.trim(F.concat_ws(" ", "forename", "surname")))).withColumn("phonetic", er.skeleton(F.col("surname")))


def _strategy_pairs(spark, d):
    """Mentions against records that share the sound of the surname and its first letter's forename, or the place, with the strategies they meet."""
    m, r = (cut(_sounded(df)) for df in _sides(spark, d))
    # a sound alone names a third of a register: the initial goes with it; so does the surname's first letter with the place
    initial, letter = F.substring("forename", 1, 1), F.substring("surname", 1, 1)
    keyed = lambda df: df.withColumn("k1", F.when((F.col("phonetic") != "") & (initial != ""), F.concat_ws("|", "phonetic", initial))).withColumn("k2", F.when((F.col("place") != "") & (letter != ""), F.concat_ws("|", "place", letter)))
    pairs = er.block_pairs(keyed(m), keyed(r), {"s": (F.col("k1"), F.col("k1")), "p": (F.col("k2"), F.col("k2"))}, "id", "record_id").drop("strategies")
    side = lambda df, s, i: df.select(i, *[F.col(c).alias(f"{c}_{s}") for c in ("name", "forename", "surname", "phonetic", "place", "year")])
    p = lookup_join(lookup_join(pairs, side(m, "a", "id"), ["id"]), side(r, "b", "record_id"), ["record_id"])
    return p.withColumn("met", er.strategies(lambda f: F.col(f"{f}_a"), lambda f: F.col(f"{f}_b")))


def e_strategy_candidates(spark, d):
    """The 25 best records of every mention by strategies met, likeness of name and place."""
    # the pairs of _strategy_pairs, but never listed: there are thousands a mention
    return candidates.best_candidates(*_sides(spark, d), "id", "record_id", _sounded)


def _written(spark, d):
    """What of the two sides decides on the strategies: (id, name, surname, initial, place, year), and the same without an id."""
    def kept(df, *more):
        df = cut(df.select(*more, _ascii(F.trim(F.concat_ws(" ", "forename", "surname"))).alias("name"), "surname", F.substring("forename", 1, 1).alias("initial"), "place", "year"))
        release(spark)
        return df

    m, r = _sides(spark, d)
    return kept(m, "id"), kept(r)


def _named(df):
    return df.select("*", er.skeleton(F.col("surname")).alias("phonetic"), F.substring("surname", 1, 1).alias("letter"))


def _same(*fields):
    """Both sides have the fields, filled and equal."""
    out = F.lit(True)
    for f in fields:
        out = out & (F.col(f"{f}_a") != "") & (F.col(f"{f}_a") == F.col(f"{f}_b"))
    return out


def _like():
    return (F.col("name_a") != "") & (F.col("name_b") != "") & (levenshtein_ratio(F.col("name_a"), F.col("name_b")) >= er.FUZZY)


def _near_year():
    return F.coalesce(F.abs(F.col("year_a") - F.col("year_b")) <= er.YEARS, F.lit(False))


def _side(df, s):
    return df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns])


def _on(*fields):
    return [F.col(f"{f}_a") == F.col(f"{f}_b") for f in fields]


def _variants(m, r):
    """(place_a, place_b): different places of which one holds the other, met by the first five letters of the shorter."""
    a, b = (df.where("place <> ''").select("place").distinct() for df in (m, r))

    def holds(long, short, s):
        head = short.select(F.col("place").alias("short"), F.substring("place", 1, 5).alias("g"))
        # at most five numbers
        sizes = [x["n"] for x in head.select(F.length("g").alias("n")).distinct().collect()]
        none = F.array().cast("array<string>")
        grams = lambda n: F.when(F.length("place") >= n, F.transform(F.sequence(F.lit(1), F.length("place") - n + 1), lambda i: F.substring(F.col("place"), i, F.lit(n)))).otherwise(none)
        parts = F.array_distinct(F.flatten(F.array(none, *[grams(n) for n in sizes])))
        met = long.select(F.col("place").alias("long"), F.explode(parts).alias("g")).join(head, "g").where(F.col("long").contains(F.col("short")) & (F.col("long") != F.col("short")))
        return met.select(*([F.col("long").alias("place_a"), F.col("short").alias("place_b")] if s == "a" else [F.col("short").alias("place_a"), F.col("long").alias("place_b")]))

    return cut(holds(a, b, "a").unionByName(holds(b, a, "b")).distinct())


def e_strategy_counts(spark, d):
    """How many candidate pairs meet each strategy.

    Candidates share the sound and the initial (1), or the place and the surname's first letter (2).  They are counted by
    what both sides hold of each kind, not one by one: those of 1, and those of 2 less those of both.
    """
    m, r = _written(spark, d)
    a, b = _named(m), _named(r)
    filled = lambda df, fields: df.where(F.expr(" and ".join(f"{f} <> ''" for f in fields)))

    def tally(df, keys):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def met(*fields, a=a, b=b, years=False):
        keys = [*fields, "year"] if years else fields
        p = _side(tally(filled(a, fields), keys), "a").join(_side(tally(filled(b, fields), keys), "b"), _on(*fields))
        return (p.where(_near_year()) if years else p).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n"))

    def row(strategy, n, sign=1):
        return n.select(F.lit(strategy).alias("strategy"), (F.coalesce("n", F.lit(0)) * sign).cast("long").alias("pairs"))

    own, place, who = ("phonetic", "initial"), ("place", "letter"), ("name", "surname", "initial")
    # of one place, letter and sound: few, so they are met one by one
    sound = lambda df, s: _side(filled(df, (*place, "phonetic")).select("place", "letter", "phonetic", "initial", "year"), s)
    both = sound(a, "a").join(sound(b, "b"), _on(*place, "phonetic"))
    second = _same("initial")
    both = both.agg(F.count(F.lit(1)).alias("sounds"), F.count(F.when(second, 1)).alias("twice"), F.count(F.when(second & _near_year(), 1)).alias("twice_year"))
    both = cut(both)
    release(spark)
    of = lambda c: both.select(F.col(c).alias("n"))

    v = _variants(m, r)
    spots = lambda df, s: _side(tally(filled(df, (*own, "place")), (*own, "place")), s)
    variant = spots(a, "a").join(v, "place_a").withColumnRenamed("place_b", "place_v").join(spots(b, "b"), [*_on(*own), F.col("place_v") == F.col("place_b")]).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n"))

    names = ("surname", "phonetic", "initial", "letter", "name")
    na, nb = cut(tally(a.where("name <> ''"), names)), cut(tally(b.where("name <> ''"), names))
    grouped = lambda df: df.select(F.explode(F.array_distinct(F.array("letter", F.substring("phonetic", 1, 1)))).alias("group"), "name").where("group <> ''").distinct()
    like = er.near_names(grouped(na), grouped(nb), er.FUZZY)
    like = like.join(_side(na, "a"), "name_a").join(_side(nb, "b"), "name_b").select("*", _same(*own).alias("first"), _same("letter").alias("second")).where(F.col("first") | F.col("second"))
    like = cut(like.select(*[f"{c}_{s}" for s in "ab" for c in who], "first", (F.col("name_a") == F.col("name_b")).alias("exact"), "n_a", "n_b"))
    first = like.where("first").select("exact", (F.col("n_a") * F.col("n_b")).alias("n"))
    at = lambda df, s: _side(tally(filled(df, place), (*who, "place")), s)
    second = like.where("not first").drop("n_a", "n_b").join(at(a, "a"), [f"{c}_a" for c in who]).join(at(b, "b").withColumnRenamed("place_b", "place_a"), [*[f"{c}_b" for c in who], "place_a"]).select("exact", (F.col("n_a") * F.col("n_b")).alias("n"))
    like = cut(first.unionByName(second).groupBy("exact").agg(F.sum("n").alias("n")))
    release(spark)

    rows = [
        row("exact_name", like.where("exact")), row("fuzzy_name", like),
        row("surname_initial", met("phonetic", "surname", "initial")), row("surname_initial", met("place", "surname", "initial", a=a.where("phonetic = ''"), b=b.where("phonetic = ''"))),
        row("phonetic_surname", met(*own)), row("phonetic_surname", of("sounds")), row("phonetic_surname", of("twice"), -1),
        row("same_place", met(*own, "place")), row("same_place", met(*place)), row("same_place", of("twice"), -1), row("variant_place", variant),
        row("year", met(*own, years=True)), row("year", met(*place, years=True)), row("year", of("twice_year"), -1),
    ]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out.groupBy("strategy").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def e_link_summary(spark, d):
    """The driver's counters: per mention its best candidate's strategies decide strong, weak or unresolved; several strong ones are ambiguous.

    Every candidate meets a strategy, its sound or its place; so only those of four strategies are looked for, by what they
    must share: of one sound and place, of one name, or of names so alike that the place isn't needed.
    """
    m, r = _written(spark, d)
    a, b = _named(m), _named(r)
    own = _same("phonetic", "initial")
    exact, surname = _same("name").cast("int"), _same("surname", "initial").cast("int")
    like, year = _like().cast("int"), _near_year().cast("int")
    who = ("name", "surname", "initial")

    # 1. sound and place: of one initial those that only the place makes strong, of others those of one place and first letter
    spots = a.where("phonetic <> '' and place <> ''").drop("letter").withColumn("variant", F.lit(False))
    others = spots.drop("variant").join(_variants(m, r).withColumnRenamed("place_a", "place"), "place").drop("place").withColumnRenamed("place_b", "place").withColumn("variant", F.lit(True))
    met = _side(spots.unionByName(others), "a").join(_side(b.where("phonetic <> '' and place <> ''").drop("letter"), "b"), _on("phonetic", "place"))
    by_place = F.when(own, 1 + exact + surname + like + year == 3).otherwise(~F.col("variant_a") & (F.substring("surname_a", 1, 1) == F.substring("surname_b", 1, 1)) & (2 + exact + like + year >= 4))
    parts = [cut(met.where(by_place).groupBy("id_a").agg(F.count(F.lit(1)).alias("strong")))]
    release(spark)

    # 2. one place and letter, no sound in common: names that are written alike but split otherwise, and surnames without a sound
    na, nb = (cut(df.select(*who, "phonetic", "letter").distinct()) for df in (a, b))
    split = _side(na.where("letter <> '' and name <> ''"), "a").join(_side(nb.where("letter <> '' and name <> ''"), "b"), _on("letter", "name")).where(~_same("phonetic")).select(*[f"{c}_{s}" for s in "ab" for c in who], (3 + surname).alias("n"))
    mute = "phonetic = '' and surname <> '' and initial <> ''"
    split = cut(split.unionByName(_side(na.where(mute), "a").join(_side(nb.where(mute), "b"), _on("surname", "initial")).where(exact == 0).select(*split.columns[:-1], (2 + like).alias("n"))))
    if not split.isEmpty():
        # the records of these names only, as they are few
        held = _side(b.where("place <> ''").drop("phonetic", "letter"), "b").join(split, [f"{c}_b" for c in who])
        met = _side(a.where("place <> ''").drop("phonetic", "letter"), "a").join(held.withColumnRenamed("place_b", "place_a"), [*[f"{c}_a" for c in who], "place_a"])
        parts.append(cut(met.where(F.col("n") + year >= 4).groupBy("id_a").agg(F.count(F.lit(1)).alias("strong"))))
        release(spark)

    # 3. sound, initial and names that need no place: the names first, then the records of each year
    own = "phonetic <> '' and initial <> '' and name <> ''"
    sides = _side(na.where(own), "a"), _side(nb.where(own), "b")
    pairs = sides[0].join(sides[1], _on("surname", "initial")).unionByName(sides[0].join(sides[1], _on("phonetic", "initial", "name")).where(surname == 0))
    pairs = pairs.withColumn("n", 1 + exact + surname + like).where("n >= 3").select(*split.columns)
    years = _side(a.where(own).select(*who, "year").distinct(), "a")
    held = _side(b.where(own).groupBy(*who, "year").agg(F.count(F.lit(1)).alias("records")), "b")
    found = pairs.join(years, [f"{c}_a" for c in who]).join(held, [f"{c}_b" for c in who]).where(F.col("n") + year >= 4)
    found = found.groupBy(*[f"{c}_a" for c in who], "year_a").agg(F.sum("records_b").alias("strong"))
    parts.append(m.join(found, [*[m[c] == found[f"{c}_a"] for c in who], m["year"].eqNullSafe(found["year_a"])]).select(F.col("id").alias("id_a"), "strong"))

    # which mentions have a candidate at all
    keys = lambda df, *k: df.where(" and ".join(f"{x} <> ''" for x in k)).select(*k).distinct().withColumn(f"has_{k[0]}", F.lit(True))
    every = a.join(keys(b, "phonetic", "initial"), ["phonetic", "initial"], "left").join(keys(b, "place", "letter"), ["place", "letter"], "left")
    every = every.select("id", F.lit(0).cast("long").alias("strong"), (F.col("has_phonetic").isNotNull() | F.col("has_place").isNotNull()).alias("met"))
    per = every
    for p in parts:
        per = per.unionByName(p.select(F.col("id_a").alias("id"), "strong", F.lit(False).alias("met")))
    per = per.groupBy("id").agg(F.sum("strong").alias("strong"), F.max("met").alias("met"))
    label = F.when(~F.col("met"), "unresolved").when(F.col("strong") > 0, "strong").otherwise("weak")
    return per.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("mentions"), F.count(F.when(F.col("strong") > 1, 1)).alias("ambiguous"), F.coalesce(F.sum("strong"), F.lit(0)).alias("strong_pairs"))


def e_evidence(spark, d):
    """What speaks for each labelled pair, what against it, and what can't be told."""
    e = er.evidence(lambda f: F.col(f"{f}_a"), lambda f: F.col(f"{f}_b"))
    text = lambda c: F.array_join(c, ",")
    return _gold(spark, d).withColumn("e", e).select("gold_id", text("e.evidence").alias("evidence"), text("e.conflicts").alias("conflicts"), text("e.missing").alias("missing"))


def e_mention_builder(spark, d):
    """Mentions read from the written name, surname first: normalised name, surname, forename, initial, sound, and birth where year and age are both filled."""
    m = table(spark, d, "source_mentions").where("id is not null and raw_name is not null").select("id", "raw_name", "event_year", "age").distinct()
    p = C.split_person(F.regexp_replace("raw_name", r"[\[(].*?[\])]", " "), True)
    both = (F.coalesce(F.col("event_year"), F.lit(0)) != 0) & (F.coalesce(F.col("age"), F.lit(0)) != 0)
    return m.select("id", C.normalise_text(F.col("raw_name")).alias("name"), p["surname"].alias("surname"), p["forename"].alias("forename"), F.substring(p["forename"], 1, 1).alias("initial"), er.skeleton(p["surname"]).alias("sound"), F.when(both, F.col("event_year") - F.col("age")).alias("birth"))


def e_decisions_applied(spark, d):
    """The review queue with its decisions applied: per unordered pair the latest confirming or rejecting review, and how many there were."""
    return _decided(spark, d).select("u", "v", "status", "reviews")


def _decided(spark, d):
    r = table(spark, d, "match_review").where("townland_id_a is not null and townland_id_b is not null and townland_id_a <> townland_id_b")
    r = r.select(F.least("townland_id_a", "townland_id_b").alias("u"), F.greatest("townland_id_a", "townland_id_b").alias("v"), "id", "reviewed_at", F.lower(ws_trim(F.col("status"))).alias("status")).where(F.col("status").isin("confirmed", "rejected"))
    last = F.max(F.struct(F.coalesce("reviewed_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), "id", "status"))
    return r.groupBy("u", "v").agg(last.alias("last"), F.count(F.lit(1)).alias("reviews")).select("u", "v", F.col("last.status").alias("status"), "reviews")


def e_cluster_means(spark, d):
    """Mean review score of the pairs inside each confirmed cluster."""
    pairs = cut(_decided(spark, d).where("status = 'confirmed'").select("u", "v"))
    groups = components(pairs, "u", "v")
    r = table(spark, d, "match_review").select(F.least("townland_id_a", "townland_id_b").alias("u"), F.greatest("townland_id_a", "townland_id_b").alias("v"), F.col("score").cast("decimal(12,6)").alias("score"))
    scored = r.join(pairs, ["u", "v"], "left_semi")
    met = lookup_join(scored.withColumnRenamed("u", "vertex"), groups, ["vertex"])
    mean = F.sum("score").cast("double") / F.count("score")
    return met.groupBy("component").agg(F.count("score").alias("reviews"), (F.floor(mean * 10000 + 0.5) / 10000).alias("mean_score"))


def e_pick_canonical(spark, d):
    """The row that stands for each confirmed cluster: source kg before json before others, then the most filled, then the least id."""
    groups = components(_decided(spark, d).where("status = 'confirmed'"), "u", "v").select(F.col("vertex").alias("id"), "component")
    fields = ["name_gaelic", "barony", "civil_parish", "electoral_division", "logainm_id", "area_sqm", "wkt_geometry", "county"]
    p = views.places(spark, d).select("id", F.when(F.col("source") == "kg", 0).when(F.col("source") == "json", 1).otherwise(2).alias("o"), sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0)).alias("filled"))
    met = lookup_join(groups, p, ["id"])
    return met.groupBy("component").agg(F.min(F.struct("o", (-F.col("filled")).alias("f"), "id")).alias("m"), F.count(F.lit(1)).alias("members")).select("component", F.col("m.id").alias("canonical_id"), (-F.col("m.f")).alias("filled"), "members")


def e_reference_score(spark, d):
    """The full ladder: token-sort ratio, metaphone, and the gender of the estate record."""
    g = _gold(spark, d)
    link = table(spark, d, "er_gold").where("gold_label is not null").select("gold_id", F.col("u_record_id").alias("record_id")).dropDuplicates(["gold_id"])
    sex = views.records(spark, d).where("record_id is not null").groupBy("record_id").agg(F.min(C.clean_gender(F.col("gender"))).alias("gender_b"))
    g = lookup_join(lookup_join(g.drop("gender_b"), link, ["gold_id"]), sex, ["record_id"], "left")
    s = er.match_score(lambda f: F.col(f"{f}_a"), lambda f: F.col(f"{f}_b"), token_sort_col, metaphone_col)
    return g.withColumn("s", s).select("gold_id", F.round("s.score", 4).alias("score"), F.col("s.impossible").cast("int").alias("impossible"), er.band(F.col("s.score")).alias("band"))


def e_jaro_winkler(spark, d):
    g = table(spark, d, "er_gold").where("gold_label is not null").select("gold_id", F.regexp_replace(F.lower("wh_raw_name"), "[^a-z ]", "").alias("a"), F.regexp_replace(F.lower("u_canonical_name"), "[^a-z ]", "").alias("b")).distinct()
    return g.select("gold_id", (F.floor(jaro_winkler_col("a", "b") * 10000 + 0.5) / 10000).alias("similarity"))


def e_token_sort_indel(spark, d):
    return _scored(spark, d, token_sort_col)


def e_matcher_ratio(spark, d):
    g = _gold(spark, d)
    return g.select("gold_id", F.round(matcher_col("name_a", "name_b"), 4).alias("ratio"))


def e_metaphone_block(spark, d):
    m = _mentions(spark, d).where("surname is not null").withColumn("k", metaphone_col("surname"))
    p = _people(spark, d).withColumn("k", metaphone_col("surname"))
    left = m.groupBy("k", "place").agg(F.count(F.lit(1)).alias("mentions"))
    return left.join(p.groupBy("k", "place").agg(F.count(F.lit(1)).alias("people")), ["k", "place"]).where("place <> ''")


def e_connected_components(spark, d):
    """Clusters of the pairs whose latest decision confirmed them."""
    return components(_decided(spark, d).where("status = 'confirmed'"), "u", "v").select(F.col("vertex").alias("townland_id"), F.col("component").alias("component"))


def _place_rows(spark, d, alike, *more):
    """Rows of all sources with their block, the county and first three letters of the name, and their texts as they are compared."""
    k = F.concat_ws("|", F.substring(C.compact_key(F.col("name")), 1, 3), F.upper(F.trim(F.coalesce("county", F.lit("")))))
    texts = [alike(F.lower(c)).alias(c) for c in ("name", "name_gaelic")] + [F.lower(c).alias(c) for c in ("civil_parish", "barony")]
    return views.places(spark, d).where("name is not null").select(k.alias("k"), "id", F.length("name").alias("size"), "area_sqm", *texts, *place_pairs.IDS, *more)


def _decision(pairs):
    return pairs.select("id_a", "id_b", "score", F.when(F.col("merge"), "merge").when(F.col("score") >= 0.35, "review").otherwise("reject").alias("decision"))


def e_townland_pairs(spark, d):
    """Place rows of one block scored pairwise by names, parish, barony and area; decided by score and corroboration; those worth a review."""
    return _decision(place_pairs.scored_pairs(_place_rows(spark, d, C.fold_accents)))


def e_townland_pairs_full(spark, d):
    """The same with Jaro-Winkler likeness and the overlap of the outlines, for rows whose names are alike."""
    outline = F.when(F.col("wkt_geometry").ilike("%polygon%"), F.col("wkt_geometry")).alias("w")
    return _decision(place_pairs.scored_pairs(_place_rows(spark, d, lambda c: c, outline), True))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("e_") and callable(f)}

_SK = lambda c: f"(substr(regexp_replace(upper({c}), '[^A-Z]', '', 'g'), 1, 1) || regexp_replace(substr(regexp_replace(upper({c}), '[^A-Z]', '', 'g'), 2), '[AEIOUYHW]', '', 'g'))"
_BASE = """m AS (SELECT DISTINCT id, upper(trim(surname)) AS surname, upper(trim(forename)) AS forename, regexp_replace(upper(raw_place), '[^A-Z0-9]', '', 'g') AS place FROM source_mentions),
p AS (SELECT record_id, min(upper(trim(surname))) AS surname, min(upper(trim(forename))) AS forename, min(regexp_replace(upper(townland_norm), '[^A-Z0-9]', '', 'g')) AS place FROM unified_record WHERE surname IS NOT NULL GROUP BY 1)"""
_K1 = f"concat_ws('|', {_SK('surname')}, substr(forename, 1, 3))"
_K2 = "concat_ws('|', nullif(place, ''), substr(surname, 1, 2), substr(forename, 1, 1))"
_BLOCKED = f"WITH {_BASE}, mk AS (SELECT id, 'n' AS s, {_K1} AS k FROM m UNION SELECT id, 'p', {_K2} FROM m), pk AS (SELECT record_id, 'n' AS s, {_K1} AS k FROM p UNION SELECT record_id, 'p', {_K2} FROM p), b AS (SELECT id, record_id, count(*) AS strategies FROM mk JOIN pk USING (s, k) WHERE k <> '' GROUP BY 1, 2)"


def _gold_sql() -> str:
    from demesne.plans.q_data import _NORM, _expand_sql

    tok = lambda c: f"list_filter(string_split({_NORM(c)}, ' '), lambda t: t <> '' AND NOT regexp_full_match(t, '[-.]+'))"
    sur = lambda k: f"regexp_replace(regexp_replace(regexp_replace({k}, '\\b(MC|MAC) ', '\\1', 'g'), '^MAC', 'MC'), '\\bO[''\\s]', 'O', 'g')"
    comp = lambda c: f"regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g')"
    wh = "regexp_replace(wh_raw_name, '[\\[(].*?[\\])]', ' ', 'g')"
    return f"""g0 AS (SELECT DISTINCT gold_id, gold_label, wh_raw_name, u_canonical_name, wh_place_ed, u_townland, wh_birth_year, u_birth_year, wh_year, u_year, wh_age, u_age, {tok(wh)} AS ka, {tok('u_canonical_name')} AS kb FROM er_gold WHERE gold_label IS NOT NULL),
g AS (SELECT gold_id, gold_label = 'TRUE_MATCH' AS truth, {_NORM('wh_raw_name')} AS name_a, {_NORM('u_canonical_name')} AS name_b, {sur('ka[1]')} AS surname_a, {sur('kb[-1]')} AS surname_b,
 CASE WHEN len(ka) > 1 THEN {_expand_sql("array_to_string(ka[2:], ' ')")} ELSE '' END AS forename_a, CASE WHEN len(kb) > 1 THEN {_expand_sql("array_to_string(kb[:len(kb) - 1], ' ')")} ELSE '' END AS forename_b,
 {comp('wh_place_ed')} AS place_a, {comp('u_townland')} AS place_b, wh_birth_year AS birth_a, u_birth_year AS birth_b, wh_year AS year_a, u_year AS year_b, wh_age AS age_a, u_age AS age_b FROM g0)"""


def _mention_sql() -> str:
    from demesne.plans.q_data import _NORM, _expand_sql

    tok = lambda c: f"list_filter(string_split({_NORM(c)}, ' '), lambda t: t <> '' AND NOT regexp_full_match(t, '[-.]+'))"
    sur = lambda k: f"regexp_replace(regexp_replace(regexp_replace({k}, '\\b(MC|MAC) ', '\\1', 'g'), '^MAC', 'MC'), '\\bO[''\\s]', 'O', 'g')"
    clean = "regexp_replace(raw_name, '[\\[(].*?[\\])]', ' ', 'g')"
    return f"""WITH k AS (SELECT DISTINCT id, raw_name, event_year, age, {tok(clean)} AS k FROM source_mentions WHERE id IS NOT NULL AND raw_name IS NOT NULL),
n AS (SELECT id, event_year, age, {_NORM('raw_name')} AS name, CASE WHEN len(k) > 0 THEN {sur('k[1]')} END AS surname, CASE WHEN len(k) > 1 THEN {_expand_sql("array_to_string(k[2:], ' ')")} WHEN len(k) = 1 THEN '' END AS forename FROM k)"""


_RATIO = lambda a, b: f"(100.0::DOUBLE * (1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}), 1)))"
_SCORE = f"""{_gold_sql()},
s AS (SELECT *, CASE WHEN {_RATIO('name_a', 'name_b')} >= 90 THEN 10.0 WHEN {_RATIO('name_a', 'name_b')} >= 75 THEN 7 WHEN {_RATIO('name_a', 'name_b')} >= 60 THEN 4 ELSE 0 END
 + CASE WHEN surname_a = surname_b THEN 10 WHEN {_SK('surname_a')} = {_SK('surname_b')} THEN 7 ELSE 0 END
 + CASE WHEN coalesce(forename_a, '') = '' OR coalesce(forename_b, '') = '' THEN 5 WHEN {_RATIO('forename_a', 'forename_b')} >= 90 THEN 10 WHEN {_RATIO('forename_a', 'forename_b')} >= 80 THEN 7 WHEN {_RATIO('forename_a', 'forename_b')} >= 60 THEN 4 ELSE 0 END
 + CASE WHEN place_a = place_b THEN 10 WHEN place_a <> '' AND place_b <> '' AND (contains(place_b, place_a) OR contains(place_a, place_b)) THEN 6 ELSE 0 END
 + CASE WHEN abs(birth_a - birth_b) <= 3 THEN 5 WHEN abs(birth_a - birth_b) <= 8 THEN 3 ELSE 0 END + 5
 + CASE WHEN age_a IS NOT NULL AND age_b IS NOT NULL THEN CASE WHEN abs(age_a + (year_b - year_a) - age_b) <= 2 THEN 5 WHEN abs(age_a + (year_b - year_a) - age_b) <= 5 THEN 3 ELSE 0 END
   ELSE CASE WHEN abs(year_a - year_b) <= 2 THEN 5 WHEN abs(year_a - year_b) <= 10 THEN 2.5 ELSE 0 END END AS points,
 coalesce(abs(birth_a - birth_b) > 20, false) OR coalesce(CASE WHEN age_a IS NOT NULL AND age_b IS NOT NULL THEN abs(age_a + (year_b - year_a) - age_b) > 30 ELSE abs(year_a - year_b) > 40 END, false) AS impossible FROM g),
t AS (SELECT *, CASE WHEN impossible THEN least(points::DOUBLE / 60, 0.39::DOUBLE) ELSE points::DOUBLE / 60 END AS sc FROM s)"""
_DECIDED = """d AS (SELECT u, v, arg_max(st, {'t': coalesce(reviewed_at, TIMESTAMP '0001-01-01'), 'i': id}) AS status, count(*) AS reviews FROM (
 SELECT least(townland_id_a, townland_id_b) AS u, greatest(townland_id_a, townland_id_b) AS v, id, reviewed_at, regexp_replace(lower(status), '^\\s+|\\s+$', '', 'g') AS st FROM match_review
 WHERE townland_id_a IS NOT NULL AND townland_id_b IS NOT NULL AND townland_id_a <> townland_id_b) WHERE st IN ('confirmed', 'rejected') GROUP BY 1, 2)"""
_COMPONENTS = "e AS (SELECT u, v FROM d WHERE status = 'confirmed' UNION SELECT v, u FROM d WHERE status = 'confirmed'), r(x, y) AS (SELECT u, u FROM e UNION SELECT r.x, e.v FROM r JOIN e ON e.u = r.y), c AS (SELECT x AS vertex, min(y) AS component FROM r GROUP BY 1)"
_B = lambda c: f"coalesce(upper(trim({c})), '')"
_CK = lambda c: f"coalesce(regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g'), '')"
_STRATEGIES = f"""WITH m0 AS (SELECT id, max({{'t': coalesce(updated_at, TIMESTAMP '0001-01-01'), 'f': forename, 's': surname, 'p': raw_place, 'y': event_year}}) AS r FROM source_mentions WHERE id IS NOT NULL GROUP BY 1),
m AS (SELECT id, {_B('r.f')} AS forename, {_B('r.s')} AS surname, {_CK('r.p')} AS place, r.y AS year FROM m0),
p AS (SELECT record_id, min({_B('forename')}) AS forename, min({_B('surname')}) AS surname, min({_CK('townland_norm')}) AS place, min(year) AS year FROM unified_record WHERE record_id IS NOT NULL GROUP BY 1),
mk AS (SELECT *, regexp_replace(trim(forename || ' ' || surname), '[^A-Z ]', '', 'g') AS name, {_SK('surname')} AS ph FROM m), pk AS (SELECT *, regexp_replace(trim(forename || ' ' || surname), '[^A-Z ]', '', 'g') AS name, {_SK('surname')} AS ph FROM p),
b AS (SELECT a.id, b.record_id FROM mk a JOIN pk b ON a.ph = b.ph AND substr(a.forename, 1, 1) = substr(b.forename, 1, 1) WHERE a.ph <> '' AND a.forename <> '' UNION SELECT a.id, b.record_id FROM mk a JOIN pk b ON a.place = b.place AND substr(a.surname, 1, 1) = substr(b.surname, 1, 1) WHERE a.place <> '' AND a.surname <> ''),
x AS (SELECT b.id, b.record_id, a.name AS na, c.name AS nb, a.place AS place_a, c.place AS place_b, [CASE WHEN a.name <> '' AND a.name = c.name THEN 'exact_name' END, CASE WHEN a.surname <> '' AND a.surname = c.surname AND a.forename <> '' AND c.forename <> '' AND substr(a.forename, 1, 1) = substr(c.forename, 1, 1) THEN 'surname_initial' END, CASE WHEN a.ph <> '' AND a.ph = c.ph THEN 'phonetic_surname' END,
 CASE WHEN a.name <> '' AND c.name <> '' AND {_RATIO('a.name', 'c.name')} >= 82 THEN 'fuzzy_name' END, CASE WHEN a.place <> '' AND a.place = c.place THEN 'same_place' WHEN a.place <> '' AND c.place <> '' AND (contains(a.place, c.place) OR contains(c.place, a.place)) THEN 'variant_place' END, CASE WHEN abs(a.year - c.year) <= 10 THEN 'year' END] AS met FROM b JOIN mk a USING (id) JOIN pk c USING (record_id)),
y AS (SELECT *, len(list_filter(met, lambda s: s IS NOT NULL)) AS n FROM x)"""
_TG = "list_transform(range(1, length(n) + 3), lambda i: substr('  ' || n || '  ', i, 3))"
SQL = {
    "e_block_pairs": f"{_BLOCKED} SELECT id, count(*) AS candidates, count(CASE WHEN strategies = 2 THEN 1 END) AS both_keys FROM b GROUP BY 1",
    "e_top25_candidates": f"{_BLOCKED}, x AS (SELECT b.*, levenshtein(regexp_replace(concat_ws(' ', m.forename, m.surname), '[^A-Z ]', '', 'g'), regexp_replace(concat_ws(' ', p.forename, p.surname), '[^A-Z ]', '', 'g')) AS edits FROM b JOIN m USING (id) JOIN p USING (record_id)) SELECT id, record_id, strategies, CAST(edits AS INTEGER) AS edits, CAST(row_number() OVER (PARTITION BY id ORDER BY strategies DESC, edits, record_id) AS INTEGER) AS rank FROM x QUALIFY rank <= 25",
    "e_levenshtein_pairs": f"WITH s AS (SELECT DISTINCT regexp_replace(upper(trim(surname)), '[^A-Z ]', '', 'g') AS s, {_SK('trim(surname)')} AS k FROM unified_record WHERE surname IS NOT NULL) SELECT a.s, b.s AS t, CAST(levenshtein(a.s, b.s) AS INTEGER) AS edits FROM s a JOIN s b ON a.k = b.k AND a.s < b.s WHERE levenshtein(a.s, b.s) <= 2",
    "e_trigram_cosine_topk": f"WITH q AS (SELECT DISTINCT lower(name) AS n FROM townland WHERE source <> 'json' AND name IS NOT NULL), c AS (SELECT DISTINCT lower(name) AS n FROM townland WHERE source = 'json' AND name IS NOT NULL), qv AS (SELECT n, g, count(*) AS tf FROM (SELECT n, unnest({_TG}) AS g FROM q) GROUP BY 1, 2), cv AS (SELECT n, g, count(*) AS tf FROM (SELECT n, unnest({_TG}) AS g FROM c) GROUP BY 1, 2), qn AS (SELECT n, sqrt(sum(tf * tf)) AS l FROM qv GROUP BY 1), cn AS (SELECT n, sqrt(sum(tf * tf)) AS l FROM cv GROUP BY 1), s AS (SELECT qv.n AS query, cv.n AS name, sum(qv.tf * cv.tf) / (any_value(qn.l) * any_value(cn.l)) AS cosine FROM qv JOIN cv USING (g) JOIN qn ON qn.n = qv.n JOIN cn ON cn.n = cv.n GROUP BY 1, 2) SELECT query, name, floor(cosine * 10000 + 0.5) / 10000 AS cosine FROM s WHERE cosine >= 0.5 QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, name) <= 3",
    "e_score_band": f"WITH {_SCORE} SELECT gold_id, CAST(impossible AS INTEGER) AS impossible, CASE WHEN sc >= 0.75 THEN 'CONFIRMED_MATCH' WHEN sc >= 0.6 THEN 'POSSIBLE_MATCH' WHEN sc >= 0.4 THEN 'WEAK_MATCH' ELSE 'NO_MATCH' END AS band, round(sc, 4) AS score FROM t",
    "e_prf1": f"WITH {_SCORE}, c AS (SELECT count(CASE WHEN sc >= 0.6 AND truth THEN 1 END) AS tp, count(CASE WHEN sc >= 0.6 AND NOT truth THEN 1 END) AS fp, count(CASE WHEN sc < 0.6 AND truth THEN 1 END) AS fn FROM t) SELECT tp, fp, fn, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c",
    "e_pair_completeness_rr": f"WITH {_gold_sql()}, x AS (SELECT a.gold_id AS a, b.gold_id AS b, any_value(a.truth) AS truth FROM g a JOIN g b ON (a.surname_a <> '' AND {_SK('a.surname_a')} <> '' AND {_SK('a.surname_a')} = {_SK('b.surname_b')}) OR (a.place_a <> '' AND a.place_a = b.place_b) GROUP BY 1, 2) SELECT (SELECT count(*) FROM g WHERE truth) AS true_pairs, count(CASE WHEN a = b AND truth THEN 1 END) AS kept_true, count(*) AS candidates, floor((1 - count(*)::DOUBLE / (SELECT count(*) * count(*) FROM g)) * 1e6 + 0.5) / 1e6 AS reduction_ratio FROM x",
    "e_strategy_candidates": f"{_STRATEGIES}, z AS (SELECT id, record_id, n, floor(levenshtein(na, nb)::DOUBLE / greatest(length(na), length(nb), 1) * 10000 + 0.5) / 10000 AS apart, place_a <> '' AND place_a = place_b AS same FROM y WHERE n > 0) SELECT id, record_id, CAST(n AS INTEGER) AS n, apart, CAST(row_number() OVER (PARTITION BY id ORDER BY n DESC, apart, same DESC, record_id) AS INTEGER) AS rank FROM z QUALIFY rank <= 25",
    "e_strategy_counts": f"{_STRATEGIES} SELECT s AS strategy, count(*) AS pairs FROM (SELECT unnest(met) AS s FROM y) WHERE s IS NOT NULL GROUP BY 1",
    "e_link_summary": f"{_STRATEGIES}, p2 AS (SELECT id, max(n) AS best, count(CASE WHEN n >= 4 THEN 1 END) AS strong FROM y GROUP BY 1), e AS (SELECT m.id, best, strong FROM m LEFT JOIN p2 USING (id)) SELECT CASE WHEN coalesce(best, 0) = 0 THEN 'unresolved' WHEN best >= 4 THEN 'strong' ELSE 'weak' END AS label, count(*) AS mentions, count(CASE WHEN strong > 1 THEN 1 END) AS ambiguous, CAST(coalesce(sum(strong), 0) AS BIGINT) AS strong_pairs FROM e GROUP BY 1",
    "e_evidence": f"WITH {_gold_sql()}, h AS (SELECT *, {_RATIO('name_a', 'name_b')} AS nr, {_RATIO('forename_a', 'forename_b')} AS fr, abs(birth_a - birth_b) AS gap, abs(year_a - year_b) AS years, age_a IS NOT NULL AND age_b IS NOT NULL AND year_a IS NOT NULL AND year_b IS NOT NULL AS aged, abs(age_a + (year_b - year_a) - age_b) AS drift, coalesce(trim(surname_a) <> '' AND trim(surname_b) <> '', false) AS bs, coalesce(trim(forename_a) <> '' AND trim(forename_b) <> '', false) AS bf, coalesce(trim(place_a) <> '' AND trim(place_b) <> '', false) AS bp, {_SK('surname_a')} AS ka, {_SK('surname_b')} AS kb, contains(place_a, place_b) OR contains(place_b, place_a) AS holds FROM g) SELECT gold_id, concat_ws(',', CASE WHEN nr >= 90 THEN 'name strong' WHEN nr >= 75 THEN 'name good' WHEN nr >= 60 THEN 'name partial' END, CASE WHEN bs AND surname_a = surname_b THEN 'surname exact' WHEN bs AND ka = kb THEN 'surname phonetic' END, CASE WHEN bf AND fr >= 90 THEN 'forename exact' WHEN bf AND fr >= 80 THEN 'forename close' WHEN bf AND fr >= 60 THEN 'forename partial' END, CASE WHEN bp AND place_a = place_b THEN 'place same' WHEN bp AND holds THEN 'place variant' END, CASE WHEN gap <= 3 THEN 'birth close' WHEN gap <= 8 THEN 'birth compatible' END, CASE WHEN aged THEN CASE WHEN drift <= 2 THEN 'age consistent' WHEN drift <= 5 THEN 'age compatible' END WHEN years <= 2 THEN 'time close' WHEN years <= 10 THEN 'time compatible' END) AS evidence, concat_ws(',', CASE WHEN bf AND fr < 60 THEN 'forename differs' END, CASE WHEN gap > 20 THEN 'birth impossible' END, CASE WHEN CASE WHEN aged THEN drift > 30 ELSE years > 40 END THEN 'time impossible' END) AS conflicts, concat_ws(',', CASE WHEN coalesce(nr < 60, true) THEN 'name' END, CASE WHEN NOT bs OR (surname_a <> surname_b AND ka <> kb) THEN 'surname' END, CASE WHEN NOT bf THEN 'forename' END, CASE WHEN NOT bp THEN 'place' WHEN NOT holds THEN 'place differs' END, CASE WHEN birth_a IS NULL OR birth_b IS NULL THEN 'birth' END, 'gender', CASE WHEN year_a IS NULL OR year_b IS NULL THEN 'time' END) AS missing FROM h",
    "e_mention_builder": f"{_mention_sql()} SELECT id, name, surname, forename, substr(forename, 1, 1) AS initial, {_SK('surname')} AS sound, CASE WHEN coalesce(event_year, 0) <> 0 AND coalesce(age, 0) <> 0 THEN event_year - age END AS birth FROM n",
    "e_decisions_applied": f"WITH {_DECIDED} SELECT u, v, status, reviews FROM d",
    "e_cluster_means": f"WITH RECURSIVE {_DECIDED}, {_COMPONENTS}, s AS (SELECT least(townland_id_a, townland_id_b) AS u, greatest(townland_id_a, townland_id_b) AS v, CAST(score AS DECIMAL(12, 6)) AS score FROM match_review) SELECT c.component, count(score) AS reviews, floor(sum(score)::DOUBLE / count(score) * 10000 + 0.5) / 10000 AS mean_score FROM s JOIN d ON d.u = s.u AND d.v = s.v AND d.status = 'confirmed' JOIN c ON c.vertex = s.u GROUP BY 1",
    "e_pick_canonical": f"WITH RECURSIVE {_DECIDED}, {_COMPONENTS}, p AS (SELECT id, CASE source WHEN 'kg' THEN 0 WHEN 'json' THEN 1 ELSE 2 END AS o, (name_gaelic IS NOT NULL)::INT + (barony IS NOT NULL)::INT + (civil_parish IS NOT NULL)::INT + (electoral_division IS NOT NULL)::INT + (logainm_id IS NOT NULL)::INT + (area_sqm IS NOT NULL)::INT + (wkt_geometry IS NOT NULL)::INT + (county IS NOT NULL)::INT AS filled FROM townland) SELECT component, id AS canonical_id, filled, count(*) OVER (PARTITION BY component) AS members FROM c JOIN p ON p.id = c.vertex QUALIFY row_number() OVER (PARTITION BY component ORDER BY o, filled DESC, id) = 1",
    "e_jaro_winkler": "SELECT DISTINCT gold_id, floor(jaro_winkler_similarity(regexp_replace(lower(wh_raw_name), '[^a-z ]', '', 'g'), regexp_replace(lower(u_canonical_name), '[^a-z ]', '', 'g')) * 10000 + 0.5) / 10000 AS similarity FROM er_gold WHERE gold_label IS NOT NULL",
    "e_connected_components": f"WITH RECURSIVE {_DECIDED}, {_COMPONENTS} SELECT vertex AS townland_id, component FROM c",
    "e_townland_pairs": "WITH p AS (SELECT *, substr(regexp_replace(upper(name), '[^A-Z0-9]', '', 'g'), 1, 3) || '|' || upper(trim(coalesce(county, ''))) AS k FROM townland WHERE name IS NOT NULL), x AS (SELECT a.id AS id_a, b.id AS id_b, coalesce(lower(a.civil_parish) = lower(b.civil_parish), false) AS cp, CASE WHEN coalesce(a.osm_id = b.osm_id, false) OR coalesce(a.osi_id = b.osi_id, false) OR coalesce(a.vrti_id = b.vrti_id, false) OR coalesce(a.kg_uri = b.kg_uri, false) OR coalesce(a.logainm_id = b.logainm_id, false) THEN 0.99::DOUBLE ELSE 0.35::DOUBLE * coalesce(1 - levenshtein(strip_accents(lower(a.name)), strip_accents(lower(b.name)))::DOUBLE / greatest(length(a.name), length(b.name), 1), 0) + 0.1::DOUBLE * coalesce(1 - levenshtein(strip_accents(lower(a.name_gaelic)), strip_accents(lower(b.name_gaelic)))::DOUBLE / greatest(length(a.name_gaelic), length(b.name_gaelic), 1), 0) + 0.15::DOUBLE * coalesce((lower(a.civil_parish) = lower(b.civil_parish))::INT, 0) + 0.1::DOUBLE * coalesce((lower(a.barony) = lower(b.barony))::INT, 0) + 0.1::DOUBLE * coalesce(least(a.area_sqm, b.area_sqm) / greatest(a.area_sqm, b.area_sqm), 0) END AS sc FROM p a JOIN p b ON a.k = b.k AND a.id < b.id), y AS (SELECT *, floor(sc * 10000 + 0.5) / 10000 AS score FROM x), z AS (SELECT id_a, id_b, score, CASE WHEN score >= 0.9 OR (score >= 0.6 AND cp) THEN 'merge' WHEN score >= 0.35 THEN 'review' ELSE 'reject' END AS decision FROM y) SELECT * FROM z WHERE decision <> 'reject'",
}
