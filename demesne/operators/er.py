"""Entity resolution: blocking, candidate ranking, scoring ladder, banding, measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demesne.functions.similarity import levenshtein_ratio, trigrams
from demesne.runtime import cut, hot_join, spread

MAX_CANDIDATES = 25
BANDS = ((0.75, "CONFIRMED_MATCH"), (0.60, "POSSIBLE_MATCH"), (0.40, "WEAK_MATCH"))
IMPOSSIBLE_CAP = 0.39
#: What counts as a like name, and as years near each other, among the candidate strategies.
FUZZY, YEARS = 82.0, 10
#: Names of one group that ``near_names`` compares at a time.
NAMES = 1_000
Ratio = Callable[[Column, Column], Column]


def skeleton(c: Column) -> Column:
    """First letter and the consonants after it: a sound key any SQL engine can compute."""
    letters = F.regexp_replace(F.upper(c), "[^A-Z]", "")
    return F.concat(F.substring(letters, 1, 1), F.regexp_replace(F.substring(letters, 2, 1000), "[AEIOUYHW]", ""))


def block_pairs(left: DataFrame, right: DataFrame, keys: dict[str, tuple[Column, Column]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, strategies): pairs that share any of the named keys, with how many.

    A null or empty key blocks nothing.  Each strategy is an equi-join, so a
    pair is met once a shared key and never by comparing all with all; frequent
    keys are cut into blocks.
    """
    tag = lambda df, side, i: df.select(F.col(i), F.explode(F.array(*[F.struct(F.lit(n).alias("s"), k[side].cast("string").alias("k")) for n, k in keys.items()])).alias("x")).select(i, "x.s", "x.k").where("k is not null and k <> ''").distinct()
    a, b = cut(tag(left, 0, left_id)), cut(tag(right, 1, right_id))
    return hot_join(a, b, ["s", "k"]).groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("strategies"))


def top_candidates(pairs: DataFrame, left_id: str, order: list[Column], most: int = MAX_CANDIDATES) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy(left_id).orderBy(*order)).cast("int")).where(F.col("rank") <= most)


def ladder(value: Column, *steps: tuple[float, float], down: bool = True, otherwise: float = 0.0) -> Column:
    """Points of the first step reached: ``value >= bound`` (``down``) or ``value <= bound``."""
    out = F.when(F.lit(False), F.lit(0.0))
    for bound, points in steps:
        out = out.when(value >= bound if down else value <= bound, F.lit(float(points)))
    return out.otherwise(F.lit(float(otherwise)))


def match_score(a: Callable[[str], Column], b: Callable[[str], Column], ratio: Ratio = levenshtein_ratio, phonetic: Callable[[Column], Column] = skeleton) -> Column:
    """Struct(score, impossible) on the 60-point ladder.

    ``a(field)`` and ``b(field)`` give name, surname, forename, place, birth,
    gender, year and age of the two sides; ``ratio`` is 0-100, ``phonetic`` the
    sound key of a surname.
    """
    filled = lambda c: c.isNotNull() & (F.trim(c) != "")
    full = ladder(ratio(a("name"), b("name")), (90, 10), (75, 7), (60, 4))
    surname = F.when(a("surname") == b("surname"), 10.0).when(phonetic(a("surname")) == phonetic(b("surname")), 7.0).otherwise(0.0)
    forename = F.when(~filled(a("forename")) | ~filled(b("forename")), 5.0).otherwise(ladder(ratio(a("forename"), b("forename")), (90, 10), (80, 7), (60, 4)))
    place = F.when(a("place") == b("place"), 10.0).when(filled(a("place")) & filled(b("place")) & (b("place").contains(a("place")) | a("place").contains(b("place"))), 6.0).otherwise(0.0)
    gap = F.abs(a("birth") - b("birth"))
    birth = ladder(gap, (3, 5), (8, 3), down=False)
    gender = F.when(~filled(a("gender")) | ~filled(b("gender")), 5.0).when(a("gender") == b("gender"), 10.0).otherwise(0.0)
    drift = F.abs(a("age") + (b("year") - a("year")) - b("age"))
    years = F.abs(a("year") - b("year"))
    aged = a("age").isNotNull() & b("age").isNotNull()
    time = F.when(aged, ladder(drift, (2, 5), (5, 3), down=False)).otherwise(ladder(years, (2, 5), (10, 2.5), down=False))
    impossible = F.coalesce(gap > 20, F.lit(False)) | F.coalesce(F.when(aged, drift > 30).otherwise(years > 40), F.lit(False))
    none = F.lit(0.0)
    score = sum((F.coalesce(p, none) for p in (full, surname, forename, place, birth, gender, time)), F.lit(0.0)) / 60
    return F.struct(F.when(impossible, F.least(score, F.lit(IMPOSSIBLE_CAP))).otherwise(score).alias("score"), impossible.alias("impossible"))


def evidence(a: Callable[[str], Column], b: Callable[[str], Column], ratio: Ratio = levenshtein_ratio, phonetic: Callable[[Column], Column] = skeleton) -> Column:
    """Struct(evidence, conflicts, missing): arrays of what speaks for a pair, what against, and what can't be told."""
    filled = lambda c: c.isNotNull() & (F.trim(c) != "")
    both = lambda f: filled(a(f)) & filled(b(f))
    known = lambda f: a(f).isNotNull() & b(f).isNotNull()
    name, fore = ratio(a("name"), b("name")), ratio(a("forename"), b("forename"))
    gap, years = F.abs(a("birth") - b("birth")), F.abs(a("year") - b("year"))
    aged = known("age") & known("year")
    drift = F.abs(a("age") + (b("year") - a("year")) - b("age"))
    holds = lambda x, y: x.contains(y) | y.contains(x)
    yes = [
        F.when(name >= 90, "name strong").when(name >= 75, "name good").when(name >= 60, "name partial"),
        F.when(both("surname") & (a("surname") == b("surname")), "surname exact").when(both("surname") & (phonetic(a("surname")) == phonetic(b("surname"))), "surname phonetic"),
        F.when(both("forename"), F.when(fore >= 90, "forename exact").when(fore >= 80, "forename close").when(fore >= 60, "forename partial")),
        F.when(both("place"), F.when(a("place") == b("place"), "place same").when(holds(a("place"), b("place")), "place variant")),
        F.when(gap <= 3, "birth close").when(gap <= 8, "birth compatible"),
        F.when(both("gender") & (a("gender") == b("gender")), "gender same"),
        F.when(aged, F.when(drift <= 2, "age consistent").when(drift <= 5, "age compatible")).otherwise(F.when(years <= 2, "time close").when(years <= 10, "time compatible")),
    ]
    no = [
        F.when(both("forename") & (fore < 60), "forename differs"), F.when(gap > 20, "birth impossible"), F.when(both("gender") & (a("gender") != b("gender")), "gender differs"),
        F.when(F.when(aged, drift > 30).otherwise(years > 40), "time impossible"),
    ]
    unknown = [
        F.when(F.coalesce(name < 60, F.lit(True)), "name"), F.when(~both("surname") | ((a("surname") != b("surname")) & (phonetic(a("surname")) != phonetic(b("surname")))), "surname"), F.when(~both("forename"), "forename"),
        F.when(~both("place"), "place").when(~holds(a("place"), b("place")), "place differs"), F.when(~known("birth"), "birth"), F.when(~both("gender"), "gender"), F.when(~known("year"), "time"),
    ]
    return F.struct(*[F.array_compact(F.array(*[F.coalesce(x, F.lit(None).cast("string")) for x in xs])).alias(n) for n, xs in (("evidence", yes), ("conflicts", no), ("missing", unknown))])


def strategies(a: Callable[[str], Column], b: Callable[[str], Column], ratio: Ratio = levenshtein_ratio, fuzzy: float = FUZZY, years: int = YEARS) -> Column:
    """Array of the candidate strategies a pair meets: exact name, surname and initial, sound of the surname, like name, same or variant place, year."""
    filled = lambda f: (a(f) != "") & (b(f) != "")
    first = lambda c: F.substring(c, 1, 1)
    found = [
        F.when(filled("name") & (a("name") == b("name")), "exact_name"),
        F.when(filled("surname") & (a("surname") == b("surname")) & filled("forename") & (first(a("forename")) == first(b("forename"))), "surname_initial"),
        F.when(filled("phonetic") & (a("phonetic") == b("phonetic")), "phonetic_surname"),
        F.when(filled("name") & (ratio(a("name"), b("name")) >= fuzzy), "fuzzy_name"),
        F.when(filled("place") & (a("place") == b("place")), "same_place").when(filled("place") & (a("place").contains(b("place")) | b("place").contains(a("place"))), "variant_place"),
        F.when(F.abs(a("year") - b("year")) <= years, "year"),
    ]
    return F.array_compact(F.array(*found))


def _letters(names: list[str], alphabet: dict[str, int], most: int) -> np.ndarray:
    """Letter counts written in unary, so that the product of two names' rows is the number of letters they share."""
    counts = np.zeros((len(names), len(alphabet)), dtype=np.int32)
    for i, n in enumerate(names):
        for c in n:
            counts[i, alphabet[c]] += 1
    return (counts[:, :, None] > np.arange(most)).reshape(len(names), -1).astype(np.float32)


def near_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Distinct (name_a, name_b) of one group whose ``levenshtein_ratio`` is at least ``least``; both sides are (group, name).

    Names are compared block by block in order of length.  Letters that two
    names don't share are a lower bound of their distance; only pairs that it
    leaves are measured.
    """
    apart = 1 - least / 100

    def blocks(df: DataFrame, s: str) -> DataFrame:
        at = F.floor((F.row_number().over(W.partitionBy("group").orderBy(F.length("name"), "name")) - 1) / NAMES)
        df = df.where(F.length("name") > 0).select("group", "name").distinct().withColumn("block", at)
        # bounded: NAMES names a row
        return df.groupBy("group", "block").agg(F.collect_list("name").alias(f"names_{s}"), F.min(F.length("name")).alias(f"lo_{s}"), F.max(F.length("name")).alias(f"hi_{s}")).withColumnRenamed("block", f"block_{s}")

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for xs, ys in zip(df["names_a"], df["names_b"]):
                xs, ys = list(xs), list(ys)
                alphabet = {c: i for i, c in enumerate(sorted(set("".join(xs)) | set("".join(ys))))}
                most = max(n.count(c) for n in (*xs, *ys) for c in set(n))
                size = np.maximum.outer(np.array([len(n) for n in xs], dtype=np.float32), np.array([len(n) for n in ys], dtype=np.float32))
                i, j = np.nonzero(size - _letters(xs, alphabet, most) @ _letters(ys, alphabet, most).T <= size * apart + 0.01)
                yield pd.DataFrame({"name_a": [xs[k] for k in i], "name_b": [ys[k] for k in j]}, dtype=object)

    reach = 1 - apart - 1e-6
    met = blocks(left, "a").join(blocks(right, "b"), "group").where((F.col("hi_b") >= F.col("lo_a") * reach) & (F.col("hi_a") >= F.col("lo_b") * reach))
    met = spread(met, "group", "block_a", "block_b").select("names_a", "names_b").mapInPandas(alike, "name_a string, name_b string")
    return met.where(levenshtein_ratio(F.col("name_a"), F.col("name_b")) >= least).distinct()


def band(score: Column) -> Column:
    out = F.when(F.lit(False), "")
    for bound, label in BANDS:
        out = out.when(score >= bound, label)
    return out.otherwise("NO_MATCH")


def trigram_cosine(queries: DataFrame, catalogue: DataFrame, query: str, name: str, k: int, least: float) -> DataFrame:
    """(query, name, cosine, rank): the ``k`` nearest names by cosine of trigram counts, met over shared trigrams."""
    def vectors(df: DataFrame, c: str) -> DataFrame:
        tf = df.select(c).where(F.col(c).isNotNull()).distinct().select(c, F.explode(trigrams(F.col(c))).alias("g")).groupBy(c, "g").agg(F.count(F.lit(1)).alias("tf"))
        return tf.withColumn("norm", F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(W.partitionBy(c))))

    q = vectors(queries, query).select(query, "g", F.col("tf").alias("tq"), F.col("norm").alias("nq"))
    n = vectors(catalogue, name).select(name, "g", F.col("tf").alias("tn"), F.col("norm").alias("nn"))
    s = hot_join(cut(q), cut(n), ["g"]).groupBy(query, name, "nq", "nn").agg(F.sum(F.col("tq") * F.col("tn")).alias("dot"))
    s = s.select(query, name, (F.col("dot") / (F.col("nq") * F.col("nn"))).alias("cosine")).where(F.col("cosine") >= least)
    return top_candidates(s, query, [F.round("cosine", 9).desc(), F.col(name)], k)


def pair_score(a: Callable[[str], Column], b: Callable[[str], Column], likeness: Ratio, overlap: Column | None = None) -> Column:
    """Weighted likeness of two place rows: 0.35 name, 0.10 Irish name, 0.15 parish, 0.10 barony, 0.10 area, 0.20 overlap of outlines; 0.99 on a shared id."""
    same = lambda f: F.coalesce((F.lower(a(f)) == F.lower(b(f))).cast("int"), F.lit(0))
    area = F.coalesce(F.least(a("area_sqm"), b("area_sqm")) / F.greatest(a("area_sqm"), b("area_sqm")), F.lit(0.0))
    parts = 0.35 * F.coalesce(likeness(a("name"), b("name")), F.lit(0.0)) + 0.10 * F.coalesce(likeness(a("name_gaelic"), b("name_gaelic")), F.lit(0.0)) + 0.15 * same("civil_parish") + 0.10 * same("barony") + 0.10 * area
    if overlap is not None:
        parts = parts + 0.20 * F.coalesce(overlap, F.lit(0.0))
    shared = F.lit(False)
    for f in ("osm_id", "osi_id", "vrti_id", "kg_uri", "logainm_id"):
        shared = shared | F.coalesce(a(f) == b(f), F.lit(False))
    return F.when(shared, F.lit(0.99)).otherwise(parts)


def edits(xs: list[str], ys: list[str]) -> np.ndarray:
    """Levenshtein distances of all of ``xs`` to all of ``ys``."""
    codes = [np.full((len(zs), max(map(len, zs), default=0)), k, dtype=np.int32) for k, zs in ((-1, xs), (-2, ys))]
    for c, zs in zip(codes, (xs, ys)):
        for i, z in enumerate(zs):
            c[i, : len(z)] = [ord(x) for x in z]
    a, b = codes
    la, lb = np.array([len(x) for x in xs], dtype=np.int64), np.array([len(y) for y in ys], dtype=np.int64)
    out = np.empty((len(xs), len(ys)), dtype=np.int32)
    step = max(1, 20_000 // max(1, len(ys)))
    for at in range(0, len(xs), step):
        p, n = a[at : at + step], la[at : at + step]
        row = [np.full((len(p), len(ys)), j, dtype=np.int16) for j in range(b.shape[1] + 1)]
        part = np.where(n[:, None] == 0, lb[None, :], 0).astype(np.int32)
        for i in range(p.shape[1]):
            last, row = row, [np.full((len(p), len(ys)), i + 1, dtype=np.int16)]
            for j in range(b.shape[1]):
                row.append(np.minimum(np.minimum(last[j + 1], row[j]) + 1, last[j] + (p[:, i, None] != b[None, :, j])))
            ends = np.nonzero(n == i + 1)[0]
            for j in np.unique(lb):
                cols = np.nonzero(lb == j)[0]
                part[np.ix_(ends, cols)] = row[j][np.ix_(ends, cols)]
        out[at : at + step] = part
    return out


def prf(df: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    """One row: true and false positives, false negatives, precision, recall and F1 (null without cases)."""
    c = df.agg(*[F.count(F.when(w, 1)).alias(n) for n, w in (("tp", predicted & truth), ("fp", predicted & ~truth), ("fn", ~predicted & truth))])
    p, r = F.expr("tp / nullif(tp + fp, 0)"), F.expr("tp / nullif(tp + fn, 0)")
    return c.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.expr("2 * tp / nullif(2 * tp + fp + fn, 0)"), 6).alias("f1"))
