"""Problem 1: variant spellings of personal names.

Work is done on distinct spellings, not on mentions.  Surnames written in one
register meet in a prefix-filtered set-similarity join on padded q-grams (the
rarest q-grams of a spelling first, by their frequency over all spellings), and
each candidate pair of spellings is verified once by weighted edit distance.  A
spelling is tied to the frequent spelling it most likely stands for.  Forenames
meet the known names and short forms in the same join (``persons``).

Two mentions of one register are then compared by a soft weighted token
similarity: surname and forename agree more or less, and each counts by the
rarity of its token.  Births more than ``BIRTH_GAP`` years apart exclude a link;
without a birth, the namesakes of the register must be of one time.  An initial
links to a full forename unless another of that initial bears the name there at
that age; then the place decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demesne.llm import places
from demesne.llm.grams import prefix_join
from demesne.llm.persons import with_names
from demesne.llm.text import osa
from demesne.runtime import cut, hot_join, lookup_join, spread, table

BIRTH_GAP = 4
#: a spelling this many times as frequent may be what another stands for
ANCHOR_RATIO = 3
THRESHOLD = 0.8
#: where mentions without a birth are met
NO_SLOT = 1 << 40


def most_edits(n: int) -> float:
    """Largest weighted distance between a surname of ``n`` letters and a variant."""
    return 0.8 if n <= 4 else 1.3 if n <= 6 else 2.0


_SCORED = T.StructType([T.StructField("word", T.StringType()), T.StructField("anchor", T.StringType()), T.StructField("d", T.DoubleType())])


def verified(pairs: DataFrame) -> DataFrame:
    """(word, anchor, d) of the candidates within ``most_edits`` by weighted Damerau-Levenshtein distance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b in zip(batch["word"], batch["anchor"]):
                most = most_edits(max(len(a), len(b)))
                d = osa(a, b, most)
                if d <= most:
                    rows.append((a, b, d))
            yield pd.DataFrame(rows, columns=["word", "anchor", "d"])

    # plain edits within the weighted limits: 0.8 is a swap, 1.3 a swap and a doubled letter, 2 two swaps or four doubled letters
    n = F.greatest(F.length("word"), F.length("anchor"))
    close = pairs.where(F.levenshtein("word", "anchor", 4) >= 0).where(F.levenshtein("word", "anchor") <= F.when(n <= 4, 2).when(n <= 6, 3).otherwise(4))
    return spread(close, "word", "anchor").mapInPandas(run, _SCORED)


def spellings(surnames: DataFrame, scope: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """From (surname, scope columns): (word, df, rep, rep_df) and (word, anchor, d).

    Spellings met in one scope are compared.  ``rep`` is the spelling a word
    most likely stands for: the nearest one at least ``ANCHOR_RATIO`` times as
    frequent (ties: the more frequent, then by alphabet), followed once more
    from there; else the word itself.  The second table has the pairs of near
    words that stand for themselves, each once.  Only ratios of frequencies
    decide, so tables repeated give the same spellings.
    """
    surnames = surnames.where("surname <> ''").withColumnRenamed("surname", "word")
    df_of = cut(surnames.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    near = cut(verified(prefix_join(surnames, scope=scope, exact=False)))
    both = near.unionByName(near.select(F.col("anchor").alias("word"), F.col("word").alias("anchor"), "d"))
    met = both.join(df_of, "word").join(df_of.select(F.col("word").alias("anchor"), F.col("df").alias("df2")), "anchor").where(F.col("df2") >= ANCHOR_RATIO * F.col("df"))
    best = F.min(F.struct("d", (-F.col("df2")).alias("n"), F.col("anchor").alias("rep")))
    to = cut(met.groupBy("word").agg(best.alias("m")).select("word", F.col("m.rep").alias("rep")))
    twice = to.join(to.select(F.col("word").alias("rep"), F.col("rep").alias("rep2")), "rep", "left").select("word", F.coalesce("rep2", "rep").alias("rep"))
    words = df_of.join(twice, "word", "left").withColumn("rep", F.coalesce("rep", "word"))
    # a token's rarity is that of the name it stands for, not of the slip
    words = cut(words.join(words.groupBy("rep").agg(F.sum("df").alias("rep_df")), "rep"))
    alone = words.where(F.col("rep") == F.col("word")).select("word")
    direct = near.join(alone, "word", "left_semi").join(alone.withColumnRenamed("word", "anchor"), "anchor", "left_semi").select("word", "anchor", "d")
    return words, direct


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an id: register, name read, birth, place; late deliveries replace earlier ones."""
    keep = ["source_record_id", "raw_name", "forename", "surname", "raw_place", "event_year", "age", "inferred_birth_year"]
    m = places.latest(table(spark, sf_dir, "source_mentions"), keep)
    name = F.when(F.trim(F.coalesce("raw_name", F.lit(""))) != "", F.col("raw_name")).otherwise(F.concat_ws(", ", "surname", "forename"))
    m = m.select(
        "id",
        F.split("source_record_id", ":").getItem(1).alias("register"),
        name.alias("name"),
        F.col("raw_place"),
        F.coalesce(F.col("inferred_birth_year"), F.col("event_year") - F.col("age")).alias("birth"),
    )
    return with_names(m, "name").select("id", "register", "birth", "raw_place", F.col("n.surname").alias("surname"), F.col("n.forenames").alias("forenames"), F.col("n.initial").alias("initial"))


def idf(df: Column, total: int) -> Column:
    return F.log(1 + F.lit(float(total)) / df)


def rarities(m: DataFrame) -> tuple[int, DataFrame]:
    """(mentions, ``m`` with ``heads`` and ``given_df``).

    ``heads``: first letters of the forename.  ``given_df``: how many mentions
    may bear the forename (of several readings the commonest); for an initial,
    how many have a name that it begins.
    """
    m = m.withColumn("heads", F.array_distinct(F.when(F.col("initial") != "", F.array("initial")).otherwise(F.transform("forenames", lambda f: F.substring(f, 1, 1)))))
    counts = m.select(F.explode(F.array_distinct(F.concat("heads", "forenames"))).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    each = m.select("id", F.explode(F.when(F.col("initial") != "", F.col("heads")).otherwise(F.col("forenames"))).alias("f")).distinct()
    given = lookup_join(each, counts, ["f"]).groupBy("id").agg(F.max("n").alias("given_df"))
    return m.count(), lookup_join(m, given, ["id"])


def agreement(fa: Column, ia: Column, fb: Column, ib: Column) -> Column:
    """1 shared forename, 0.5 an initial that fits, 0 no; an initial stands in for any name it begins."""
    starts = lambda names, i: F.exists(names, lambda x: F.substring(x, 1, 1) == i)
    return (
        F.when((ia == "") & (ib == ""), F.arrays_overlap(fa, fb).cast("double"))
        .when((ia != "") & (ib != ""), F.when(ia == ib, 0.5).otherwise(0.0))
        .when(ia != "", F.when(starts(fb, ia), 0.5).otherwise(0.0))
        .otherwise(F.when(starts(fa, ib), 0.5).otherwise(0.0))
    )


def linked_mentions(m: DataFrame, place: str | None = None) -> DataFrame:
    """(a, b, score), a < b: mentions of one register that mean the same person.

    ``m``: id, register, surname, forenames, initial, birth and, if ``place`` is
    given, that column.  A mention without birth links to its namesakes of the
    register if all of them are of one time (births not more than ``BIRTH_GAP``
    apart), else to those of its place if these are.  A mention without surname, forename or
    register links to none.  Each pair comes once; an empty table gives none.
    """
    keep = ["id", "register", "surname", "forenames", "initial", "birth"]
    m = m.select(*keep, (F.col(f"`{place}`") if place else F.lit(None).cast("string")).alias("place")).distinct()
    m = cut(m.where("surname <> '' and register is not null and (size(forenames) > 0 or initial <> '')"))
    words, direct = spellings(m.select("surname", "register"), ["register"])
    m = lookup_join(m, words.select(F.col("word").alias("surname"), F.col("rep_df").alias("df"), "rep"), ["surname"])
    total, m = rarities(m)
    # spellings that stand for one another
    links = direct.select(F.col("word").alias("rep"), F.col("anchor").alias("key")).unionByName(direct.select(F.col("anchor").alias("rep"), F.col("word").alias("key"))).distinct()
    m = cut(m.withColumn("head", F.explode("heads")).drop("heads"))
    near = m.join(links, "rep").unionByName(m.withColumn("key", F.col("rep")).select("rep", *[c for c in m.columns if c != "rep"], "key"))
    side = lambda df, s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in ("register", "key", "head", "slot")], "register", "key", "head", "slot")
    slot = F.floor(F.col("birth") / (BIRTH_GAP + 1))
    mine = m.withColumn("key", F.col("rep"))
    left = side(mine.where("birth is not null").withColumn("slot", slot), "a").unionByName(side(mine.where("birth is null").withColumn("slot", F.lit(None).cast("long")), "a"))
    # a mention without birth meets all its namesakes, under a slot of their own
    any_slot = F.lit(NO_SLOT).cast("long")
    left = cut(left.withColumn("slot", F.coalesce("slot", any_slot)))
    slots = F.when(F.col("birth").isNull(), F.array(any_slot)).otherwise(F.array(slot - 1, slot, slot + 1, any_slot))
    right = cut(side(near.withColumn("slot", F.explode(slots)), "b"))
    gap = F.coalesce(F.abs(F.col("birth_a") - F.col("birth_b")), F.lit(0))
    met = hot_join(left, right, ["register", "key", "head", "slot"]).where((F.col("id_a") != F.col("id_b")) & (gap <= BIRTH_GAP))
    # pairs of two births come from both ends: one is enough; so with pairs of none
    met = met.where((F.col("id_a") < F.col("id_b")) | (F.col("birth_a").isNull() != F.col("birth_b").isNull()))
    met = met.withColumn("given", agreement(F.col("forenames_a"), F.col("initial_a"), F.col("forenames_b"), F.col("initial_b"))).where("given > 0")
    alike = F.when(F.col("rep_a") == F.col("rep_b"), 1.0 - 0.02 * F.levenshtein("surname_a", "surname_b")).otherwise(1.0 - F.levenshtein("surname_a", "surname_b") / F.greatest(F.length("surname_a"), F.length("surname_b")) / 2)
    wa, wb, ga, gb = (idf(F.col(c), total) for c in ("df_a", "df_b", "given_df_a", "given_df_b"))
    score = (wa * wb * alike + ga * gb * (0.8 + 0.2 * (F.col("given") == 1).cast("double"))) / F.sqrt((wa * wa + ga * ga) * (wb * wb + gb * gb))
    met = cut(met.withColumn("score", score).where(F.col("score") >= THRESHOLD))
    known = met.where("birth_a is not null and birth_b is not null")
    full = known.where("given = 1").select("id_a", "id_b", "score")
    same_place = F.coalesce(F.col("place_a") == F.col("place_b"), F.lit(False))
    # a birth unknown: the namesakes must be of one time, at least those of the place
    vague = met.where("birth_a is null or birth_b is null")
    vague = vague.withColumn("same_place", same_place)
    here = F.when(F.col("same_place"), F.col("birth_b"))
    span = vague.where("birth_a is null").groupBy(F.col("id_a").alias("id")).agg(F.min("birth_b").alias("first"), F.max("birth_b").alias("last"), F.min(here).alias("first_here"), F.max(here).alias("last_here"))
    for s in ("a", "b"):
        vague = vague.join(span.select(*[F.col(c).alias(f"{c}_{s}") for c in span.columns]), f"id_{s}", "left")
    years = lambda last, first: F.coalesce(F.greatest(f"{last}_a", f"{last}_b", "birth_a", "birth_b") - F.least(f"{first}_a", f"{first}_b", "birth_a", "birth_b"), F.lit(0))
    vague = vague.where((years("last", "first") <= BIRTH_GAP) | F.col("same_place") & (years("last_here", "first_here") <= BIRTH_GAP)).select(*met.columns)
    full = full.unionByName(vague.where("given = 1").select("id_a", "id_b", "score"))
    doubtful = known.where("given < 1").unionByName(vague.where("given < 1"))
    # an initial that may mean several names borne there at that age links only at the same place
    one = F.when(F.col("initial_a") != "", F.col("id_a")).otherwise(F.col("id_b"))
    other = F.when(F.col("initial_a") != "", F.col("forenames_b")).otherwise(F.col("forenames_a"))
    rivals = doubtful.where("initial_a = '' or initial_b = ''").select(one.alias("id"), F.explode(other).alias("f")).groupBy("id").agg(F.countDistinct("f").alias("names"))
    for s in ("a", "b"):
        doubtful = doubtful.join(rivals.select(F.col("id").alias(f"id_{s}"), F.col("names").alias(f"names_{s}")), f"id_{s}", "left")
    alone = (F.coalesce("names_a", F.lit(1)) <= 1) & (F.coalesce("names_b", F.lit(1)) <= 1) | same_place
    every = full.unionByName(doubtful.where(alone).select("id_a", "id_b", "score"))
    return every.groupBy(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).agg(F.max("score").alias("score"))


def placed_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with ``place``: the canonical townland name, else the place as written."""
    m = mentions(spark, sf_dir)
    names = places.canonical_names(table(spark, sf_dir, "townland"))
    mapped = places.map_spellings(m, "raw_place", names, table(spark, sf_dir, "townland_aliases"))
    m = lookup_join(m, mapped.select(F.col("raw").alias("raw_place"), F.col("name").alias("canonical")), ["raw_place"], "left")
    return m.withColumn("place", F.coalesce("canonical", F.when(F.trim("raw_place") != "", F.lower("raw_place")))).drop("raw_place", "canonical")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_mentions(placed_mentions(spark, sf_dir), "place").select(F.col("a").alias("mention_id_a"), F.col("b").alias("mention_id_b"))


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
