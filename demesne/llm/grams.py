"""Prefix-filtered set-similarity join of words on padded q-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demesne.runtime import cut, hot_join

Q = 3
#: least Jaccard similarity of q-gram sets; two typing slips in a word of seven letters leave about this much
JACCARD = 0.2


def grams(word: Column, q: int = Q) -> Column:
    """Set of the padded q-grams of a word."""
    padded = F.concat(F.lit("^" * (q - 1)), word, F.lit("$" * (q - 1)))
    all_ = F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda i: F.substring(padded, i, F.lit(q)))
    return F.array_distinct(all_)


def prefix_join(words: DataFrame, anchors: DataFrame | None = None, jaccard: float = JACCARD, scope: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(word, anchor): the pairs of different words whose q-gram sets have at least that Jaccard similarity.

    ``words`` and ``anchors`` have a column ``word``; without ``anchors`` the
    words are held against each other and each pair comes once, ``word`` before
    ``anchor``.  With ``scope`` (columns of both) only words met in one scope
    are compared, so that the work grows with the scopes and not with the
    square of all words.  Words are posted under their ``n - ceil(jaccard * n) +
    1`` rarest q-grams: two sets that similar must share one of them.  Postings
    of a common q-gram are cut into blocks.  Null and empty words meet none.
    Unless ``exact``, candidates that share a prefix q-gram but are less similar
    are left in, for callers that verify by another distance.
    """
    scope = scope or []
    mine = words.select(*scope, "word").where("word <> ''").distinct()
    theirs = mine if anchors is None else anchors.select(*scope, "word").where("word <> ''").distinct()
    every = mine.select("word") if anchors is None else mine.select("word").unionByName(theirs.select("word"))
    every = every.distinct().select("word", F.explode(grams(F.col("word"))).alias("g"))
    df_of = every.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    # bounded: q-grams over 26 letters and two marks, at most 28 ** Q rows
    ranked = every.join(F.broadcast(df_of), "g").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("gs"))
    n = F.size("gs")
    keep = n - F.ceil(n * jaccard).cast("int") + 1
    prefix = cut(ranked.select("word", n.alias("n"), F.slice("gs", F.lit(1), keep)["g"].alias("gs")))

    def posted(df: DataFrame) -> DataFrame:
        return cut(df.join(prefix, "word").select(*scope, "word", "n", F.explode("gs").alias("g")))

    left = posted(mine)
    right = (left if anchors is None else posted(theirs)).select(*scope, F.col("word").alias("anchor"), F.col("n").alias("m"), "g")
    differ = F.col("word") < F.col("anchor") if anchors is None else F.col("word") != F.col("anchor")
    met = hot_join(left, right, [*scope, "g"]).where(differ & (F.least("n", "m") >= F.greatest("n", "m") * jaccard)).select("word", "anchor", "n", "m").distinct()
    if not exact:
        return met.select("word", "anchor")
    both = F.size(F.array_intersect(grams(F.col("word")), grams(F.col("anchor"))))
    return met.where(both >= F.lit(jaccard) * (F.col("n") + F.col("m") - both)).select("word", "anchor")
