"""Retrieval over a text corpus: TF-IDF, keyword and vector search, rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RRF_K = 60
#: Words left out of question signatures.
STOP_WORDS = ["a", "an", "and", "are", "at", "by", "did", "do", "for", "from", "had", "has", "have", "how", "in", "is", "it", "many", "me", "of", "on", "or", "show", "tell", "that", "the", "there", "to", "was", "were", "what", "which", "who", "with"]


def tokens(c: Column, bigrams: bool = True) -> Column:
    """Words ``[a-z0-9]+`` and, if asked, pairs ``a_b``."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    if not bigrams:
        return words
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws("_", F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def term_counts(docs: DataFrame, key: str, text: str, bigrams: bool = False) -> DataFrame:
    return docs.select(key, F.explode(tokens(F.col(text), bigrams)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(docs: DataFrame, key: str, text: str, bigrams: bool = False) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), each text scaled to length 1."""
    tf = term_counts(docs, key, text, bigrams)
    n = docs.agg(F.count(F.lit(1)).alias("N"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one row
    w = tf.join(df, "term").join(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def query_weights(queries: DataFrame, key: str, text: str, bigrams: bool = False) -> DataFrame:
    """(key, term, weight) of queries: 1 + ln tf scaled to length 1; the corpus side carries the idf."""
    q = term_counts(queries, key, text, bigrams).withColumn("w", 1 + F.log("tf"))
    return q.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))).select(key, "term", "weight")


def top_k(scored: DataFrame, query: str, item: str, score: str, k: int) -> DataFrame:
    w = W.partitionBy(query).orderBy(F.round(score, 9).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def dense(queries: DataFrame, corpus: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """(query, item, score, rank) by dot product of (.., term, weight) tables, met over shared terms."""
    q = queries.select(query, "term", F.col("weight").alias("wq"))
    s = q.join(corpus.select(item, "term", "weight"), "term").groupBy(query, item).agg(F.sum(F.col("wq") * F.col("weight")).alias("score"))
    return top_k(s.where("score > 0"), query, item, "score", k)


def keyword_score(text: Column, required: list[str], optional: list[str]) -> Column:
    """2 a required word and 1 an optional one; 0 if a required one is missing."""
    t = F.lower(text)
    has = lambda w: t.contains(w)
    every = F.lit(True)
    for w in required:
        every = every & has(w)
    score = F.lit(2 * len(required))
    for w in optional:
        score = score + has(w).cast("int")
    return F.coalesce(F.when(every, score).otherwise(0), F.lit(0))


def fuse(a: DataFrame, b: DataFrame, query: str, item: str, weights: tuple[float, float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (query, item, rank).

    Without weights a list that lacks an item adds nothing; with weights a
    missing rank counts as the list's length plus ``RRF_K``.
    """
    ra, rb = a.select(query, item, F.col("rank").alias("ra")), b.select(query, item, F.col("rank").alias("rb"))
    both = ra.join(rb, [query, item], "full_outer")
    part = lambda r: 1.0 / (RRF_K + F.col(r))
    if weights is None:
        return both.select(query, item, (F.coalesce(part("ra"), F.lit(0.0)) + F.coalesce(part("rb"), F.lit(0.0))).alias("score"))
    la, lb = ra.groupBy(query).agg(F.count(F.lit(1)).alias("la")), rb.groupBy(query).agg(F.count(F.lit(1)).alias("lb"))
    both = both.join(la, query, "left").join(lb, query, "left")
    rank = lambda r, n: F.coalesce(F.col(r), F.coalesce(F.col(n), F.lit(0)) + RRF_K)
    return both.select(query, item, (weights[0] / (RRF_K + rank("ra", "la")) + weights[1] / (RRF_K + rank("rb", "lb"))).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; 0 for an empty one, unequal lengths or no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def vector_search(queries: DataFrame, items: DataFrame, k: int, query: str = "query_id", item: str = "vec_id") -> DataFrame:
    """Exact (query, item, score, rank): the stated query set against all items, in blocks of both.

    Each item is normalised once; a query block meets each item partition, and
    only the ``k`` best of a partition go on to the final ranking.
    """
    import numpy as np
    import pandas as pd

    rows = queries.select(query, "embedding").collect()
    if len(rows) > 100_000:
        raise ValueError("more queries than fit a block; split the query set")
    ids = [r[0] for r in rows]
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    if not ids:
        return items.select(F.col(item).alias(query), F.col(item), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where(F.lit(False))
    shared = items.sparkSession.sparkContext.broadcast((ids, unit(np.array([r[1] for r in rows], dtype=np.float64))))

    def best(batches):
        qids, q = shared.value
        for batch in batches:
            if not len(batch):
                continue
            m = unit(np.stack(batch["embedding"].to_numpy()).astype(np.float64))
            s = q @ m.T
            names = batch[item].to_numpy()
            take = min(k, s.shape[1])
            top = np.argpartition(-s, take - 1, axis=1)[:, :take]
            yield pd.DataFrame({query: np.repeat(qids, take), item: names[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()})

    parts = items.where("embedding is not null").select(item, "embedding").mapInPandas(best, f"{query} long, {item} long, score double")
    return top_k(parts, query, item, "score", k)


def signature(c: Column, most: int = 18) -> Column:
    """Words of a question without the commonest, in order, at most ``most``."""
    return F.array_join(F.slice(F.filter(tokens(c, False), lambda w: ~w.isin(STOP_WORDS)), 1, most), " ")
