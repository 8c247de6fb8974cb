"""Retrieval queries: the held-out items ask, the documents answer."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from demesne.operators import retrieval as R
from demesne.plans import views
from demesne.runtime import table

K = 5


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null")


def _questions(spark, d):
    """Questions put to the corpus: the categories of the items with words of the archive."""
    return spark.createDataFrame([(1, "arrears left standing when the agent closed the book"), (2, "widow of the carpenter without goats"), (3, "persons put down for the ship to quebec"), (4, "lease fell in and no renewal")], "query_id long, ask string")


_Q_SQL = "q AS (SELECT CAST(query_id AS BIGINT) AS query_id, ask FROM (VALUES (1, 'arrears left standing when the agent closed the book'), (2, 'widow of the carpenter without goats'), (3, 'persons put down for the ship to quebec'), (4, 'lease fell in and no renewal')) AS t(query_id, ask))"


def _dense(spark, d):
    corpus = R.tfidf(_docs(spark, d).select("doc_id", "text"), "doc_id", "text")
    return R.dense(R.query_weights(_questions(spark, d), "query_id", "ask"), corpus, "query_id", "doc_id", K)


def _overlap(spark, d):
    """Shared distinct words of more than three letters, ranked."""
    words = lambda df, key, text: df.select(key, F.explode(F.array_distinct(F.filter(R.tokens(F.col(text), False), lambda w: F.length(w) > 3))).alias("w"))
    s = words(_questions(spark, d), "query_id", "ask").join(words(_docs(spark, d), "doc_id", "text"), "w").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return R.top_k(s, "query_id", "doc_id", "score", K)


def _fixed(df):
    return df.withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)


def r_tfidf_topk(spark, d):
    return _fixed(_dense(spark, d))


def r_tfidf_terms(spark, d):
    """Per term its documents and its greatest weight."""
    w = R.tfidf(_docs(spark, d).select("doc_id", "text"), "doc_id", "text")
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), (F.floor(F.max("weight") * 1e6 + 0.5) / 1e6).alias("greatest"))


def r_keyword_overlap(spark, d):
    return _overlap(spark, d)


def r_keyword_score(spark, d):
    s = R.keyword_score(F.col("text"), ["tenant"], ["slated", "quebec", "arrears"])
    return _docs(spark, d).select("doc_id", s.cast("int").alias("score")).where("score > 0")


def r_rrf(spark, d):
    return _fixed(R.fuse(_dense(spark, d), _overlap(spark, d), "query_id", "doc_id"))


def r_rrf_weighted(spark, d):
    return _fixed(R.fuse(_dense(spark, d), _overlap(spark, d), "query_id", "doc_id", (0.6, 0.4)))


def r_cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.vector_search(q, e, 10).withColumn("score", F.floor(F.col("score") * 1e5 + 0.5) / 1e5).select("query_id", "vec_id", "score")


def r_label_centroids(spark, d):
    """Sum of the vectors of every label, by dimension, and the number of its members."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", "i").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x").cast("decimal(20,10)")).cast("double"), 4).alias("total"))


def r_chunk_build(spark, d):
    """One chunk a place: a text built from its records, with its hash."""
    r = views.records(spark, d).where("townland_norm is not null").groupBy("townland_norm").agg(F.countDistinct("record_id").alias("n"), F.min("year").alias("a"), F.max("year").alias("b"), F.array_join(F.slice(F.array_sort(F.collect_set("parish")), 1, 3), ", ").alias("parishes"))
    text = F.concat_ws(" ", F.lit("Place"), "townland_norm", F.lit("has"), F.col("n").cast("string"), F.lit("records from"), F.col("a").cast("string"), F.lit("to"), F.col("b").cast("string"), F.lit("in"), "parishes")
    return r.select(F.concat(F.lit("place:"), "townland_norm").alias("chunk_id"), text.alias("text"), F.sha2(text, 256).alias("content_hash"))


def r_chunk_kinds(spark, d):
    """The corpus of chunks by kind: records, person passports, places, census, clearances, workhouse entries and documents, with the letters of their texts."""
    r = views.records(spark, d)
    line = lambda *parts: F.concat_ws(" ", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    people = r.where("record_id is not null").groupBy("record_id").agg(F.min("surname").alias("surname"), F.min("forename").alias("forename"), F.min("year").alias("a"), F.max("year").alias("b"), F.count(F.lit(1)).alias("n"))
    parts = {
        "record": r.select(line("surname", "forename", "year", "townland_norm", "role", "comments").alias("t")),
        "passport": people.select(line("forename", "surname", "a", "b", "n").alias("t")),
        "place": views.catalogue(spark, d).select(line("name", "parish", "barony", "county").alias("t")),
        "census": views.census(spark, d).select(line("townland_norm", "year", "total", "male", "female").alias("t")),
        "clearance": views.clearances(spark, d).select(line("townland_norm", "year", "evictions").alias("t")),
        "workhouse": table(spark, d, "source_mentions").where("id is not null").groupBy("id").agg(F.max(line("raw_name", "raw_place", "event_year", "age")).alias("t")).select("t"),
        "document": _docs(spark, d).select(F.col("text").alias("t")),
    }
    out = None
    for kind, df in parts.items():
        part = df.where("t <> ''").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("letters"))
        out = part if out is None else out.unionByName(part)
    return out


def r_signature(spark, d):
    return table(spark, d, "eval_items").select("item_id", R.signature(F.col("text")).alias("signature"))


def r_lsh_recall(spark, d):
    """Recall at 10 of a random-projection index against exact search."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    unit = F.transform("embedding", lambda x: x.cast("double") / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))))
    v = e.select("vec_id", array_to_vector(unit).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=0.8, numHashTables=24, seed=5).fit(v)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "features")
    near = model.approxSimilarityJoin(q, v, 2.0, "dist").select(F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.vec_id").alias("vec_id"), (-F.col("dist")).alias("score"))
    approx = R.top_k(near, "query_id", "vec_id", "score", 10)
    exact = R.vector_search(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 10)
    hit = exact.join(approx.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("r_") and callable(f)}

_TFIDF = """tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), w0 AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents WHERE text IS NOT NULL))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
nn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w0 GROUP BY 1), w AS (SELECT doc_id, term, w / norm AS weight FROM w0 JOIN nn USING (doc_id))"""
_DENSE = f"""{_Q_SQL}, {_TFIDF}, qt AS (SELECT query_id, term, 1 + ln(count(*)) AS w FROM (SELECT query_id, unnest(regexp_extract_all(lower(ask), '[a-z0-9]+')) AS term FROM q) GROUP BY 1, 2),
qw AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM qt),
ds AS (SELECT query_id, doc_id, sum(qw.weight * w.weight) AS score FROM qw JOIN w USING (term) GROUP BY 1, 2),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ds WHERE score > 0 QUALIFY rank <= {K})"""
_OVER = f"""ow AS (SELECT DISTINCT query_id, t AS w FROM (SELECT query_id, unnest(regexp_extract_all(lower(ask), '[a-z0-9]+')) AS t FROM q) WHERE length(t) > 3),
dw AS (SELECT DISTINCT doc_id, t AS w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents) WHERE length(t) > 3),
orr AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank FROM ow JOIN dw USING (w) GROUP BY 1, 2 QUALIFY rank <= {K})"""
_R6 = "floor(score * 1e6 + 0.5) / 1e6 AS score"
SQL = {
    "r_tfidf_topk": f"WITH {_DENSE} SELECT query_id, doc_id, {_R6}, CAST(rank AS INTEGER) AS rank FROM dr",
    "r_tfidf_terms": f"WITH {_TFIDF} SELECT term, count(*) AS documents, floor(max(weight) * 1e6 + 0.5) / 1e6 AS greatest FROM w GROUP BY 1",
    "r_keyword_overlap": f"WITH {_Q_SQL}, {_OVER} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM orr",
    "r_keyword_score": "WITH s AS (SELECT doc_id, CASE WHEN contains(lower(text), 'tenant') THEN 2 + contains(lower(text), 'slated')::INT + contains(lower(text), 'quebec')::INT + contains(lower(text), 'arrears')::INT ELSE 0 END AS score FROM documents WHERE text IS NOT NULL) SELECT doc_id, score FROM s WHERE score > 0",
    "r_rrf": f"WITH {_DENSE}, {_OVER}, f AS (SELECT coalesce(dr.query_id, orr.query_id) AS query_id, coalesce(dr.doc_id, orr.doc_id) AS doc_id, coalesce(1.0::DOUBLE / (60 + dr.rank), 0) + coalesce(1.0::DOUBLE / (60 + orr.rank), 0) AS score FROM dr FULL OUTER JOIN orr ON dr.query_id = orr.query_id AND dr.doc_id = orr.doc_id) SELECT query_id, doc_id, {_R6} FROM f",
    "r_rrf_weighted": f"WITH {_DENSE}, {_OVER}, f AS (SELECT coalesce(dr.query_id, orr.query_id) AS query_id, coalesce(dr.doc_id, orr.doc_id) AS doc_id, dr.rank AS ra, orr.rank AS rb FROM dr FULL OUTER JOIN orr ON dr.query_id = orr.query_id AND dr.doc_id = orr.doc_id), g AS (SELECT f.*, coalesce((SELECT count(*) FROM dr WHERE dr.query_id = f.query_id), 0) AS la, coalesce((SELECT count(*) FROM orr WHERE orr.query_id = f.query_id), 0) AS lb FROM f), h AS (SELECT query_id, doc_id, 0.6::DOUBLE / (60 + coalesce(ra, la + 60)) + 0.4::DOUBLE / (60 + coalesce(rb, lb + 60)) AS score FROM g) SELECT query_id, doc_id, {_R6} FROM h",
    "r_cosine_topk": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q, v WHERE q.vec_id % 100 = 0) SELECT query_id, vec_id, floor(score * 1e5 + 0.5) / 1e5 AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) <= 10",
    "r_label_centroids": "WITH x AS (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) SELECT label, CAST(i AS INTEGER) AS i, count(*) AS n, round(CAST(sum(CAST(x AS DECIMAL(20, 10))) AS DOUBLE), 4) AS total FROM x GROUP BY 1, 2",
    "r_chunk_build": "WITH r AS (SELECT townland_norm, count(DISTINCT record_id) AS n, min(year) AS a, max(year) AS b, array_to_string(list_sort(list(DISTINCT parish))[1:3], ', ') AS p FROM unified_record WHERE townland_norm IS NOT NULL GROUP BY 1), t AS (SELECT townland_norm, concat_ws(' ', 'Place', townland_norm, 'has', n, 'records from', a, 'to', b, 'in', coalesce(p, '')) AS text FROM r) SELECT 'place:' || townland_norm AS chunk_id, text, sha256(text) AS content_hash FROM t",
    "r_chunk_kinds": f"WITH {views.CATALOGUE}, {views.CENSUS}, {views.CLEARANCES}, t AS (SELECT 'record' AS kind, concat_ws(' ', surname, forename, year, townland_norm, role, comments) AS t FROM unified_record UNION ALL SELECT 'passport', concat_ws(' ', min(forename), min(surname), min(year), max(year), count(*)) FROM unified_record WHERE record_id IS NOT NULL GROUP BY record_id UNION ALL SELECT 'place', concat_ws(' ', name, parish, barony, county) FROM catalogue UNION ALL SELECT 'census', concat_ws(' ', townland_norm, year, total, male, female) FROM census UNION ALL SELECT 'clearance', concat_ws(' ', townland_norm, year, evictions) FROM clearances UNION ALL SELECT 'workhouse', max(concat_ws(' ', raw_name, raw_place, event_year, age)) FROM source_mentions WHERE id IS NOT NULL GROUP BY id UNION ALL SELECT 'document', text FROM documents WHERE text IS NOT NULL) SELECT kind, count(*) AS chunks, CAST(coalesce(sum(length(t)), 0) AS BIGINT) AS letters FROM t WHERE t <> '' GROUP BY 1",
    "r_signature": "SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + "))[1:18], ' ') AS signature FROM eval_items",
}
