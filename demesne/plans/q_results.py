"""Guard, evidence gate, diagnostics and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from demesne.operators import quality
from demesne.plans import questions, router, views
from demesne.runtime import table

_STATEMENTS = ["SELECT 1", "select count(*) from orders;", "WITH a AS (SELECT 1) SELECT * FROM a", "DROP TABLE orders", "SELECT 1; DELETE FROM orders", "SELECT 'drop table x' AS t", "", "EXPLAIN SELECT 1", "SELECT * FROM a -- update later", "UPDATE orders SET o = 1", "(SELECT 1) UNION (SELECT 2)", "SELECT replace(name, 'a', 'b') FROM nation"]


def q_guard_verdicts(spark, d):
    s = spark.createDataFrame([(i, t) for i, t in enumerate(_STATEMENTS)], "n long, statement string")
    return s.select("n", router.guard_verdict(F.col("statement")).alias("verdict"))


def _items(spark, d):
    return table(spark, d, "eval_items").where("text is not null")


def q_lanes(spark, d):
    """The lane of every test item."""
    return _items(spark, d).select("item_id", questions.lane(F.col("text")).alias("lane"))


def q_template_match(spark, d):
    """The template that fits every test item best, where one does."""
    return _items(spark, d).select("item_id", questions.best_template(F.col("text")).alias("b")).where("b is not null").select("item_id", "b.template", "b.score")


def q_places_named(spark, d):
    """The canonical names every test item holds, word by word."""
    return questions.places_named(_items(spark, d), views.places(spark, d).where("source = 'json' and name is not null"), "item_id", "text")


def q_read_questions(spark, d):
    """Slots read from every test item by the rules."""

    def read(batches):
        import pandas as pd

        for batch in batches:
            got = [router.read_question(t) for t in batch["text"]]
            yield pd.DataFrame({
                "item_id": batch["item_id"], "metric": [r.slots.metric if r.slots else None for r in got], "dims": [",".join(r.slots.group_by) if r.slots else None for r in got],
                "filters": [",".join(sorted(r.slots.filters)) if r.slots else None for r in got], "confidence": [r.confidence for r in got], "reason": [r.reason for r in got],
            })

    return _items(spark, d).select("item_id", "text").mapInPandas(read, "item_id long, metric string, dims string, filters string, confidence double, reason string")


def q_numeric_gate(spark, d):
    """Numbers that stand in a document's text but not in what is recorded of it: year, length, place and chunk."""
    docs = table(spark, d, "documents").where("text is not null")
    evidence = F.concat_ws(" ", F.col("doc_year").cast("string"), F.col("n_chars").cast("string"), "townland_norm", "chunk_id")
    return docs.select("doc_id", F.array_join(F.array_sort(router.unsupported(F.col("text"), evidence)), " ").alias("unsupported")).where("unsupported <> ''")


def q_null_rates(spark, d):
    return quality.null_rates(views.records(spark, d), ["surname", "forename", "parish", "age", "acres", "ship_name", "comments", "rent_owed"])


def q_value_profile(spark, d):
    r = views.records(spark, d)
    return quality.value_profile(r, "gender").unionByName(quality.value_profile(r, "estate")).unionByName(quality.value_profile(r, "role"))


def q_zero_diag(spark, d):
    """Why a question for one surname and year finds nothing: what each condition alone leaves."""
    r = views.records(spark, d)
    return r.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("surname") == "Nosuchname", 1)).alias("surname_only"), F.count(F.when(F.col("year") == 1848, 1)).alias("year_only"), F.count(F.when((F.col("surname") == "Nosuchname") & (F.col("year") == 1848), 1)).alias("both"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def q_lane_discrepancy(spark, d):
    r = views.records(spark, d).where("townland_norm is not null")
    a = r.where("has_eviction_record = 1").groupBy("townland_norm").agg(F.countDistinct("record_id").alias("v"))
    b = r.where("has_eviction_record = 1").groupBy("townland_norm").agg(F.count(F.lit(1)).alias("v"))
    return quality.lane_discrepancy(a, b, "townland_norm", "v")


def q_confusion(spark, d):
    g = table(spark, d, "er_gold").where("gold_label is not null").dropDuplicates(["gold_id"])
    return g.groupBy("confidence").pivot("gold_label", ["TRUE_MATCH", "FALSE_MATCH"]).agg(F.count(F.lit(1))).select("confidence", F.coalesce("TRUE_MATCH", F.lit(0)).cast("long").alias("true_match"), F.coalesce("FALSE_MATCH", F.lit(0)).cast("long").alias("false_match"))


def q_stale_metadata(spark, d):
    m = table(spark, d, "townland").groupBy("source").agg(F.max("updated_at").alias("last"))
    return quality.stale(m, F.col("last"), "2023-06-01", 365).select("source", "age_days", "stale")


def dash_emigration(spark, d):
    r = views.records(spark, d).where("has_emigration_record = 1")
    return r.groupBy("arrival").agg(F.countDistinct("record_id").alias("people"), F.countDistinct("ship_name").alias("ships"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.when(F.col("age") < 15, 1)).alias("children"))


def dash_evictions(spark, d):
    r = views.records(spark, d).where("has_eviction_record = 1")
    return r.groupBy((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade"), F.coalesce("legal_action", F.lit("none")).alias("action")).agg(F.countDistinct("record_id").alias("records"), F.countDistinct("townland_norm").alias("places"))


def dash_tenancies(spark, d):
    r = views.records(spark, d).where("has_tenancy_record = 1")
    rent = F.col("rent_owed").cast("decimal(18,2)")
    return r.groupBy("parish").agg(F.countDistinct("record_id").alias("tenants"), F.sum(rent).cast("double").alias("rent"), F.count("arrears").alias("in_arrears"), F.max("holding_acres").alias("largest"))


def dash_geo(spark, d):
    p = views.places(spark, d)
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("name").alias("names"), F.count("centroid_lat").alias("located"), F.count(F.when(F.col("wkt_geometry").ilike("%polygon%"), 1)).alias("outlined"))


def dash_surnames(spark, d):
    n = views.records(spark, d).where("trim(surname) <> ''").groupBy("surname").agg(F.countDistinct("record_id").alias("records"), F.countDistinct("townland_norm").alias("places"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return n.orderBy(F.desc("records"), "surname").limit(35)


def dash_overview(spark, d):
    r = views.records(spark, d).agg(F.countDistinct("record_id").alias("records"), F.countDistinct(F.when(F.col("has_emigration_record") == 1, F.col("record_id"))).alias("emigrants"), F.countDistinct(F.when(F.col("has_eviction_record") == 1, F.col("record_id"))).alias("evicted"), F.countDistinct(F.when(F.col("has_tenancy_record") == 1, F.col("record_id"))).alias("tenants"), F.countDistinct(F.when(F.col("is_widow") == 1, F.col("record_id"))).alias("widows"), F.countDistinct("ship_name").alias("ships"))
    c = views.census(spark, d).where("year = 1841").agg(F.sum("total").alias("people_1841"))
    # two one-row results
    return r.join(F.broadcast(c))


QUERIES = {n: f for n, f in list(globals().items()) if (n.startswith("q_") or n.startswith("dash_")) and callable(f)}

_VALUES = ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(_STATEMENTS))
_NUM = lambda c: f"regexp_extract_all(regexp_replace(regexp_replace({c}, '(\\d),(\\d{{3}})\\b', '\\1\\2', 'g'), '(\\d),(\\d{{3}})\\b', '\\1\\2', 'g'), '\\d+(?:\\.\\d+)?')"
_NULLS = ["surname", "forename", "parish", "age", "acres", "ship_name", "comments", "rent_owed"]
_QC = lambda words: "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"
_TEMPLATES = " UNION ALL ".join(f"SELECT item_id, '{n}' AS template, {2 * len(r)} + " + " + ".join([f"contains(q, '{w}')::INT" for w in o] or ["0"]) + f" AS score, {i} AS o FROM e WHERE " + " AND ".join(f"contains(q, '{w}')" for w in r) for i, (n, r, o) in enumerate(questions.templates()))
SQL = {
    "q_lanes": "WITH e AS (SELECT item_id, lower(text) AS q FROM eval_items WHERE text IS NOT NULL) SELECT item_id, CASE " + " ".join(f"WHEN {_QC(w)} THEN '{n}'" for n, w in questions.LANES.items()) + " ELSE 'other' END AS lane FROM e",
    "q_template_match": f"WITH e AS (SELECT item_id, lower(text) AS q FROM eval_items WHERE text IS NOT NULL), t AS ({_TEMPLATES}) SELECT item_id, template, score FROM t WHERE score >= {questions.LEAST_SCORE} QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, o) = 1",
    "q_places_named": "WITH w AS (SELECT item_id, regexp_extract_all(upper(text), '[A-Z'']+') AS w FROM eval_items WHERE text IS NOT NULL), r AS (SELECT DISTINCT item_id, words, array_to_string(w[i:i + words - 1], ' ') AS name FROM (SELECT item_id, w, words, unnest(range(1, len(w) - words + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS words))) SELECT item_id, name, CAST(words AS INTEGER) AS words FROM r WHERE name IN (SELECT upper(name) FROM townland WHERE source = 'json' AND name IS NOT NULL)",
    "q_guard_verdicts": f"WITH s AS (SELECT CAST(n AS BIGINT) AS n, statement FROM (VALUES {_VALUES}) AS v(n, statement)), t AS (SELECT n, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(statement, '--[^\\n]*', ' ', 'g'), '''[^'']*''', ' x ', 'g'), '\\s+', ' ', 'g'), ';\\s*$', '')) AS t FROM s) SELECT n, CASE WHEN t = '' THEN 'empty' WHEN contains(t, ';') THEN 'several statements' WHEN NOT regexp_matches(lower(t), '^\\(*\\s*(select|with)\\b') THEN 'not a query' WHEN regexp_matches(lower(t), '\\b({'|'.join(router.BLOCKED)})\\b') THEN 'blocked word' ELSE 'ok' END AS verdict FROM t",
    "q_numeric_gate": f"WITH d AS (SELECT doc_id, {_NUM('text')} AS n, array_to_string({_NUM('concat_ws(chr(32), doc_year, n_chars, townland_norm, chunk_id)')}, ' ') AS k FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(n, lambda x: length(regexp_replace(x, '\\D', '', 'g')) >= 3 AND NOT contains(k, x)))), ' ') AS unsupported FROM d WHERE unsupported <> ''",
    "q_null_rates": "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) AS rows, count(*) - count({c}) AS nulls FROM unified_record" for c in _NULLS) + ") SELECT *, floor(nulls * 10000.0::DOUBLE / nullif(rows, 0) + 0.5) / 10000 AS rate, CAST(rows >= 5 AND floor(nulls * 10000.0::DOUBLE / nullif(rows, 0) + 0.5) / 10000 >= 0.6 AS INTEGER) AS warn FROM c",
    "q_value_profile": " UNION ALL ".join(f"(SELECT '{c}' AS column, {c} AS value, count(*) AS n FROM unified_record GROUP BY 2 ORDER BY n DESC, value NULLS LAST LIMIT 5)" for c in ("gender", "estate", "role")),
    "q_zero_diag": "SELECT count(*) AS rows, count(CASE WHEN surname = 'Nosuchname' THEN 1 END) AS surname_only, count(CASE WHEN year = 1848 THEN 1 END) AS year_only, count(CASE WHEN surname = 'Nosuchname' AND year = 1848 THEN 1 END) AS both, min(year) AS first_year, max(year) AS last_year FROM unified_record".replace(" AS both", ' AS "both"'),
    "q_lane_discrepancy": "WITH r AS (SELECT townland_norm, count(DISTINCT record_id) AS a, count(*) AS b FROM unified_record WHERE townland_norm IS NOT NULL AND has_eviction_record = 1 GROUP BY 1) SELECT townland_norm, a, b, CASE WHEN abs(a - b)::DOUBLE / nullif(greatest(a, b), 0) < 0.05 THEN 'agree' WHEN abs(a - b)::DOUBLE / greatest(a, b) < 0.2 THEN 'close' ELSE 'differ' END AS verdict FROM r",
    "q_confusion": "WITH g AS (SELECT DISTINCT gold_id, gold_label, confidence FROM er_gold WHERE gold_label IS NOT NULL) SELECT confidence, count(CASE WHEN gold_label = 'TRUE_MATCH' THEN 1 END) AS true_match, count(CASE WHEN gold_label = 'FALSE_MATCH' THEN 1 END) AS false_match FROM g GROUP BY 1",
    "q_stale_metadata": "SELECT source, CAST(date_diff('day', max(updated_at)::DATE, DATE '2023-06-01') AS INTEGER) AS age_days, CAST(date_diff('day', max(updated_at)::DATE, DATE '2023-06-01') >= 365 AS INTEGER) AS stale FROM townland GROUP BY 1",
    "dash_emigration": "SELECT arrival, count(DISTINCT record_id) AS people, count(DISTINCT ship_name) AS ships, min(year) AS first_year, max(year) AS last_year, count(CASE WHEN age < 15 THEN 1 END) AS children FROM unified_record WHERE has_emigration_record = 1 GROUP BY 1",
    "dash_evictions": "SELECT CAST(floor(year / 10) * 10 AS INTEGER) AS decade, coalesce(legal_action, 'none') AS action, count(DISTINCT record_id) AS records, count(DISTINCT townland_norm) AS places FROM unified_record WHERE has_eviction_record = 1 GROUP BY 1, 2",
    "dash_tenancies": "SELECT parish, count(DISTINCT record_id) AS tenants, CAST(sum(CAST(rent_owed AS DECIMAL(18, 2))) AS DOUBLE) AS rent, count(arrears) AS in_arrears, max(holding_acres) AS largest FROM unified_record WHERE has_tenancy_record = 1 GROUP BY 1",
    "dash_geo": "SELECT source, count(*) AS rows, count(DISTINCT name) AS names, count(centroid_lat) AS located, count(CASE WHEN wkt_geometry ILIKE '%polygon%' THEN 1 END) AS outlined FROM townland GROUP BY 1",
    "dash_surnames": "SELECT surname, count(DISTINCT record_id) AS records, count(DISTINCT townland_norm) AS places, min(year) AS first_year, max(year) AS last_year FROM unified_record WHERE trim(surname) <> '' GROUP BY 1 ORDER BY records DESC, surname LIMIT 35",
    "dash_overview": f"WITH {views.CENSUS} SELECT count(DISTINCT record_id) AS records, count(DISTINCT CASE WHEN has_emigration_record = 1 THEN record_id END) AS emigrants, count(DISTINCT CASE WHEN has_eviction_record = 1 THEN record_id END) AS evicted, count(DISTINCT CASE WHEN has_tenancy_record = 1 THEN record_id END) AS tenants, count(DISTINCT CASE WHEN is_widow = 1 THEN record_id END) AS widows, count(DISTINCT ship_name) AS ships, (SELECT CAST(sum(total) AS BIGINT) FROM census WHERE year = 1841) AS people_1841 FROM unified_record",
}
