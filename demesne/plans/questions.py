"""Reading of whole tables of questions: lanes, templates and the places they name, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demesne.plans.router import CUES

#: Words that point to a lane; the first lane with any of its words wins, ``other`` if none has.
LANES = {
    "comparative": ["compare", "versus", " vs ", "difference between", "more than", "less than", "overtook"],
    "relational": ["which parish", "which barony", "which county", "where is", "near", "neighbour", "belongs to", "adjoin", "link ", "both in", "tell me about", "history of", "monument", "holy well"],
    "analytical": ["how many", "number of", "total", "average", "share", "count", "per year", "by year", "trend", "most", "least", "highest", "lowest"],
}
LEAST_SCORE = 2


def _any(q: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | q.contains(w)
    return hit


def lane(text: Column) -> Column:
    """The kind of lookup a question asks for."""
    q = F.lower(text)
    out = F.when(F.lit(False), "")
    for name, words in LANES.items():
        out = out.when(_any(q, words), name)
    return out.otherwise("other")


def templates() -> list[tuple[str, list[str], list[str]]]:
    """(template, required words, optional words): every metric and group of cues, with its other cues as optional."""
    return [(metric, group, sorted({w for g in groups for w in g} - set(group))) for metric, groups in CUES for group in groups]


def best_template(text: Column) -> Column:
    """Struct(template, score): 2 a required word, all of which must stand there, and 1 an optional one; the first best wins from ``LEAST_SCORE`` on."""
    q = F.lower(text)
    has = lambda w: q.contains(w).cast("int")
    scored = []
    for at, (name, required, optional) in enumerate(templates()):
        every = F.lit(True)
        for w in required:
            every = every & q.contains(w)
        score = F.lit(2 * len(required))
        for w in optional:
            score = score + has(w)
        scored.append(F.when(every, F.struct(score.alias("score"), F.lit(-at).alias("order"), F.lit(name).alias("template"))))
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] >= LEAST_SCORE, F.struct(best["template"].alias("template"), best["score"].alias("score")))


def places_named(questions: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, words): the canonical names that stand in each text as runs of words.

    ``names``: (name).  Names of up to four words meet the texts' runs of as many
    words by equi-join; no text is held against every name.
    """
    words = F.regexp_extract_all(F.upper(F.col(text)), F.lit("([A-Z']+)"), F.lit(1))
    t = questions.select(key, words.alias("w"))
    runs = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(F.array_join(F.slice("w", i, n), " ").alias("name"), n.alias("words")))).otherwise(F.array().cast("array<struct<name:string,words:int>>"))))
    met = t.select(key, F.explode(F.array_distinct(runs)).alias("r")).select(key, "r.name", "r.words")
    return met.join(names.select(F.upper("name").alias("name")).distinct(), "name").select(key, "name", "words")
