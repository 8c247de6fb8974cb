"""Problem 10: template residue, filler, error messages and script notices.

Texts are split into passages.  Passages that hold one of a few trusted phrases
(``SEEDS``) are the labelled positives; all others are unlabelled.  A naive
Bayes model over words, word pairs and the marks glued to words is learned from
the two by expectation-maximization: unlabelled passages start as archive text,
and each round their posterior becomes their weight.  The seeds only start the
learning; what counts as residue is the model's posterior alone.

Every round is one pass over all passages; what comes back is one sum a feature
bucket (``2 ** HASH_BITS`` buckets, whatever the corpus), summed in as many
tasks as there are cores.  Features that mostly stand in archive text but are
commoner than usual in residue are left out, so that the words of a half-filled
template don't count against the same template filled in.  A record is excluded
if any of its passages is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demesne.runtime import cut, table

HASH_BITS = 20
ROUNDS = 8
#: the learning ends early once the residue's weight changes by no more than this share
SETTLED = 0.01
#: passages of the average kind that stand behind every feature's share
SMOOTHING = 1.0
#: a feature counts as sign of residue from this share of its weight on
PURE = 0.2
#: bounds of what one feature can say, in nats
LEAST_ODDS, MOST_ODDS = -2.0, 8.0
ACCEPT = 0.9
#: weights below this are no evidence
NOTHING = 1e-9

#: Trusted phrases, in lower case, a blank for the start of a word; a passage that holds one is a labelled positive.
SEEDS = (
    "{{", "[object object]", "undefined was", ": undefined", "population undefined", " lorem ", "test test test", "xxxx", "x x x x", "text goes here", "coming soon", "content to follow", "to be supplied",
    "404 not found", "internal server error", "not found on this server", "gateway time", "too many requests", "temporarily unavailable", "down for maintenance", "something went wrong", "application error",
    "timed out while", "error: timeout", "traceback (most recent", "invalid request: parameter", "contact your administrator", "no longer exists", "tharla earráid", "níor aimsíodh",
    "enable javascript", "javascript is disabled", "javascript is required", "noscript version", "javascript a bheith",
)
_SPLIT = re.compile(r"(?<=[.?!])[\s ]+|[\r\n]+|</?(?:p|br|div|h\d|li|tr|td|body|html|title|pre)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?(?:i|b|em|strong|span|a|u|sup|sub|font)\b[^<>]*>", re.I)
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|([^\w\s])\1{3,}|[^\w\s]|_+")
_MARKS = frozenset("{}[]<>«»%@#$=|_~^\\/*")


def passages(text: str | None) -> list[str]:
    """Sentences and lines of a text, entities and inline markup undone; blank ones left out."""
    if not text:
        return []
    t = html.unescape(text).replace("­", "").replace("​", "")
    t = re.sub(r"-\n(?=[a-z])", "", t)
    t = re.sub(r"[\[(](?:p|pp|page|fol|folio)\.?\s*\d+[\])]", " ", t, flags=re.I)
    return [q for q in (" ".join(_TAG.sub("", p).split()) for p in _SPLIT.split(t)) if q]


def trusted(passage: str, seeds: tuple[str, ...] = SEEDS) -> bool:
    low = f" {passage.lower()} "
    return any(x in low for x in seeds)


@lru_cache(maxsize=1 << 18)
def _hash(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) & (2**HASH_BITS - 1)


@lru_cache(maxsize=1 << 17)
def _token(w: str) -> tuple[str, str, str, bool, bool]:
    """(kind at the start of a passage, kind elsewhere, lower case, letters or digits, a capital first)."""
    first, low = w[0], w.lower()
    if first.isdigit():
        kind = other = "<9>"
    elif len(w) > 2 and first != "_" and len(set(low)) == 1:
        kind = other = "<run>"
    elif any(map(str.isdigit, w)):
        kind = other = "<id>"
    else:
        kind = low
        other = "<n>" if first.isupper() and len(w) > 1 and w[1:].islower() else low
    return kind, other, low, first.isalnum(), first.isupper()


def features(passage: str) -> list[int]:
    """Buckets of the words, word pairs, capitalised pairs and words glued to marks of a passage; most names and numbers by kind."""
    if passage.isupper():
        passage = passage.lower()
    out: set[str] = set()
    add = out.add
    before, title = "<s>", ""
    end = len(passage)
    for i, m in enumerate(_TOKEN.finditer(passage)):
        w = m[0]
        start, other, low, written, capital = _token(w)
        kind = other if i else start
        add("1 " + kind)
        add(f"2 {before} {kind}")
        before = kind
        if written:
            if kind == "<9>" and len(w) == 3:
                add("9 " + w)
            a, b = m.span()
            left, right = a > 0 and passage[a - 1] in _MARKS, b < end and passage[b] in _MARKS
            if left:
                add("l " + low)
            if right:
                add("r " + low)
            if left and right:
                add("b")
            if capital:
                add("n " + low)
                if title:
                    add(f"t {title} {low}")
                title = low
            else:
                title = ""
    add(f"2 {before} </s>")
    return sorted({_hash(f) for f in out})


_PASSAGE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("trusted", T.BooleanType()), T.StructField("features", T.ArrayType(T.IntegerType()))])
_SUM = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("w", T.DoubleType()), T.StructField("n", T.DoubleType())])


class Bayes:
    """Log odds of a feature bucket; ``base`` is the prior's."""

    def __init__(self, weight: np.ndarray, total: np.ndarray, positive: float, passages_: float) -> None:
        prior = (positive + 0.5) / (passages_ + 1)
        self.base = float(np.log(prior / (1 - prior)))
        share = np.minimum((weight + SMOOTHING * prior) / (total + SMOOTHING), 1 - 1e-4)
        odds = np.log(share / (1 - share)) - self.base
        keep = (share >= PURE) | (share <= prior)
        self.odds = np.where(keep, np.clip(odds, LEAST_ODDS, MOST_ODDS), 0.0).astype(np.float32)

    def score(self, features_: pd.Series) -> np.ndarray:
        """Posterior that each passage is residue."""
        n = features_.map(len).to_numpy()
        if not n.sum():
            return np.zeros(len(features_))
        flat = self.odds[np.concatenate(features_.to_list()).astype(np.int64)]
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        some = n > 0
        sums = np.zeros(len(n))
        sums[some] = np.add.reduceat(flat, starts[some])
        return np.where(some, 1 / (1 + np.exp(-np.clip(self.base + sums, -60, 60))), 0.0)


def split_documents(documents: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(doc_id, trusted, features) of every passage of every document."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 2000):
                docs: list[int] = []
                marked: list[bool] = []
                flat: list[int] = []
                ends = [0]
                for d, t in zip(ids[at : at + 2000], texts[at : at + 2000]):
                    for p in passages(t):
                        docs.append(d)
                        marked.append(trusted(p, seeds))
                        flat += features(p)
                        ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(marked, pa.bool_()), lists], names=["doc_id", "trusted", "features"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and length(trim(text)) > 0")
    wanted = 3 * documents.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < wanted:
        docs = docs.repartition(wanted, "doc_id")
    return docs.mapInArrow(split, _PASSAGE)


def learned(split: DataFrame, rounds: int = ROUNDS) -> Bayes | None:
    """The model after at most ``rounds`` of expectation-maximization over all passages; None without any trusted one."""
    sc = split.sparkSession.sparkContext
    size = 2**HASH_BITS
    # one array of sums a task, and no more tasks than cores, however many splits the corpus has
    split = split.coalesce(2 * sc.defaultParallelism)
    model: Bayes | None = None
    total = np.zeros(size)
    count = 0.0
    before = -1.0
    for _ in range(rounds + 1):
        shared = sc.broadcast(model)

        def sums(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            m = shared.value
            w, n = np.zeros(size), np.zeros(size if m is None else 0)
            positive = passages_ = 0.0
            for batch in batches:
                if not len(batch):
                    continue
                mine = batch["trusted"].to_numpy(dtype=float)
                if m is not None:
                    mine = np.maximum(mine, m.score(batch["features"]))
                else:
                    n += np.bincount(np.concatenate(batch["features"].to_list()).astype(np.int64), minlength=size)
                positive, passages_ = positive + mine.sum(), passages_ + len(batch)
                some = np.flatnonzero(mine > NOTHING)
                if len(some):
                    f = batch["features"].iloc[some]
                    w += np.bincount(np.concatenate(f.to_list()).astype(np.int64), np.repeat(mine[some], f.map(len).to_numpy()), size)
            at = np.flatnonzero(w if m is not None else n)
            yield pd.DataFrame({"bucket": np.append(at, -1).astype("int32"), "w": np.append(w[at], positive), "n": np.append(n[at] if m is None else np.zeros(len(at)), passages_)})

        # bounded: one row a feature bucket
        got = split.mapInPandas(sums, _SUM).groupBy("bucket").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).toPandas()
        whole, rest = got[got["bucket"] < 0], got[got["bucket"] >= 0]
        w = np.zeros(size)
        w[rest["bucket"]] = rest["w"]
        if model is None:
            total[rest["bucket"]] = rest["n"]
            count = float(whole["n"].sum())
        positive = float(whole["w"].sum())
        if not positive:
            return None
        model = Bayes(w, total, positive, count)
        if abs(positive - before) <= SETTLED * positive:
            break
        before = positive
    return model


def residue_scores(documents: DataFrame, rounds: int = ROUNDS, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(doc_id, passages, residue_passages, score) of every document with text.

    ``score`` is the highest posterior of its passages.  Null and blank texts
    have no row; a repeated doc_id is judged by all its texts; without any
    trusted passage there is nothing to learn from and every score is 0; an
    empty table gives no rows.
    """
    split = cut(split_documents(documents, seeds))
    shared = documents.sparkSession.sparkContext.broadcast(learned(split, rounds))

    @F.pandas_udf(T.DoubleType())
    def posterior(f: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(f) if shared.value is not None else np.zeros(len(f)))

    scored = split.select("doc_id", posterior("features").alias("p"))
    return scored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("passages"), F.sum((F.col("p") >= ACCEPT).cast("int")).alias("residue_passages"), F.max("p").alias("score"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_scores(table(spark, sf_dir, "documents")).where(F.col("score") >= ACCEPT).select("doc_id")


QUERIES = {"p10_found": p10_found}
SQL: dict[str, str] = {}
