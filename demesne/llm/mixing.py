"""Problem 9: mixing sources to target shares of all tokens, with capped repeats.

Every document has a fixed pseudo-random position (a hash of its id).  A source
is used whole as often as its budget allows, and the rest of the budget is the
part below a threshold position.  The threshold is found by histograms: tokens
are summed by source and the leading bits of the position, the bucket in which
the budget ends is refined by the next bits, and so on; only that bucket is
looked at again.  No document is sorted or collected: the sums of a source (at
most ``2 ** BITS`` a level) are run through on the executors, and the driver
sees one row a source and level.  Larger budgets only raise the threshold, so
mixes of different sizes are nested.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demesne.runtime import cut, table, ws_trim

BITS = 12
LEVELS = 5
VOCABULARY = "byte_bpe_50k.tiktoken"
#: a text is cut into pieces of about this many characters for the tokenizer, only where that changes no token
PIECE = 200_000
#: a single blank between words: the vocabulary's pattern takes it with the word behind it
_CUT = regex.compile(r"(?r)(?<=\S) (?=\S)")
#: one row a target is held by the driver
MAX_TARGETS = 200_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        # the last such blank of the piece, else the first one after it
        m = _CUT.search(text, at + 1, at + PIECE) or regex.search(r"(?<=\S) (?=\S)", text, pos=at + PIECE - 1)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_counts(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``tokens``: the length of ``text`` in tokens of a byte-level vocabulary file; 0 for null and empty text."""
    import public_tokenizers

    pattern = public_tokenizers.PATTERN

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(path, pattern)
        for s in texts:
            yield s.map(lambda t: sum(len(enc.encode_ordinary(p)) for p in _pieces(t)) if t else 0).astype("int64")

    return documents.withColumn("tokens", count(text))


def source_key(c: Column) -> Column:
    """Spelling of a source undone: lower case, no outer blanks, inner blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(ws_trim(c)), r"[\s-]+", "_")


def mixed(documents: DataFrame, targets: DataFrame, total: float | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(copies, shares) of ``documents`` (key, source, tokens) for ``targets`` (source, target_share, max_repeats).

    ``copies``: key, source, tokens, copies of every document used.  ``shares``:
    one row a target with what it has, what was asked and what was reached.
    ``total`` is the size of the mix; by default the largest at which every
    source that has any document still meets its share of it.  A source that
    lacks documents is used to its cap and falls short of its budget; one with
    none reaches 0.  Documents of other sources, without key or without tokens
    are not used.  Rows with one key share a position.
    """
    t = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in t.limit(MAX_TARGETS + 1).collect()}
    if len(wanted) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    spark = documents.sparkSession
    place = F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - BITS * LEVELS)
    d = documents.select(F.col(key), source_key(F.col("source")).alias("source"), "tokens").where(F.col(key).isNotNull() & (F.col("tokens") > 0))
    # bounded: one row a target, at most MAX_TARGETS
    d = cut(d.join(F.broadcast(t.select("source")), "source", "left_semi").withColumn("place", place))
    have = dict.fromkeys(wanted, 0) | {r["source"]: r["tokens"] for r in d.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    if total is None:
        total = min((have[s] * m / share for s, (share, m) in wanted.items() if have[s] and share > 0 and m > 0), default=0.0)
    budget = {s: share * total for s, (share, _) in wanted.items()}
    whole, rest = {}, {}
    for s, (_, m) in wanted.items():
        asked = min(budget[s], m * have[s])
        whole[s] = min(m, int(asked // have[s])) if have[s] else 0
        rest[s] = asked - whole[s] * have[s]
    threshold = dict.fromkeys(wanted, 0)
    open_ = {s for s in wanted if rest[s] > 0 and have[s]}

    def borders(level: int) -> dict[str, tuple[int, int, int, int]]:
        """By source: bucket of this level in which the rest of the budget ends, its tokens and documents, and the tokens before it."""
        low = BITS * (LEVELS - 1 - level)
        state = spark.createDataFrame([(s, float(rest[s]), threshold[s] >> low >> BITS) for s in open_], "source string, rest double, above long")
        # bounded: one row a target
        inside = d.join(F.broadcast(state), "source").where(F.shiftrightunsigned("place", low + BITS) == F.col("above"))
        sums = inside.groupBy("source", "rest", F.shiftrightunsigned("place", low).bitwiseAND(2**BITS - 1).alias("b")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
        # bounded: at most 2 ** BITS sums a source
        upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("b"))
        over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        first = over.groupBy("source").agg(F.min(F.struct("b", "tokens", "n", "upto")).alias("m"))
        return {r["source"]: (r["m"]["b"], r["m"]["tokens"], r["m"]["n"], r["m"]["upto"] - r["m"]["tokens"]) for r in first.collect()}

    for level in range(LEVELS):
        if not open_:
            break
        low = BITS * (LEVELS - 1 - level)
        found = borders(level)
        for s in list(open_):
            if s not in found:
                # all of it fits
                threshold[s] += 1 << (low + BITS)
                open_.discard(s)
                continue
            b, tokens, n, before = found[s]
            rest[s] -= before
            threshold[s] += b << low
            if n == 1 or level == LEVELS - 1:
                # one document left at the border: taken if that is nearer the budget
                if tokens / 2 < rest[s]:
                    threshold[s] += 1 << low
                open_.discard(s)
    used = spark.createDataFrame([(s, whole[s], threshold[s], wanted[s][0], wanted[s][1], budget[s]) for s in wanted], "source string, whole int, threshold long, target_share double, max_repeats int, budget double")
    # bounded: one row a target, at most MAX_TARGETS
    copies = d.join(F.broadcast(used), "source").withColumn("copies", F.col("whole") + (F.col("place") < F.col("threshold")).cast("int")).where("copies > 0").select(key, "source", "tokens", "copies")
    per = d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens_available"))
    got = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"))
    shares = used.join(per, "source", "left").join(got, "source", "left").na.fill(0, ["documents", "tokens_available", "tokens_used", "most_copies"])
    everything = shares.agg(F.sum("tokens_used").alias("all_used"))
    # one row
    shares = shares.join(F.broadcast(everything)).withColumn("actual_share", F.when(F.col("all_used") > 0, F.col("tokens_used") / F.col("all_used")).otherwise(0.0))
    return copies, shares.select("source", "target_share", "max_repeats", "documents", "tokens_available", F.round("budget", 1).alias("tokens_budget"), "tokens_used", "most_copies", F.round("actual_share", 6).alias("actual_share"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    wanted = 3 * spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < wanted:
        docs = docs.repartition(wanted, "doc_id")
    return mixed(token_counts(docs, vocabulary_path()), table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document used, with its copies."""
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached."""
    return _mixed(spark, sf_dir)[1]


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
