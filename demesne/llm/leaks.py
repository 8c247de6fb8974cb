"""Problem 8: passages of held-out test items inside a corpus.

Text is reduced to its words (markup, entities, layout, hyphenation, page marks,
case and punctuation undone) and read as one stream of letters, so that word
breaks don't matter.  At every word start of every document a window of the
stream is mapped by CGK random walks, which turn edit distance into Hamming
distance, and a few sampled positions of the walk are hashed; items are indexed
by the same hashes at every word start.  The number of repetitions follows from
the recall wanted (``repetitions``).  Every hit is verified exactly: the run of
item words is followed in both directions, word by word within its slips, and
counts from ``MIN_WORDS`` words on.  Before that the hits are followed together,
as arrays, to their first word that differs; those that end there short of the
words asked, where no joining or parting of words could go on, are done.

One pass over the documents, without a shuffle.  The items are the stated query
set: their letters are counted, and they are worked off in blocks of at most
about ``BLOCK_CHARS`` letters.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demesne.llm.text import DIGITS, osa, plain
from demesne.runtime import table

MIN_WORDS = 20
STEPS = 72
SAMPLED = 10
#: the design point: windows of a run whose walks agree at this share of their steps, the windows of the
#: shortest run counted that lie wholly inside it, and the recall its runs are to reach
AGREE, WINDOWS, TARGET_RECALL = 0.71, 13, 0.99
WALKS = 3
#: letters of items in one index; a single longer item is not cut
BLOCK_CHARS = 8_000_000
CHUNK = 400_000
#: hits followed at a time
MOST_HITS = 2_000_000
SEED = 20240


def expected_recall(agree: float, windows: int, repeats: int) -> float:
    """Chance that a run is met if its windows' walks agree at a share ``agree`` of their steps."""
    return 1 - (1 - agree**SAMPLED) ** (repeats * windows)


def repetitions(agree: float = AGREE, windows: int = WINDOWS, target: float = TARGET_RECALL) -> int:
    """Fewest repetitions that reach the recall ``target``."""
    return math.ceil(math.log(1 - target) / (windows * math.log(1 - agree**SAMPLED)))


#: hashes a walk
TABLES = -(-repetitions() // WALKS)

_BLOCK_TAG = re.compile(r"</?(?:p|br|div|h\d|li|ul|ol|tr|td|th|table|body|html|head|hr|section|article|blockquote|pre|title)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-z][^<>]*>|<!--.*?-->", re.I | re.S)
_PAGE = re.compile(r"[\[(]\s*(?:p|pp|pg|page|fol|folio|f)\b\.?\s*\d*\s*[\])]|^\s*(?:page|p\.)\s*\d+\s*$", re.I | re.M)
_WORD = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """Words of a text as compared: see the module's text."""
    if not text:
        return []
    t = html.unescape(html.unescape(text)) if "&" in text else text
    if "<" in t:
        t = _TAG.sub("", _BLOCK_TAG.sub(" ", t))
    t = re.sub("[­​‌‍⁠﻿]", "", t)
    t = re.sub(r"(?<=\w)[-‐‑]\s*\n\s*(?=\w)", "", t)
    t = _PAGE.sub(" ", t)
    t = re.sub(r"(?<=[a-z])'(?=[a-z])", "", plain(t))
    return _WORD.findall(t)


_CODE = np.zeros(128, dtype=np.uint8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
    _CODE[ord(_c)] = _i + 1


class Embedding:
    """CGK walks with sampled positions, the same on every machine."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, size=(WALKS, STEPS, 64)).astype(np.int64)
        self.at = [[set(rng.choice(STEPS, SAMPLED, replace=False).tolist()) for _ in range(TABLES)] for _ in range(WALKS)]
        self.mult = np.uint64(0x9E3779B97F4A7C15)

    def keys(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(table, hashes of all windows) for each repetition; ``codes`` must be padded by STEPS zeros."""
        for w in range(WALKS):
            pos = starts.copy()
            acc = [np.full(len(starts), t + 1 + 100 * w, dtype=np.uint64) for t in range(TABLES)]
            for j in range(STEPS):
                c = codes[pos]
                for t in range(TABLES):
                    if j in self.at[w][t]:
                        acc[t] = (acc[t] ^ c.astype(np.uint64)) * self.mult
                        acc[t] ^= acc[t] >> np.uint64(29)
                pos += self.moves[w, j][c]
            for t in range(TABLES):
                yield w * TABLES + t, acc[t]


def stream(texts_words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of all texts, each followed by STEPS zeros; of each word its start, text and number."""
    parts, starts, owner, number, at = [], [], [], [], 0
    pad = "\x00" * STEPS
    for k, ws in enumerate(texts_words):
        n = np.fromiter(map(len, ws), dtype=np.int64, count=len(ws))
        starts.append(at + np.concatenate([[0], np.cumsum(n)[:-1]]) if len(ws) else n)
        owner.append(np.full(len(ws), k, dtype=np.int64))
        number.append(np.arange(len(ws), dtype=np.int64))
        parts += [*ws, pad]
        at += int(n.sum()) + STEPS
    codes = _CODE[np.frombuffer("".join([*parts, pad]).encode("ascii"), dtype=np.uint8)]
    join = lambda a: np.concatenate(a).astype(np.int64) if a else np.zeros(0, dtype=np.int64)
    return codes, join(starts), join(owner), join(number)


@lru_cache(maxsize=1 << 18)
def slip(a: str, b: str) -> bool:
    """The same word within a slip or two of its letters; numbers must be equal."""
    if a == b:
        return True
    if a.isdigit() and b.isdigit():
        return False
    if not (a.isalpha() and b.isalpha()):
        a, b = a.translate(DIGITS), b.translate(DIGITS)
        if a == b:
            return True
    n = max(len(a), len(b))
    most = 0 if n <= 2 else 1 if n <= 7 else 2
    return abs(len(a) - len(b)) <= most and osa(a, b, most, weighted=False) <= most


def run_length(doc: list[str], p: int, item: list[str], q: int, step: int) -> int:
    """Item words from ``q`` on (``step`` 1) or back (-1) that the document has from ``p`` on, words joined or parted allowed."""
    n = 0
    while 0 <= p < len(doc) and 0 <= q < len(item):
        if slip(doc[p], item[q]):
            p, q, n = p + step, q + step, n + 1
            continue
        joined = lambda ws, i: (ws[i] + ws[i + 1] if step > 0 else ws[i - 1] + ws[i]) if 0 <= i + step < len(ws) else ""
        d, w = joined(doc, p), joined(item, q)
        if d and slip(d, item[q]) and len(d) > 3:
            p, q, n = p + 2 * step, q + step, n + 1
        elif w and slip(doc[p], w) and len(w) > 3:
            p, q, n = p + step, q + 2 * step, n + 2
        else:
            break
    return n


class ItemIndex:
    def __init__(self, items: tuple[tuple[int, str], ...]) -> None:
        self.embedding = Embedding()
        self.ids = [i for i, _ in items]
        self.words = [words(t) for _, t in items]
        codes, starts, owner, number = stream(self.words)
        self.owner, self.number = owner, number
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _, keys in self.embedding.keys(codes, starts):
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 20, dtype=bool)
            seen[keys & np.uint64((1 << 20) - 1)] = True
            self.tables.append((keys[order], order, seen))

    def hits(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item word) pairs that share a hash in some repetition, in slices of bounded size."""
        found, counts = [], np.zeros(len(starts), dtype=np.int64)
        for t, keys in self.embedding.keys(codes, starts):
            sorted_keys, order, seen = self.tables[t]
            at = np.flatnonzero(seen[keys & np.uint64((1 << 20) - 1)])
            lo, hi = np.searchsorted(sorted_keys, keys[at], "left"), np.searchsorted(sorted_keys, keys[at], "right")
            some = hi > lo
            at, lo, n = at[some], lo[some], (hi - lo)[some]
            counts[at] += n
            found.append((at, lo, n, order))
        # windows of an opening that many items share have many hits: slices are cut by hits, not by windows
        ends = np.cumsum(counts)
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + MOST_HITS, "right")))
            got = []
            for at, lo, n, order in found:
                a, b = np.searchsorted(at, first), np.searchsorted(at, last)
                if b > a:
                    k = n[a:b]
                    off = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    got.append(np.repeat(at[a:b], k) << 32 | order[np.repeat(lo[a:b], k) + off])
            if got:
                both = np.unique(np.concatenate(got))
                yield both >> 32, both & 0xFFFFFFFF
            first = last

    def follow(self, x: np.ndarray, y: np.ndarray, doc: Flat, step: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(words followed without joining or parting, at most ``least``; whether the run may go on beyond)."""
        n, on = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
        alive = np.arange(len(x))
        p, q = x.copy(), y.copy()
        if step < 0:
            p, q = p - 1, q - 1
        item = self.flat
        while len(alive):
            # the rims hold word lengths and owners of their own, so that every run ends there
            inside = (doc.owner[p] == doc.owner[x[alive]]) & (item.owner[q] == item.owner[y[alive]])
            alive, p, q = alive[inside], p[inside], q[inside]
            same = doc.ids[p] == item.ids[q]
            a, b = doc.lengths[p], item.lengths[q]
            longest = np.maximum(a, b)
            near = np.flatnonzero(~same & (np.abs(a - b) <= np.where(longest <= 2, 0, np.where(longest <= 7, 1, 2))) & (longest > 2))
            if len(near):
                pairs, back = np.unique(doc.ids[p[near]] << 32 | item.ids[q[near]], return_inverse=True)
                words = doc.vocabulary
                same[near] = np.array([slip(words[k >> 32], words[k & 0xFFFFFFFF]) for k in pairs.tolist()], dtype=bool)[back]
            ended, c, d = alive[~same], p[~same], q[~same]
            joined = doc.joined(c, step, item.ids[d], item.lengths[d])
            parted = item.joined(d, step, doc.ids[c], doc.lengths[c])
            on[ended] = joined | parted
            n[alive[same]] += 1
            full = same & (n[alive] >= least)
            on[alive[full]] = True
            more = same & ~full
            alive, p, q = alive[more], p[more] + step, q[more] + step
        return n, on

    def leaks(self, texts: list[str | None], least: int) -> list[tuple[int, int, int]]:
        """(text number, item id, longest run) of all runs of at least ``least`` words."""
        doc_words = [words(t) for t in texts]
        codes, starts, owner, number = stream(doc_words)
        ids, vocabulary = pd.factorize(np.array([w for ws in (*doc_words, *self.words) for w in ws], dtype=object))
        doc = Flat(ids[: len(starts)], doc_words, owner, vocabulary)
        self.flat = Flat(ids[len(starts) :], self.words, self.owner, vocabulary)
        out: dict[tuple[int, int], int] = {}
        covered: dict[tuple[int, int, int], int] = {}  # by text, item and offset: end of the run followed last
        for a in range(0, len(starts), CHUNK):
            for win, it in self.hits(codes, starts[a : a + CHUNK]):
                # the hit before on the same diagonal, with an equal word, has this run
                at = win << 32 | it
                before = at - ((1 << 32) + 1)
                k = np.minimum(np.searchsorted(at, before), len(at) - 1)
                x, y = win + a + 1, it + 1
                again = (at[k] == before) & (doc.ids[x - 1] == self.flat.ids[y - 1]) & (doc.owner[x - 1] == doc.owner[x]) & (self.flat.owner[y - 1] == self.flat.owner[y])
                x, y = x[~again], y[~again]
                ahead, on = self.follow(x, y, doc, 1, least)
                behind, on_back = self.follow(x, y, doc, -1, least)
                good = (ahead > 0) & (on | on_back | (ahead + behind >= least)) | on
                for w, i in zip((x[good] - 1).tolist(), (y[good] - 1).tolist()):
                    k, item, p, q = int(owner[w]), int(self.owner[i]), int(number[w]), int(self.number[i])
                    if p < covered.get((k, item, p - q), -1):
                        continue
                    d, v = doc_words[k], self.words[item]
                    n = run_length(d, p, v, q, 1)
                    if not n:
                        continue
                    covered[(k, item, p - q)] = p + n
                    n += run_length(d, p - 1, v, q - 1, -1)
                    if n >= least:
                        key = (k, self.ids[item])
                        out[key] = max(n, out.get(key, 0))
        return [(k, i, n) for (k, i), n in out.items()]


class Flat:
    """Words of several texts one after the other, with a rim at either end: number, length and text of each."""

    def __init__(self, ids: np.ndarray, texts: list[list[str]], owner: np.ndarray, vocabulary: np.ndarray) -> None:
        self.vocabulary = vocabulary
        rim = np.full(1, -1, dtype=np.int64)
        self.ids = np.concatenate([rim, ids, rim]).astype(np.int64)
        self.owner = np.concatenate([rim, owner, rim])
        lengths = np.fromiter((len(w) for ws in texts for w in ws), dtype=np.int64, count=len(ids))
        self.lengths = np.concatenate([rim * 1000, lengths, rim * 1000])

    def joined(self, at: np.ndarray, step: int, word: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words at ``at`` and ``at + step``, written as one, may be ``word`` of that ``length``."""
        fits = np.abs(self.lengths[at] + self.lengths[at + step] - length) <= 2
        some = np.flatnonzero(fits)
        if len(some) and len(self.vocabulary) < 1 << 21:
            a = at[some] if step > 0 else at[some] - 1
            triples, back = np.unique((self.ids[a] << 42) | (self.ids[a + 1] << 21) | word[some], return_inverse=True)
            v, low = self.vocabulary, (1 << 21) - 1
            fits[some] = np.array([slip(v[k >> 42] + v[k >> 21 & low], v[k & low]) for k in triples.tolist()], dtype=bool)[back]
        return fits


@lru_cache(maxsize=1)
def item_index(items: tuple[tuple[int, str], ...]) -> ItemIndex:
    """The index of a block, kept by the worker for its next tasks."""
    return ItemIndex(items)


_LEAK = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("words", T.IntegerType())])


def leaked(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, words): documents with at least ``least`` successive words of an item, and the longest run.

    Null and blank texts, and items of fewer words, leak nothing; a document or
    item id that repeats counts once; texts are read whole, whatever their length.
    """
    spark = documents.sparkSession
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    letters = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-letters // BLOCK_CHARS))
    docs = documents.where("doc_id is not null and length(trim(text)) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = 3 * spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < wanted:
        docs = docs.repartition(wanted, "doc_id")
    results = []
    for b in range(blocks):
        # bounded: about BLOCK_CHARS letters
        block = tuple((r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect())
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = item_index(shared.value)
            for batch in batches:
                ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
                rows, at = [], 0
                while at < len(ids):
                    end, size = at, 0
                    while end < len(ids) and (end == at or size + len(texts[end]) < 2_000_000):
                        size += len(texts[end])
                        end += 1
                    rows += [(ids[at + k], i, n) for k, i, n in index.leaks(texts[at:end], least)]
                    at = end
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words"])

        results.append(docs.mapInPandas(search, _LEAK))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of documents it leaked into and the longest run of its words."""
    found = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    per = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest"))
    items = table(spark, sf_dir, "eval_items").select("item_id", "category").distinct()
    return items.join(per, "item_id", "left").select("item_id", "category", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), F.coalesce("longest", F.lit(0)).alias("longest"))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
SQL: dict[str, str] = {}
