"""Problem 2: freely written place names mapped to a canonical list.

The reference list is worked off in blocks of at most about ``MAX_NAMES``
entries (names and aliases).  A block is a symmetric-delete dictionary: every
canonical name is stored under the hashes of all strings left by dropping up to
``EDITS`` letters of its letters, skeleton and sound, as sorted arrays of 12
bytes a key (and a mark a key), and a written name meets all names within that distance by looking
up its own deletions.  A block is built once, on the driver, and broadcast; its
size in bytes is bounded by ``MAX_NAMES`` times the deletions of the longest
names, and checked.  What all blocks found for a spelling is decided together:
candidates are ranked by weighted Damerau-Levenshtein distance, then by the
frequency of the name in the reference, then by name.  Each distinct spelling is
worked on once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demesne.llm.text import deletes, letters, osa, plain, unlettered
from demesne.runtime import cut, lookup_join, spread, table, ws_trim

EDITS = 2
#: entries of one block
MAX_NAMES = 20_000
#: bytes of keys a block may hold; a name too long for deletions is stored and looked up as it is
MAX_BYTES = 256_000_000
LONGEST = 40
UNMATCHED = "UNMATCHED"

#: Qualifiers of townland names and their abbreviations.
QUALIFIERS = {
    "upper": ("upper", "upr", "up", "uppr", "uper"),
    "lower": ("lower", "lwr", "lr", "low", "lowr"),
    "north": ("north", "nth", "n", "no"),
    "south": ("south", "sth", "s", "so"),
    "east": ("east", "e", "est"),
    "west": ("west", "w", "wst"),
    "middle": ("middle", "mid", "mdl"),
    "big": ("big",),
    "little": ("little", "ltl"),
}
_QUALIFIER = {a: q for q, forms in QUALIFIERS.items() for a in forms}
#: Words put before or after a place that are no part of its name.
_LEAD = re.compile(r"^(?:(?:the )?(?:townland|townl\.?|twnld\.?|tld\.?|td\.?|lands?|village|town)(?: of)?|(?:late|formerly|now|native|born|resident|residing|living) (?:of|in|at)|late|formerly|near|nr\.?|at|in|of|from|by|the|part of|pt\.? of|pt\.)\s+")
_TAIL = re.compile(r"(?:[,;/]|\s|\()+(?:(?:civil )?parish(?: of)?|par\.?(?: of)?|p\.? of|co(?:unty|\.)?|barony(?: of)?|bar\.|union(?: of)?|d\.?e\.?d\.?|e\.?d\.?)(?:\s+[a-z' -]+)?\)?[\s.,]*$|[,\s]+(?:wicklow|wexford|carlow|ireland)[\s.,]*$")
#: Common first elements of Irish townland names.
FIRST = ["agha", "aghan", "anna", "ard", "ardna", "ath", "bal", "balla", "bally", "ballin", "baun", "bel", "boher", "boley", "caher", "cappa", "carn", "carrick", "carrig", "cashel", "castle", "clare", "clash", "clogh", "clon", "cloon", "clona", "cool", "coola", "cor", "corra", "creg", "cross", "crossna", "cul", "curra", "derry", "doon", "drom", "drum", "drumna", "dun", "dunna", "esker", "fin", "garry", "glen", "glas", "gort", "gorta", "inch", "incha", "inis", "kil", "kill", "kilna", "knock", "knockna", "lacken", "lag", "lea", "lis", "lisna", "loch", "lough", "maghera", "money", "moy", "mulla", "mullin", "park", "port", "rath", "rathna", "ros", "sallin", "shan", "shana", "slieve", "templ", "temple", "ti", "tober", "tom", "tomna", "toor", "tulla", "tully", "tir", "tubber"]


def _expansions(stub: str) -> list[str]:
    """First elements an abbreviation may stand for: its letters in their order, the first one first."""
    def within(word: str) -> bool:
        at = iter(word)
        return word[0] == stub[0] and all(c in at for c in stub)

    return [w for w in FIRST if within(w)]


@lru_cache(maxsize=65536)
def forms(text: str | None) -> tuple[tuple[str, str], ...]:
    """Readings of a written place: (letters of the name, qualifier or '').

    Case, accents, digits for letters, brackets, lead-in words, parish and
    county, punctuation and spacing are undone; an abbreviated first element
    gives several readings.
    """
    if not text:
        return ()
    t = re.sub(r"\s+", " ", plain(text)).strip()
    t = re.sub(r"\[[^\]]*\]?", " ", t)
    qualifier = ""

    def paren(m: re.Match) -> str:
        nonlocal qualifier
        q = _QUALIFIER.get(letters(m[1].strip()))
        qualifier = qualifier or q or ""
        return " "

    t = re.sub(r"\(([^)]*)\)?", paren, t)
    t = re.sub(r"\s+", " ", t).strip(" .,;:?*-")
    for _ in range(3):
        t = _TAIL.sub("", t).strip(" .,;:?*-")
    for _ in range(3):
        t = _LEAD.sub("", t).strip(" ,;:")
    t = " ".join(unlettered(w) for w in t.split(" "))
    words = [w for w in re.split(r"[\s,;/]+|-(?=\s)|(?<=\s)-", t) if w and w != "-"]
    pieces: list[str] = []
    for w in words:
        pieces += [x for x in re.split(r"-", w) if x]
    if len(pieces) > 1 and not qualifier:
        last, first = letters(pieces[-1]), letters(pieces[0])
        if last in _QUALIFIER:
            qualifier = _QUALIFIER[last]
            pieces = pieces[:-1]
        elif first in _QUALIFIER and len(first) < len(pieces[0]) + 1 and (pieces[0].endswith(".") or len(first) > 1):
            qualifier = _QUALIFIER[first]
            pieces = pieces[1:]
    if not pieces:
        return ()
    body = "".join(letters(p) for p in pieces)
    out = [(body, qualifier)] if body else []
    m = re.match(r"([a-z]{1,6}(?:'[a-z]{0,3})?)\.\s+([a-z].*)$", " ".join(pieces)) or re.match(r"([a-z]{1,5}')([a-z].*)$", " ".join(pieces))
    if m:
        stub, rest = m[1], letters(m[2])
        cuts = [(letters(stub), rest)]
        if "'" in stub:
            # the mark may stand in the middle of the first element: d'ry + sorur
            cuts += [(letters(stub) + rest[:k], rest[k:]) for k in (1, 2) if len(rest) > k + 2]
        for head, tail in cuts:
            out += [(w + tail, qualifier) for w in _expansions(head)]
    return tuple(dict.fromkeys(out))


def skeleton(word: str) -> str:
    """Letters told apart reliably: l, y and j read as i, doubled letters single."""
    s = word.replace("l", "i").replace("y", "i").replace("j", "i")
    return re.sub(r"(.)\1+", r"\1", s)


#: Respellings that sound alike, applied in this order.
SOUNDS = [("gh", "h"), ("ck", "k"), ("ch", "k"), ("kh", "k"), ("c", "k"), ("oo", "u"), ("(?:ea|ay|ai|ae|ey|ee|ie|y)", "i"), (r"(.)\1+", r"\1")]
SOUND_COST = 0.3


def sound(word: str) -> str:
    for pattern, to in SOUNDS:
        word = re.sub(pattern, to, word)
    return word


def limit(n: int) -> float:
    """Largest weighted distance accepted for a name of ``n`` letters."""
    return 0.0 if n < 4 else 1.0 if n < 8 else 2.0


#: (reading, whether its letters are a name's, distance, minus the frequency, name)
Found = tuple[int, bool, float, int, str]


class Dictionary:
    """Canonical names under the deletions of their letters, skeletons and sounds; (written, name, frequency) makes an entry."""

    def __init__(self, written: list[tuple[str, str, int]], edits: int = EDITS) -> None:
        self.edits = edits
        self.entries: list[tuple[str, str, str, int]] = []
        self.exact: dict[str, list[int]] = defaultdict(list)
        hashes, numbers = [], []
        for text, name, freq in written:
            pieces = plain(text).split()
            qualifier = ""
            if len(pieces) > 1 and letters(pieces[-1]) in _QUALIFIER:
                qualifier = _QUALIFIER[letters(pieces.pop())]
            body = "".join(letters(p) for p in pieces)
            if not body:
                continue
            k = len(self.entries)
            self.entries.append((body, qualifier, name, freq))
            self.exact[body].append(k)
            mine = self._stubs(body)
            hashes.append(mine)
            numbers.append(np.full(len(mine), k, dtype=np.int32))
        keys = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.numbers = keys[order], (np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int32))[order]
        # most deletions of a query are none of these: a mark a key's last bits spares looking for them
        self.mask = np.uint64((1 << max(10, int(8 * len(self.keys)).bit_length())) - 1)
        self.marks = np.zeros(int(self.mask) + 1, dtype=bool)
        self.marks[self.keys & self.mask] = True
        if self.keys.nbytes + self.numbers.nbytes + self.marks.nbytes > MAX_BYTES:
            raise ValueError("a block of names is larger than MAX_BYTES")

    def _stubs(self, body: str) -> np.ndarray:
        """Hashes of the deletions of the letters, of the skeleton and of the sound of a name."""
        edits = self.edits if len(body) <= LONGEST else 0
        stubs = deletes("+" + body, edits) | deletes(skeleton(body), edits) | deletes("*" + sound(body), edits)
        return np.fromiter((xxhash.xxh64_intdigest(x) for x in stubs), dtype=np.uint64, count=len(stubs))

    def _near(self, body: str) -> set[int]:
        stubs = self._stubs(body)
        stubs = stubs[self.marks[stubs & self.mask]]
        lo, hi = np.searchsorted(self.keys, stubs, "left"), np.searchsorted(self.keys, stubs, "right")
        return {int(k) for a, b in zip(lo[hi > lo], hi[hi > lo]) for k in self.numbers[a:b]}

    def found(self, text: str | None) -> list[Found]:
        """Names near any reading of a text."""
        out: list[Found] = []
        for reading, (body, qualifier) in enumerate(forms(text)):
            met = self.exact.get(body)
            exact = bool(met)
            for k in met or self._near(body):
                name_body, name_qualifier, name, freq = self.entries[k]
                most = limit(min(len(body), len(name_body)))
                d = 0.0 if exact else min(osa(body, name_body, most), SOUND_COST + osa(sound(body), sound(name_body), most))
                if d <= most:
                    if qualifier != name_qualifier:
                        d = float("inf") if qualifier and name_qualifier else d + 0.9  # a qualifier missing on one side
                    out.append((reading, exact, d, -freq, name))
        return out

    def best(self, text: str | None) -> tuple[str | None, float]:
        return decided(self.found(text))


def decided(found: list[Found]) -> tuple[str | None, float]:
    """(canonical name, weighted distance), or (None, distance) if none is near or several are equally."""
    # a reading whose letters are a name's is not held against other names
    exact = {reading for reading, e, *_ in found if e}
    near = sorted((d, f, name) for reading, e, d, f, name in found if (e or reading not in exact) and d < float("inf"))
    if not near:
        return None, float("inf")
    d, _, name = near[0]
    others = {n for e, _, n in near if e <= d and n != name}
    if d >= 0.9 and others and all(_stem(n) == _stem(name) for n in others):
        return None, d  # only qualifiers that were not written tell them apart
    return name, d


def _stem(name: str) -> str:
    pieces = plain(name).split()
    return " ".join(pieces[:-1]) if len(pieces) > 1 and letters(pieces[-1]) in _QUALIFIER else " ".join(pieces)


_MAPPED = T.StructType([T.StructField("raw", T.StringType()), T.StructField("name", T.StringType()), T.StructField("distance", T.DoubleType())])
_FOUND = T.StructType([T.StructField("raw", T.StringType()), T.StructField("reading", T.IntegerType()), T.StructField("exact", T.BooleanType()), T.StructField("d", T.DoubleType()), T.StructField("f", T.LongType()), T.StructField("name", T.StringType())])


def map_spellings(spellings: DataFrame, raw: str, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(raw, name, distance) of each distinct non-null spelling; name null where none is near.

    ``names``: (name, freq); ``aliases``: (alias, canonical_name).  Null and
    blank names are left out; repeated names add up; an alias of no known name
    is ignored.  The answer is the same however many blocks the list makes.
    """
    spark = spellings.sparkSession
    distinct = cut(spread(spellings.select(F.col(raw).alias("raw")).where("raw is not null").distinct(), "raw"))
    names = names.where("name is not null and trim(name) <> ''").groupBy("name").agg(F.sum("freq").cast("long").alias("freq"))
    known = aliases.where("trim(alias) <> ''").select("alias", F.col("canonical_name").alias("name")).distinct().join(names, "name").select(F.col("alias").alias("written"), "name", "freq")
    entries = cut(names.select(F.col("name").alias("written"), "name", "freq").unionByName(known))
    blocks = max(1, -(-entries.count() // MAX_NAMES))
    parts = []
    for b in range(blocks):
        # bounded: about MAX_NAMES entries
        block = Dictionary([tuple(r) for r in entries.where(F.pmod(F.xxhash64("written", "name"), F.lit(blocks)) == b).collect()])
        shared = spark.sparkContext.broadcast(block)
        if blocks == 1:

            def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    best = [shared.value.best(t) for t in batch["raw"]]
                    yield pd.DataFrame({"raw": batch["raw"], "name": [x[0] for x in best], "distance": [x[1] for x in best]})

            return distinct.mapInPandas(run, _MAPPED)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([(t, *x) for t in batch["raw"] for x in shared.value.found(t)], columns=["raw", "reading", "exact", "d", "f", "name"])

        parts.append(distinct.mapInPandas(search, _FOUND))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)

    @F.pandas_udf("name string, distance double")
    def decide(found: pd.Series) -> pd.DataFrame:
        got = [decided([(r["reading"], r["exact"], r["d"], r["f"], r["name"]) for r in (x if x is not None else ())]) for x in found]
        return pd.DataFrame({"name": [n for n, _ in got], "distance": [d for _, d in got]})

    # the names near one spelling: a handful
    found = every.groupBy("raw").agg(F.collect_list(F.struct("reading", "exact", "d", "f", "name")).alias("found"))
    return distinct.join(found, "raw", "left").withColumn("m", decide("found")).select("raw", "m.name", "m.distance")


def canonical_names(townland: DataFrame) -> DataFrame:
    """(name, freq): names of source ``json`` and how many rows carry each."""
    return townland.where(F.lower(ws_trim(F.col("source"))) == "json").groupBy("name").agg(F.count(F.lit(1)).alias("freq"))


def latest(mentions: DataFrame, keep: list[str]) -> DataFrame:
    """One row an id: of several deliveries the one updated last (ties: the greatest values)."""
    return mentions.where("id is not null").groupBy("id").agg(F.max(F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), *keep)).alias("r")).select("id", *[f"r.{k}" for k in keep])


def place_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, raw_place, name, distance) of mentions whose place is written and not exactly canonical."""
    names = canonical_names(table(spark, sf_dir, "townland"))
    rows = latest(table(spark, sf_dir, "source_mentions"), ["raw_place"]).where("raw_place is not null").where(ws_trim(F.col("raw_place")) != "")
    rows = rows.join(names.select(F.col("name").alias("raw_place")), "raw_place", "left_anti")
    mapped = map_spellings(rows, "raw_place", names, table(spark, sf_dir, "townland_aliases"))
    return lookup_join(rows, mapped.withColumnRenamed("raw", "raw_place"), ["raw_place"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = place_mentions(spark, sf_dir)
    return found.select(F.col("id").alias("mention_id"), F.coalesce("name", F.lit(UNMATCHED)).alias("townland_name"))


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of spellings no canonical name is near, with their mentions."""
    misses = place_mentions(spark, sf_dir).where("name is null")
    return misses.groupBy("raw_place").agg(F.count(F.lit(1)).alias("mentions"))


QUERIES = {"p2_found": p2_found, "p2_unmatched": p2_unmatched}
SQL: dict[str, str] = {}
