"""The best candidates of every row by strategies met, found block by block of what rows hold, without listing all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from demesne.operators.er import FUZZY, MAX_CANDIDATES, YEARS
from demesne.runtime import cut, release, spread

#: Distinct contents of either side that are compared at a time.
LEFT, RIGHT = 1_000, 4_000
CONTENT = ("forename", "surname", "place", "year")
_TEXTS = ("name", "surname", "initial", "phonetic", "place")
_STRATEGIES = 6
#: Pairs of contents from which two blocks are dealt over the tasks.
SMALL = 100_000
#: Pairs of distinct names, and of blocks, whose names are measured together; pairs of names measured at a time.
NAMES, BLOCKS, STEP = 50_000, 500, 20_000
#: Rank of a pair that doesn't count; ranks are below 2^18, and times RIGHT below it.
_NEVER = np.int32(2**31 - 1)


def _holding(xs: list[str], ys: list[str]) -> np.ndarray:
    """Which of the distinct ``xs`` holds which of ``ys`` or is held by it; empty ones hold and are held by nothing."""
    out = np.zeros((len(xs), len(ys)), dtype=bool)
    for short, long, of in ((xs, ys, out), (ys, xs, out.T)):
        text, starts = "\n".join(long), np.cumsum([0] + [len(v) + 1 for v in long])
        for k, v in enumerate(short):
            at = text.find(v) if v else -1
            while at >= 0:
                hit = int(np.searchsorted(starts, at, "right")) - 1
                of[k, hit] = True
                at = text.find(v, int(starts[hit + 1]))
    return out


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in texts], dtype=np.int64)
    out = np.zeros((len(texts), int(size.max(initial=0))), dtype=np.int32)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<i4")
    return out, size


def _distances(sides: list[tuple[list[str], list[str]]]) -> list[np.ndarray]:
    """Levenshtein distances of all texts of the first list to all of the second, of many small pairs of lists together."""
    (xs, size_x), (ys, size_y) = (_coded([v for s in sides for v in s[k]]) for k in (0, 1))
    at_x, at_y = (np.cumsum([0] + [len(s[k]) for s in sides]) for k in (0, 1))
    i = np.concatenate([np.repeat(np.arange(at_x[k], at_x[k + 1]), len(s[1])) for k, s in enumerate(sides)])
    j = np.concatenate([np.tile(np.arange(at_y[k], at_y[k + 1]), len(s[0])) for k, s in enumerate(sides)])
    out = np.empty(len(i), dtype=np.int16)
    order = np.argsort(size_x[i], kind="stable")
    for begin in range(0, len(order), STEP):
        part = order[begin : begin + STEP]
        n, m = size_x[i[part]], size_y[j[part]]
        a, b = (np.ascontiguousarray(c[k[part], : int(s.max())].T) for c, k, s in ((xs, i, n), (ys, j, m)))
        row = np.repeat(np.arange(len(b) + 1, dtype=np.int16)[:, None], len(part), axis=1)
        last = np.empty_like(row)
        found = np.where(n == 0, m, 0)
        for k in range(len(a)):
            row, last = last, row
            row[0] = k + 1
            np.minimum(last[1:] + np.int16(1), last[:-1] + (b != a[k]), out=row[1:])
            for c in range(len(b)):
                np.minimum(row[c + 1], row[c] + np.int16(1), out=row[c + 1])
            ends = np.nonzero(n == k + 1)[0]
            found[ends] = row[m[ends], ends]
        out[part] = found
    ends = np.cumsum([len(x) * len(y) for x, y in sides])[:-1]
    return [d.reshape(len(x), len(y)) for d, (x, y) in zip(np.split(out, ends), sides)]


class _Codes:
    """The texts of ``a`` and of ``b`` as numbers."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        code, texts = pd.factorize(np.concatenate([a, b]))
        none = np.nonzero(texts == "")[0]
        self.texts, self.none, self.i, self.j = texts, none[0] if len(none) else -1, code[: len(a)], code[len(a) :]

    def same(self) -> np.ndarray:
        return (self.i[:, None] == self.j[None, :]) & (self.i != self.none)[:, None]

    def distinct(self) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
        (x, of_x), (y, of_y) = np.unique(self.i, return_inverse=True), np.unique(self.j, return_inverse=True)
        return self.texts[x].tolist(), of_x, self.texts[y].tolist(), of_y


def _ranks(codes: dict[str, _Codes], years: tuple[np.ndarray, np.ndarray], names: tuple, distance: np.ndarray, sound: bool) -> np.ndarray:
    """Rank of every pair, the least the best: by strategies met, then by likeness of the names, then the same place first."""
    xs, of_x, ys, of_y = names
    size_x, size_y = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    apart = distance * 1.0 / np.maximum(np.maximum.outer(size_x, size_y), 1)
    named = (size_x > 0)[:, None] & (size_y > 0)[None, :]
    met = (named & (distance == 0)).astype(np.int32) + (named & (100.0 * (1 - apart) >= FUZZY))
    rank = ((_STRATEGIES - met) * 10_001 + np.floor(apart * 10_000 + 0.5).astype(np.int32)).astype(np.int32)[of_x][:, of_y]

    initial, phonetic, place = (codes[c].same() for c in ("initial", "phonetic", "place"))
    met = (codes["surname"].same() & initial).astype(np.int32) + phonetic + place + (np.abs(years[0][:, None] - years[1][None, :]) <= YEARS)
    if sound:
        xs, of_x, ys, of_y = codes["place"].distinct()
        met += _holding(xs, ys)[of_x][:, of_y] & ~place
    rank = (rank - met * 10_001) * 2 + ~place
    if not sound:
        # met by their sound already
        rank[phonetic & initial] = _NEVER
    return rank


def _met(held: list[tuple[dict, dict, list[list[str]], bool]], most: int) -> Iterator[tuple[int, list[str]]]:
    """The best of pairs of blocks."""
    codes = [{c: _Codes(a[c], b[c]) for c in _TEXTS} for a, b, _, _ in held]
    names = [c["name"].distinct() for c in codes]
    for (a, b, ids, sound), code, name, distance in zip(held, codes, names, _distances([(x, y) for x, _, y, _ in names])):
        yield from _best(a["key"], _ranks(code, (a["year"], b["year"]), name, distance, sound), ids, most)


def _best(keys: np.ndarray, rank: np.ndarray, ids: list[list[str]], most: int) -> Iterator[tuple[int, list[str]]]:
    """Of every row its key and its best records, each its rank in six digits before its id; of one rank by id."""
    order = sorted(range(len(ids)), key=lambda k: ids[k][0])
    ids = [ids[k] for k in order]
    rank = rank[:, order]
    if len(ids) > most:
        # what is among the best is held by the ``most`` contents whose first rows are
        full = np.where(rank == _NEVER, _NEVER, rank * len(ids) + np.arange(len(ids), dtype=np.int32))
        at = np.argpartition(full, most - 1, axis=1)[:, :most]
        at = np.take_along_axis(at, np.argsort(np.take_along_axis(full, at, axis=1), axis=1), axis=1)
    else:
        at = np.argsort(rank, axis=1, kind="stable")
    ranks = np.take_along_axis(rank, at, axis=1)
    for key, row, cols in zip(keys.tolist(), ranks.tolist(), at.tolist()):
        found: list[str] = []
        last = -1
        for r, k in zip(row, cols):
            if r == _NEVER or (r != last and len(found) >= most):
                break
            last = r
            found += [f"{r:06d}{i}" for i in ids[k]]
        if found:
            yield key, sorted(found)[:most]


def best_candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, named: Callable[[DataFrame], DataFrame], most: int = MAX_CANDIDATES) -> DataFrame:
    """(left_id, right_id, n, apart, rank): the ``most`` best records of every row of ``left``.

    Both sides have a unique id and CONTENT, texts filled or empty; ``named`` adds name and phonetic.  Candidates share
    the sound and the initial, or the place and the surname's first letter.  Rows of one content are ranked alike, so
    contents are compared, each with its ``most`` first ids; the best of each block are merged.
    """
    def keyed(df: DataFrame) -> DataFrame:
        letter = F.substring("surname", 1, 1)
        sound = F.when((F.col("phonetic") != "") & (F.col("initial") != ""), F.concat_ws("|", "phonetic", "initial"))
        place = F.when((F.col("place") != "") & (letter != ""), F.concat_ws("|", "place", letter))
        return df.select("*", F.explode(F.array(F.struct(F.lit(True).alias("sound"), sound.alias("k")), F.struct(F.lit(False).alias("sound"), place.alias("k")))).alias("x")).select(*df.columns, "x.*").where("k is not null")

    def blocks(df: DataFrame, key: str, size: int, s: str) -> DataFrame:
        at = F.floor((F.row_number().over(W.partitionBy("sound", "k").orderBy("name", key)) - 1) / size)
        df = keyed(df).withColumn("year", F.coalesce(F.col("year").cast("double"), F.lit(float("nan")))).withColumn("block", at)
        # bounded: LEFT or RIGHT rows a block
        return df.groupBy("sound", "k", "block").agg(*[F.collect_list(c).alias(f"{c}_{s}") for c in (*_TEXTS, "year", key)]).withColumnRenamed("block", f"block_{s}")

    # without one of them no candidate
    some = "surname <> '' and (forename <> '' or place <> '')"
    full = lambda df: named(df).withColumn("initial", F.substring("forename", 1, 1)).drop("forename")
    first = right.where(some).select(right_id, *CONTENT).withColumn("__n", F.row_number().over(W.partitionBy(*CONTENT).orderBy(right_id))).where(F.col("__n") <= most)
    # bounded: ``most`` ids
    held = cut(first.groupBy(*CONTENT).agg(F.sort_array(F.collect_list(right_id)).alias("ids")))
    release(right.sparkSession)
    rows = left.where(some).select(left_id, *CONTENT, F.min(left_id).over(W.partitionBy(*CONTENT)).alias("key"))

    a, b = blocks(full(rows.where(F.col("key") == F.col(left_id)).drop(left_id)), "key", LEFT, "a"), blocks(full(held), "ids", RIGHT, "b")
    met = a.join(b, ["sound", "k"])
    # only large pairs of blocks are dealt out; the many others stay where their key put them
    large = F.size("surname_a") * F.size("surname_b") > SMALL
    met = met.where(~large).unionByName(spread(met.where(large), "k", "block_a", "block_b")).drop("k", "block_a", "block_b")
    kind = left.schema[left_id].dataType
    key = to_arrow_type(kind)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = [], 0
        for x in batches:
            for r in range(x.num_rows):
                of = lambda c: x.column(c)[r].values  # noqa: B023, E731
                a, b = ({c: of(f"{c}_{s}").to_numpy(zero_copy_only=False) for c in (*_TEXTS, "year")} for s in "ab")
                a["key"] = of("key_a").to_numpy(zero_copy_only=False)
                held.append((a, b, of("ids_b").to_pylist(), x.column("sound")[r].as_py()))
                names += len(a["name"]) * len(b["name"])
                if names >= NAMES or len(held) >= BLOCKS:
                    yield batch(held)
                    held, names = [], 0
        if held:
            yield batch(held)

    def batch(held: list) -> pa.RecordBatch:
        found = list(_met(held, most))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], key), pa.array([v for _, v in found], pa.list_(pa.string()))], ["key", "best"])

    # bounded: ``most`` a block
    merged = met.mapInArrow(best, f"key {kind.simpleString()}, best array<string>").groupBy("key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, most).alias("best"))
    out = rows.select(left_id, "key").join(merged, "key").select(left_id, F.posexplode("best").alias("at", "x"))
    value = F.floor(F.substring("x", 1, 6).cast("int") / 2).cast("int")
    n = (_STRATEGIES - F.floor(value / 10_001)).cast("int")
    return out.select(left_id, F.expr("substring(x, 7)").alias(right_id), n.alias("n"), (value % 10_001 / 10_000).alias("apart"), (F.col("at") + 1).alias("rank"))
