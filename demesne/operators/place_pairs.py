"""Pairs of place rows of one block, scored as arrays: what distinct texts decide is worked out once for all rows that hold them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demesne.functions.geometry import IRELAND, bounds_col, iou, polygon_parts
from demesne.functions.similarity import jaro_winkler
from demesne.operators.er import edits
from demesne.runtime import cut, spread

#: Rows of one block that are compared at a time.
ROWS = 1_000
#: So many times as many with outlines, as only the pairs of like names are worked out; of these ``PAIRS`` at a time.
WIDER, PAIRS = 4, 400_000
IDS = ("osm_id", "osi_id", "vrti_id", "kg_uri", "logainm_id")
_TEXTS = ("name", "name_gaelic", "civil_parish", "barony", *IDS)
_BOX = ("west", "south", "east", "north")
#: Stands for a missing text; not the zero character, which numpy drops.
_NONE = "\x01none"


def _ratio(xs: list[str], ys: list[str]) -> np.ndarray:
    size = np.maximum(np.maximum.outer([len(x) for x in xs], [len(y) for y in ys]), 1)
    return 100.0 * (1 - edits(xs, ys) / size) / 100


class _Pairs:
    """Rows ``a`` against rows ``b``, dicts of arrays."""

    def __init__(self, a: dict, b: dict):
        self.a, self.b = a, b

    def same(self, c: str) -> np.ndarray | bool:
        codes, texts = pd.factorize(np.concatenate([self.a[c], self.b[c]]))
        x, y = codes[: len(self.a[c])], codes[len(self.a[c]) :]
        if not len(set(x) & set(y) - set(np.nonzero(texts == _NONE)[0])):
            return False
        return (x[:, None] == y[None, :]) & (self.a[c] != _NONE)[:, None]

    def by_text(self, c: str, of: Callable[[list[str], list[str]], np.ndarray]) -> np.ndarray:
        (i, xs), (j, ys) = pd.factorize(self.a[c]), pd.factorize(self.b[c])
        known = of(list(xs), list(ys)).astype(np.float64)
        known[xs == _NONE] = 0.0
        known[:, ys == _NONE] = 0.0
        return known[i][:, j]


_FIELDS = [("id_a", pa.int64()), ("id_b", pa.int64()), ("score", pa.float64()), ("merge", pa.bool_())]
_likeness = lru_cache(200_000)(jaro_winkler)
_parts = lru_cache(2_000)(polygon_parts)


@lru_cache(50_000)
def _overlap(v: str, w: str) -> float | None:
    return iou(v, w, IRELAND, _parts)


def _decided(a: np.ndarray, b: np.ndarray, score: np.ndarray, merge: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in (np.minimum(a, b), np.maximum(a, b), score, merge)], schema=pa.schema(_FIELDS))


def _merged(score: np.ndarray, parish: np.ndarray | bool) -> np.ndarray:
    return (score >= 0.9) | ((score >= 0.6) & parish)


def _scores(a: dict, b: dict, own: bool) -> Iterator[pa.RecordBatch]:
    p = _Pairs(a, b)
    keep = a["id"][:, None] < b["id"][None, :] if own else a["id"][:, None] != b["id"][None, :]
    x, y = a["area_sqm"][:, None], b["area_sqm"][None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        area = np.nan_to_num(np.fmin(x, y) / np.fmax(x, y), nan=0.0)
    parish = p.same("civil_parish")
    score = 0.35 * p.by_text("name", _ratio) + 0.10 * p.by_text("name_gaelic", _ratio) + 0.15 * parish + 0.10 * p.same("barony") + 0.10 * area
    for c in IDS:
        shared = p.same(c)
        if shared is not False:
            score = np.where(shared, 0.99, score)
    score = np.floor(score * 10000 + 0.5) / 10000
    merge = _merged(score, parish)
    keep &= merge | (score >= 0.35)
    i, j = np.nonzero(keep)
    yield _decided(a["id"][i], b["id"][j], score[i, j], merge[i, j])


class _Text:
    """One text of rows ``a`` and ``b``, asked for single pairs of rows."""

    def __init__(self, a: dict, b: dict, c: str):
        (self.i, xs), (self.j, ys) = pd.factorize(a[c]), pd.factorize(b[c])
        self.xs, self.ys = list(xs), list(ys)
        at = {v: k for k, v in enumerate(self.xs) if v != _NONE}
        self.i_of_j = np.array([at.get(v, -1) for v in self.ys], dtype=np.int64)
        self.shared = bool((self.i_of_j >= 0).any())
        self.filled = np.array([v != _NONE for v in self.xs], dtype=bool), np.array([v != _NONE for v in self.ys], dtype=bool)
        self.known: dict[int, float] = {}

    def same(self, x: np.ndarray, y: np.ndarray) -> np.ndarray | bool:
        return self.i[x] == self.i_of_j[self.j][y] if self.shared else False

    def oriented(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, of: Callable[[str, str], float | None]) -> np.ndarray:
        """``of`` the text of the lower id (``first``: that of ``a``) and that of the higher; nought without a text."""
        n = len(self.ys)
        i, j = self.i[x], self.j[y]
        key = (i.astype(np.int64) * n + j) * 2 + first
        if len(self.xs) * n <= 5 * len(key):
            # few texts: a place for each two
            value = np.zeros(2 * len(self.xs) * n, dtype=bool)
            value[key] = True
            keys, back = np.nonzero(value)[0], None
        else:
            keys, back = np.unique(key, return_inverse=True)
        values = np.array([self._value(k, n, of) for k in keys.tolist()], dtype=np.float64)
        if back is not None:
            return values[back]
        table = np.zeros(len(value))
        table[keys] = values
        return table[key]

    def _value(self, k: int, n: int, of: Callable[[str, str], float | None]) -> float:
        if k not in self.known:
            i, j = divmod(k // 2, n)
            v, w = self.xs[i], self.ys[j]
            self.known[k] = 0.0 if not (self.filled[0][i] and self.filled[1][j]) else (of(v, w) if k % 2 else of(w, v)) or 0.0
        return self.known[k]


def _alike(a: dict, b: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and of ``b`` whose names differ in at most two letters of five, some ``PAIRS`` at a time; names are compared once."""
    def kinds(rows: dict) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        # one kind: a name as it is compared, and its size as it is written
        code, names = pd.factorize(rows["name"])
        sizes, size = np.unique(rows["size"], return_inverse=True)
        kind, of, n = np.unique(code * len(sizes) + size, return_inverse=True, return_counts=True)
        return [names[k] for k in kind // len(sizes)], sizes[kind % len(sizes)], np.argsort(of, kind="stable"), np.cumsum(n) - n, n

    (xs, size_a, order_a, at_a, n_a), (ys, size_b, order_b, at_b, n_b) = kinds(a), kinds(b)
    i, j = np.nonzero(edits(xs, ys) <= np.maximum(size_a[:, None], size_b[None, :]) * 0.4)
    ends = np.cumsum(n_a[i] * n_b[j])
    for begin in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        at = np.arange(begin, min(begin + PAIRS, int(ends[-1])))
        low, high = np.searchsorted(ends, [at[0], at[-1]], "right")
        k = np.repeat(np.arange(low, high + 1), np.diff(np.concatenate([[begin], ends[low:high], [at[-1] + 1]])))
        u, v = i[k], j[k]
        row, col = np.divmod(at - (ends[k] - n_a[u] * n_b[v]), n_b[v])
        yield order_a[at_a[u] + row], order_b[at_b[v] + col]


def _full_scores(a: dict, b: dict, own: bool) -> Iterator[pa.RecordBatch]:
    text = {c: _Text(a, b, c) for c in (*_TEXTS, "w")}
    for x, y in _alike(a, b):
        keep = a["id"][x] < b["id"][y] if own else a["id"][x] != b["id"][y]
        x, y = x[keep], y[keep]
        first = a["id"][x] < b["id"][y]
        v, w = a["area_sqm"][x], b["area_sqm"][y]
        with np.errstate(divide="ignore", invalid="ignore"):
            area = np.nan_to_num(np.fmin(v, w) / np.fmax(v, w), nan=0.0)
        parish = text["civil_parish"].same(x, y)
        score = 0.35 * text["name"].oriented(x, y, first, _likeness) + 0.10 * text["name_gaelic"].oriented(x, y, first, _likeness) + 0.15 * parish + 0.10 * text["barony"].same(x, y) + 0.10 * area
        # outlines where boxes meet; a row without one has no box
        met = np.nonzero((a["east"][x] > b["west"][y]) & (b["east"][y] > a["west"][x]))[0]
        met = met[(a["north"][x[met]] > b["south"][y[met]]) & (b["north"][y[met]] > a["south"][x[met]])]
        if len(met):
            score[met] += 0.20 * text["w"].oriented(x[met], y[met], first[met], _overlap)
        for c in IDS:
            shared = text[c].same(x, y)
            if shared is not False:
                score[shared] = 0.99
        score = np.floor(score * 10000 + 0.5) / 10000
        yield _decided(a["id"][x], b["id"][y], score, _merged(score, parish))


def scored_pairs(rows: DataFrame, outlines: bool = False) -> DataFrame:
    """(id_a, id_b, score, merge) of the rows with one ``k``, each pair once, by the weights of ``er.pair_score``.

    ``rows`` has k, id, size (letters of the name), area_sqm and the texts, as they are compared.  Without ``outlines``,
    names are compared by their edits and only scores from 0.35 on are kept; with them (column w), by Jaro-Winkler, with
    the overlap of the outlines, and every pair whose names differ in at most two letters of five is kept.
    """
    if outlines:
        rows = spread(rows, "id").withColumn("box", bounds_col("w")).select("*", "box.*").drop("box")
    numbers = ("id", "size", "area_sqm", *(_BOX if outlines else ()))
    texts = (*_TEXTS, *(("w",) if outlines else ()))
    full = rows.where("id is not null").select("k", "id", "size", *[F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) for c in numbers[2:]], *[F.coalesce(F.col(c), F.lit(_NONE)).alias(c) for c in texts])
    full = full.withColumn("block", F.floor((F.row_number().over(W.partitionBy("k").orderBy("name", "id")) - 1) / (ROWS * (WIDER if outlines else 1))))
    # bounded: ROWS rows a block, WIDER times as many with outlines
    blocks = cut(full.groupBy("k", "block").agg(*[F.collect_list(c).alias(c) for c in (*numbers, *texts)]))
    side = lambda s: blocks.select("k", *[F.col(c).alias(f"{c}_{s}") for c in ("block", *numbers, *texts)])
    met = spread(side("a").join(side("b"), "k").where("block_a <= block_b").withColumn("own", F.col("block_a") == F.col("block_b")), "k", "block_a", "block_b")

    scores = _full_scores if outlines else _scores

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in range(x.num_rows):
                a, b = ({c: x.column(f"{c}_{s}")[r].values.to_numpy(zero_copy_only=False) for c in (*numbers, *texts)} for s in "ab")
                yield from scores(a, b, x.column("own")[r].as_py())

    return met.drop("block_a", "block_b").mapInArrow(score, "id_a long, id_b long, score double, merge boolean")
