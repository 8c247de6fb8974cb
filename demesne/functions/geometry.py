"""Geometry text, repair of coordinates and great-circle distance."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_KM = 6371.0
#: south, north, west, east of all places
IRELAND = (51.0, 56.0, -11.0, -4.0)
Box = tuple[float, float, float, float]

_NUM = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_HEAD = re.compile(r"^\s*(?:SRID\s*=\s*\d+\s*;)?\s*(POINT|POLYGON|MULTIPOLYGON)\s*(?:ZM?|M)?\s*(\(.*\))\s*$", re.I | re.S)
_RING = re.compile(r"\(([^()]*)\)")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _inside(lat: Column, lon: Column, box: Box) -> Column:
    s, n, w, e = box
    return lat.between(s, n) & lon.between(w, e)


def repaired(lat: Column, lon: Column, box: Box = IRELAND) -> Column:
    """Struct(lat, lon) with swapped axes and a lost sign undone; null if no such undoing lands in ``box``.

    A missing half, 0/0 and other void entries are null.
    """
    ways = F.array(*[F.struct(a.alias("lat"), b.alias("lon")) for a, b in ((lat, lon), (lon, lat), (lat, -lon), (-lat, lon), (lon, -lat), (-lon, lat))])
    return F.get(F.filter(ways, lambda p: _inside(p["lat"], p["lon"], box)), 0)


def wkt_point(wkt: Column) -> Column:
    """Struct(lat, lon) of a POINT text as written (x y); null for other text."""
    pattern = rf"(?is)^\s*(?:srid\s*=\s*\d+\s*;)?\s*point\s*z?\s*\(\s*({_NUM})\s+({_NUM})(?:\s+{_NUM})?\s*\)\s*$"
    x, y = (F.regexp_extract(wkt, pattern, i).try_cast("double") for i in (1, 2))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(y.alias("lat"), x.alias("lon")))


def _orient(rings: list[np.ndarray], box: Box | None) -> list[np.ndarray] | None:
    if box is None:
        return rings
    s, n, w, e = box
    for swap, sx, sy in ((0, 1, 1), (1, 1, 1), (0, -1, 1), (1, -1, 1), (0, 1, -1), (1, 1, -1)):
        out = [(r[:, ::-1] if swap else r) * (sx, sy) for r in rings]
        if all(((r >= (w, s)) & (r <= (e, n))).all() for r in out):
            return out
    return None


def polygon_parts(wkt: str | None, box: Box | None = IRELAND) -> list[list[np.ndarray]]:
    """Parts of a (multi)polygon text, each a list of rings of x, y; the first ring is the shell.

    Reads an SRID, any case, Z and M values and any white space; swapped axes
    and lost signs are read as meant.  Empty, broken (unbalanced, unclosed, of
    fewer than three corners, not numeric) and other text has no parts.
    """
    m = _HEAD.match(wkt or "")
    if not m or m[1].upper() == "POINT":
        return []
    body = m[2]
    if body.count("(") != body.count(")"):
        return []
    depth = 1 if m[1].upper() == "POLYGON" else 2
    level, parts, start = 0, [], 0
    for i, c in enumerate(body):
        if c == "(":
            level += 1
            if level == depth:
                start = i
        elif c == ")":
            if level == depth:
                parts.append(body[start : i + 1])
            level -= 1
            if level < 0:
                return []
    if depth == 1:
        parts = [body]
    shaped, flat = [], []
    try:
        for part in parts:
            rings = []
            for text in _RING.findall(part):
                ring = np.array([[float(v) for v in p.split()[:2]] for p in text.split(",")])
                if ring.ndim != 2 or ring.shape[1] != 2 or len(ring) < 4 or (ring[0] != ring[-1]).any() or not np.isfinite(ring).all():
                    return []
                rings.append(ring)
            if not rings:
                return []
            shaped.append(len(rings))
            flat += rings
    except ValueError:
        return []
    flat = _orient(flat, box) if flat else None
    if not flat:
        return []
    out, at = [], 0
    for k in shaped:
        out.append(flat[at : at + k])
        at += k
    return out


def slabs(rings: list[np.ndarray]) -> list[tuple[float, float, list[float], list[float]]]:
    """Trapezoids of one polygon part: (x0, x1, y at x0, y at x1 of its edges, lowest first).

    Slabs lie between successive corner abscissae; within one, edges don't
    cross, so a point is inside iff an odd number of them lie below it.
    """
    a = np.concatenate([r[:-1] for r in rings])
    b = np.concatenate([r[1:] for r in rings])
    swap = a[:, 0] > b[:, 0]
    a[swap], b[swap] = b[swap], a[swap].copy()
    keep = a[:, 0] < b[:, 0]
    a, b = a[keep], b[keep]
    xs = np.unique(np.concatenate([a[:, 0], b[:, 0]]))
    slope = (b[:, 1] - a[:, 1]) / (b[:, 0] - a[:, 0])
    # a sweep: the edges over a slab are those over the last one, less those that ended, and those that start here
    order = np.argsort(a[:, 0], kind="stable")
    starts = a[order, 0]
    out, on, at = [], np.zeros(0, dtype=np.int64), 0
    for x0, x1 in zip(xs[:-1], xs[1:]):
        upto = int(np.searchsorted(starts, x0, "right"))
        on = np.concatenate([on[b[on, 0] > x0], order[at:upto]])
        at = upto
        if not len(on):
            continue
        lo = a[on, 1] + (x0 - a[on, 0]) * slope[on]
        hi = a[on, 1] + (x1 - a[on, 0]) * slope[on]
        by = np.argsort(lo + hi, kind="stable")
        out.append((float(x0), float(x1), lo[by].tolist(), hi[by].tolist()))
    return out


def _crossings(rings: list[np.ndarray], x: float) -> np.ndarray:
    """Sorted heights at which the edges of one polygon part cross the vertical at ``x``."""
    a = np.concatenate([r[:-1] for r in rings])
    b = np.concatenate([r[1:] for r in rings])
    on = (a[:, 0] > x) != (b[:, 0] > x)
    a, b = a[on], b[on]
    return np.sort(a[:, 1] + (x - a[:, 0]) * (b[:, 1] - a[:, 1]) / (b[:, 0] - a[:, 0]))


def _cuts(parts: list[list[np.ndarray]]) -> np.ndarray:
    """Abscissae between which no edges start, end or cross."""
    a = np.concatenate([r[:-1] for p in parts for r in p])
    b = np.concatenate([r[1:] for p in parts for r in p])
    d = b - a
    xs = [a[:, 0]]
    step = max(1, 250_000 // len(a))
    for i in range(0, len(a), step):
        p, e = a[i : i + step, None], d[i : i + step, None]
        den = e[..., 0] * d[:, 1] - e[..., 1] * d[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((a[:, 0] - p[..., 0]) * d[:, 1] - (a[:, 1] - p[..., 1]) * d[:, 0]) / den
            u = ((a[:, 0] - p[..., 0]) * e[..., 1] - (a[:, 1] - p[..., 1]) * e[..., 0]) / den
        hit = (den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        xs.append((p[..., 0] + t * e[..., 0])[hit])
    return np.unique(np.concatenate(xs))


def _spans(parts: list[list[np.ndarray]], x: float) -> list[tuple[float, float]]:
    """Disjoint intervals of the vertical at ``x`` inside any part."""
    pairs = sorted((float(lo), float(hi)) for p in parts for c in [_crossings(p, x)] for lo, hi in zip(c[::2], c[1::2]))
    out: list[tuple[float, float]] = []
    for lo, hi in pairs:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _levels(part: list[np.ndarray], xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the intervals of the verticals at ``xs`` inside one part, a column each; nought long where there are fewer."""
    a = np.concatenate([r[:-1] for r in part])[:, None]
    b = np.concatenate([r[1:] for r in part])[:, None]
    on = (a[..., 0] > xs) != (b[..., 0] > xs)
    with np.errstate(divide="ignore", invalid="ignore"):
        y = a[..., 1] + (xs - a[..., 0]) * (b[..., 1] - a[..., 1]) / (b[..., 0] - a[..., 0])
    y = np.sort(np.where(on, y, np.inf), axis=0)[: int(on.sum(0).max(initial=0))]
    y[~np.isfinite(y)] = 0.0
    return y[::2], y[1::2]


def overlap(a: list[list[np.ndarray]], b: list[list[np.ndarray]]) -> tuple[float, float, float]:
    """(area of a, of b, of both) in square degrees: exact slab by slab, as edges are straight between cuts."""
    if not a or not b:
        return 0.0, 0.0, 0.0
    xs = _cuts([*a, *b])
    if len(a) == len(b) == 1 and len(xs) * sum(len(r) for p in (*a, *b) for r in p) <= 1_000_000:
        width, mid = np.diff(xs), (xs[:-1] + xs[1:]) / 2
        (la, ha), (lb, hb) = _levels(a[0], mid), _levels(b[0], mid)
        both = sum((np.maximum(0.0, np.minimum(h, hb) - np.maximum(low, lb)).sum(0) for low, h in zip(la, ha)), np.zeros(len(mid)))
        return float(((ha - la).sum(0) * width).sum()), float(((hb - lb).sum(0) * width).sum()), float((both * width).sum())
    total = [0.0, 0.0, 0.0]
    for x0, x1 in zip(xs[:-1], xs[1:]):
        mid, width = (x0 + x1) / 2, x1 - x0
        p, q = _spans(a, mid), _spans(b, mid)
        total[0] += width * sum(hi - lo for lo, hi in p)
        total[1] += width * sum(hi - lo for lo, hi in q)
        total[2] += width * sum(max(0.0, min(h1, h2) - max(l1, l2)) for l1, h1 in p for l2, h2 in q)
    return total[0], total[1], total[2]


def iou(a: str | None, b: str | None, box: Box | None = IRELAND, read: Callable = polygon_parts) -> float | None:
    """Intersection over union of two polygon texts; null unless both can be read."""
    p, q = read(a, box), read(b, box)
    if not p or not q:
        return None
    area_a, area_b, both = overlap(p, q)
    union = area_a + area_b - both
    return both / union if union > 0 else 0.0


@F.pandas_udf(T.DoubleType())
def iou_col(a: pd.Series, b: pd.Series) -> pd.Series:
    read = lru_cache(4_096)(polygon_parts)
    return pd.Series([None if x is None or y is None else iou(x, y, IRELAND, read) for x, y in zip(a, b)], dtype="float64")


def shape_flag(wkt: str | None, box: Box = IRELAND) -> str:
    """``missing``, ``point``, ``empty``, ``broken``, ``outside``, ``repaired`` (axes or sign) or ``valid``."""
    text = (wkt or "").strip()
    if not text or text.lower() in ("n/a", "null", "none"):
        return "missing"
    if re.search(r"(?i)\bempty\b", text):
        return "empty"
    if re.match(r"(?i)\s*(?:srid\s*=\s*\d+\s*;)?\s*point", text):
        return "point"
    raw = polygon_parts(text, None)
    if not raw:
        return "broken"
    fixed = polygon_parts(text, box)
    if not fixed:
        return "outside"
    return "valid" if all((r == f).all() for a, b in zip(raw, fixed) for r, f in zip(a, b)) else "repaired"


_BOUNDS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("west", "south", "east", "north")])


@F.pandas_udf(_BOUNDS)
def bounds_col(wkt: pd.Series) -> pd.DataFrame:
    """Bounding box of all parts of a polygon text; null for unreadable text."""
    rows = []
    for parts in map(polygon_parts, wkt):
        rings = [r for p in parts for r in p]
        rows.append((*np.min([r.min(0) for r in rings], axis=0).tolist(), *np.max([r.max(0) for r in rings], axis=0).tolist()) if rings else (None,) * 4)
    return pd.DataFrame(rows, columns=["west", "south", "east", "north"], dtype="float64")


def apart(a: Column, b: Column) -> Column:
    """Two boxes of ``bounds_col`` share no area; null unless both are known."""
    return (a["east"] <= b["west"]) | (b["east"] <= a["west"]) | (a["north"] <= b["south"]) | (b["north"] <= a["south"])


@F.pandas_udf(T.StringType())
def shape_flag_col(wkt: pd.Series) -> pd.Series:
    return wkt.map(shape_flag)


_OUTLINE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("mean_x", T.DoubleType()), T.StructField("mean_y", T.DoubleType())])


@F.pandas_udf(_OUTLINE)
def outline_centres(wkt: pd.Series) -> pd.DataFrame:
    """Middle of the bounding box of the first part's shell, and the mean of its corners (the closing one left out); null for unreadable text."""
    rows = []
    for text in wkt:
        parts = polygon_parts(text)
        if not parts:
            rows.append((None,) * 4)
            continue
        ring = parts[0][0]
        low, high, mean = ring.min(0), ring.max(0), ring[:-1].mean(0)
        rows.append((float(low[0] + high[0]) / 2, float(low[1] + high[1]) / 2, float(mean[0]), float(mean[1])))
    return pd.DataFrame(rows, columns=["x", "y", "mean_x", "mean_y"])
