"""String similarities that Spark lacks, as Arrow-batched functions, each pair worked out once a batch."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken) if t]
    m, swapped = len(left), sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by a shared beginning of up to four letters, from 0.7 on."""
    s = jaro(a, b)
    if s <= 0.7:
        return s
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return s + 0.1 * same * (1 - s)


def indel_ratio(a: str, b: str) -> float:
    """0-100: twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            here = row[j]
            row[j] = before + 1 if x == y else max(row[j], row[j - 1])
            before = here
    return 200.0 * row[-1] / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def matcher_ratio(a: str, b: str) -> float:
    """Share of characters in matching blocks, longest block first."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def metaphone(word: str) -> str:
    """Sound key of an English word after the public Metaphone rules."""
    w = re.sub(r"[^A-Z]", "", word.upper())
    w = re.sub(r"([^C])\1+", r"\1", w)
    w = re.sub(r"^(KN|GN|PN|AE|WR)", lambda m: m[0][1], w)
    w = re.sub(r"^X", "S", w)
    w = re.sub(r"^WH", "W", w)
    w = re.sub(r"MB$", "M", w)
    out = []
    at = lambda i: w[i] if 0 <= i < len(w) else ""
    i = 0
    while i < len(w):
        c, n, p = w[i], at(i + 1), at(i - 1)
        step = 1
        if c in "AEIOU":
            if i == 0:
                out.append(c)
        elif c == "C":
            if w[i : i + 3] == "CIA" or n == "H":
                out.append("X")
                step = 2 if n == "H" else 1
            elif n and n in "IEY":
                out.append("" if p == "S" else "S")
            else:
                out.append("K")
        elif c == "D":
            soft = n == "G" and at(i + 2) in ("E", "Y", "I")
            out.append("J" if soft else "T")
            step = 2 if soft else 1
        elif c == "G":
            if n == "H" and (i + 2 >= len(w) or at(i + 2) not in "AEIOU"):
                step = 2
            elif n == "N" and i + 2 >= len(w):
                pass
            else:
                out.append("J" if n and n in "IEY" and p != "G" else "K")
        elif c == "H":
            if n and n in "AEIOU" and p not in tuple("CSPTG"):
                out.append("H")
        elif c == "P":
            out.append("F" if n == "H" else "P")
            step = 2 if n == "H" else 1
        elif c == "S":
            hiss = n == "H" or w[i : i + 3] in ("SIO", "SIA")
            out.append("X" if hiss else "S")
            step = 2 if n == "H" else 1
        elif c == "T":
            if w[i : i + 3] in ("TIA", "TIO"):
                out.append("X")
            elif n == "H":
                out.append("0")
                step = 2
            elif w[i : i + 3] != "TCH":
                out.append("T")
        elif c in "WY":
            if n and n in "AEIOU":
                out.append(c)
        else:
            out.append({"K": "" if p == "C" else "K", "Q": "K", "V": "F", "X": "KS", "Z": "S"}.get(c, c))
        i += step
    return "".join(out)


def _pairwise(fn: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(T.DoubleType())
    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            if (x, y) not in known:
                known[(x, y)] = fn(x, y)
            out.append(known[(x, y)])
        return pd.Series(out, dtype="float64")

    return batch


jaro_winkler_col = _pairwise(jaro_winkler)
token_sort_col = _pairwise(token_sort_ratio)
matcher_col = _pairwise(matcher_ratio)


@F.pandas_udf(T.StringType())
def metaphone_col(s: pd.Series) -> pd.Series:
    known = {w: metaphone(w) for w in s.dropna().unique()}
    return s.map(known)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """0-100, inside the JVM."""
    return 100.0 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def trigrams(c: Column) -> Column:
    """Every trigram of the lower-cased text padded with two spaces, repeats kept; empty for null."""
    padded = F.concat(F.lit("  "), F.lower(F.trim(c)), F.lit("  "))
    return F.when(F.length(F.trim(c)) > 0, F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
