"""Text helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Letters that typing, copying and scanning confuse.
CONFUSED = {frozenset(p) for p in ("o0", "i1", "l1", "il", "e3", "s5", "b8", "a4", "g6", "t7", "ck", "iy", "ey", "sz", "uv", "nm", "ao", "ae", "ei", "ou", "rn", "nu", "hb", "ft", "tl", "ec", "dt", "pb", "fv", "gk", "bh", "vw", "wu")}
DIGITS = str.maketrans("0134578", "oieastb")
_VOWELS = set("aeiouy")


@lru_cache(maxsize=65536)
def plain(text: str) -> str:
    """Lower case without accents; curly quotes made straight."""
    t = unicodedata.normalize("NFKD", text)
    t = "".join(c for c in t if not unicodedata.combining(c))
    return t.replace("’", "'").replace("‘", "'").replace("`", "'").lower()


def letters(text: str) -> str:
    return re.sub(r"[^a-z]", "", text)


def unlettered(token: str) -> str:
    """Digits read as letters inside a word; a number by itself stays."""
    if not re.search(r"[a-z]", token) and not re.fullmatch(r"[01345678]{3,}", token):
        return token
    return token.translate(DIGITS)


def substitution(a: str, b: str) -> float:
    if frozenset((a, b)) in CONFUSED:
        return 0.6
    if a in _VOWELS and b in _VOWELS:
        return 0.75
    return 1.0


#: cost of one letter for another; pairs not listed cost 1
_COSTS = {a + b: substitution(a, b) for a in "abcdefghijklmnopqrstuvwxyz0123456789" for b in "abcdefghijklmnopqrstuvwxyz0123456789" if a != b and substitution(a, b) < 1.0}


def osa(a: str, b: str, limit: float = 99.0, weighted: bool = True) -> float:
    """Damerau-Levenshtein distance (adjacent swaps count once), weighted or plain.

    Weighted: confused letters 0.6, vowel for vowel 0.75, a swap 0.8, a letter
    doubled or undoubled 0.5, all else 1.  Values above ``limit`` only mean
    "more than limit".
    """
    if a == b:
        return 0.0
    n, m = len(a), len(b)
    least_gap = 0.5 if weighted else 1.0
    if abs(n - m) * least_gap > limit:
        return limit + 1
    # cells further from the diagonal cost more than the limit
    band = min(int(limit / least_gap), n + m)
    far = limit + 1.0
    swap = 0.8 if weighted else 1.0
    costs = _COSTS if weighted else {}
    gaps = [1.0] * (m + 1)
    if weighted:
        for j in range(2, m + 1):
            if b[j - 1] == b[j - 2]:
                gaps[j] = 0.5
    before: list[float] = []
    row = [0.0] * (m + 1)
    for j in range(1, m + 1):
        row[j] = row[j - 1] + gaps[j]
    last = ""
    for i in range(1, n + 1):
        x = a[i - 1]
        drop = 0.5 if weighted and x == last else 1.0
        new = [far] * (m + 1)
        if i <= band:
            new[0] = row[0] + drop
        least = new[0]
        for j in range(max(1, i - band), min(m, i + band) + 1):
            y = b[j - 1]
            if x == y:
                v = row[j - 1]
            else:
                v = row[j - 1] + costs.get(x + y, 1.0)
                if y == last and j > 1 and x == b[j - 2]:
                    w = before[j - 2] + swap
                    if w < v:
                        v = w
            w = row[j] + drop
            if w < v:
                v = w
            w = new[j - 1] + gaps[j]
            if w < v:
                v = w
            new[j] = v
            if v < least:
                least = v
        if least > limit:
            return limit + 1
        before, row, last = row, new, x
    return row[m]


def deletes(word: str, most: int) -> set[str]:
    """``word`` and every string left by dropping up to ``most`` of its letters."""
    out, layer = {word}, {word}
    for _ in range(most):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out |= layer
    return out
