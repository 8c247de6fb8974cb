"""Quantities with units: a small grammar, dimensions as exponent vectors.

A unit is (scale, offset, dimension): ``canonical = value * scale + offset``.
Dimensions are exponent vectors over ``BASES``; a product of units adds vectors,
a power multiplies them, so "sq. perches" is an area while "perches" alone is a
length.  Canonical units: metre, kilogram, second, pound sterling, kelvin.

Grammar (case aside)::

    statement := compound qualifier? | number unit | marker unit | "[" unit "]"
    compound  := acres roods? perches?            (20a. 1r. 14p., A.20 R.1 P.14)
    unit      := qualifier? power? name power? | "by the" qualifier "acre" | abbreviation
    marker    := "figure in" | "area is in" | "measured in" | "given in" | "in"
    number    := digits with group commas, decimals, a fraction (3 1/2, 3½)
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASES = ("length", "mass", "time", "money", "temperature")
Dim = tuple[int, ...]


def dim(**powers: int) -> Dim:
    return tuple(powers.get(b, 0) for b in BASES)


LENGTH, AREA, VOLUME = dim(length=1), dim(length=2), dim(length=3)
MASS, TIME, MONEY, TEMP = dim(mass=1), dim(time=1), dim(money=1), dim(temperature=1)

YARD = 0.9144
STATUTE_ACRE = 4840 * YARD**2


@dataclass(frozen=True)
class Unit:
    scale: float
    dim: Dim
    offset: float = 0.0

    def power(self, n: int) -> Unit:
        return Unit(self.scale**n, tuple(n * d for d in self.dim))

    def times(self, other: Unit) -> Unit:
        return Unit(self.scale * other.scale, tuple(a + b for a, b in zip(self.dim, other.dim)))

    def per(self, other: Unit) -> Unit:
        return self.times(other.power(-1))

    def to_canonical(self, value: float) -> float:
        return value * self.scale + self.offset


#: Land measures: area of the measure's acre in statute acres.  The Irish
#: (plantation) perch has 7 yards, the Cunningham 6 1/4, the statute 5 1/2.
MEASURES = {"statute": 1.0, "irish": 196 / 121, "cunningham": 625 / 484}

#: Spellings of units.
NAMES: dict[str, Unit] = {}


def _add(unit: Unit, *names: str) -> None:
    NAMES.update(dict.fromkeys(names, unit))


_add(Unit(1.0, LENGTH), "m", "metre", "metres", "meter", "meters")
_add(Unit(1000.0, LENGTH), "km", "kilometre", "kilometres", "kilometer", "kilometers")
_add(Unit(0.0254, LENGTH), "inch", "inches")
_add(Unit(0.3048, LENGTH), "ft", "foot", "feet")
_add(Unit(YARD, LENGTH), "yd", "yds", "yard", "yards")
_add(Unit(5.5 * YARD, LENGTH), "perch", "perches", "per", "pole", "poles", "rod", "rods")
_add(Unit(22 * YARD, LENGTH), "chain", "chains")
_add(Unit(1760 * YARD, LENGTH), "mile", "miles")
_add(Unit(STATUTE_ACRE, AREA), "acre", "acres", "ac")
_add(Unit(STATUTE_ACRE / 4, AREA), "rood", "roods", "rds", "rd", "ro")
_add(Unit(10_000.0, AREA), "ha", "hectare", "hectares")
_add(Unit(1.0, MASS), "kg", "kilogram", "kilograms")
_add(Unit(0.45359237, MASS), "lb", "lbs")
_add(Unit(0.45359237 * 14, MASS), "stone", "stones")
_add(Unit(0.45359237 * 112, MASS), "cwt", "hundredweight")
_add(Unit(0.45359237 * 2240, MASS), "ton", "tons")
_add(Unit(1.0, MONEY), "£", "pound", "pounds")
_add(Unit(1 / 20, MONEY), "shilling", "shillings")
_add(Unit(1 / 240, MONEY), "pence", "penny")
_add(Unit(1.0, TEMP), "kelvin")
_add(Unit(1.0, TEMP, 273.15), "°c", "celsius")
_add(Unit(5 / 9, TEMP, 459.67 * 5 / 9), "°f", "fahrenheit")
_add(Unit(86_400.0, TIME), "day", "days")
_add(Unit(31_556_952.0, TIME), "year", "years")

#: Spellings of the land measures.
_MEASURE = {
    "statute": r"statute|stat|english|engl?|imperial",
    "irish": r"irish\s+plantation|old\s+irish|irish|ir|plantation|plantn",
    "cunningham": r"cunningham|cunn|scotch",
}
_NUMBER = r"\d+(?:,\d{3})+(?:\.\d+)?|\d+\s+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?\s?[½¼¾]|\d+(?:\.\d+)?|[½¼¾]"
_ANY_MEASURE = "|".join(_MEASURE.values())
#: a whole acre of some measure: "Irish plantation acres", "stat. meas.", "by the Irish acre", "E.M."
_LAND = rf"(?:by\s+the\s+)?(?P<m{{0}}>{_ANY_MEASURE})\.?\s*(?:acres?|measures?|meas|ac)\b\.?|(?P<x{{0}}>[eisc]\.\s?m\b\.?)"
_PLAIN = r"(?P<p{0}>(?:sq(?:uare)?\.?|cubic|cu\.?)\s+)?(?P<n{0}>" + "|".join(sorted((re.escape(n) for n in NAMES), key=len, reverse=True)) + r")(?![\w’'-])(?P<of{0}>\s+of\s+land)?"
_UNIT = rf"(?:{_LAND}|{_PLAIN})"
_ARP = (
    r"(?P<a1>\d+(?:\.\d+)?)\s*(?:acres?|ac|a)\b[.,]?\s*(?:(?P<r1>\d+(?:\.\d+)?)\s*(?:roods?|ro|r)\b[.,]?\s*)?(?:(?P<q1>\d+(?:\.\d+)?)\s*(?:perches|perch|per|po|p)\b[.,]?)?"
    r"|\ba\.?\s?(?P<a2>\d+(?:\.\d+)?)\s*r\.?\s?(?P<r2>\d+(?:\.\d+)?)\s*p\.?\s?(?P<q2>\d+(?:\.\d+)?)"
)
_COMPOUND = re.compile(rf"(?:{_ARP})\s*(?:{_LAND.format(1)})?")
_VALUE = re.compile(rf"(?P<v>{_NUMBER})\s*{_UNIT.format(1)}(?:\s*(?:/|per\s+)(?:{_PLAIN.format(2)}))?")
_MARKED = re.compile(rf"(?:\[\s*{_UNIT.format(1)}[^\]]*\])|(?:\b(?:figures?|area is|measured|given|entered|stated)\s+(?:is\s+)?(?:in\s+)?{_UNIT.format(2)})")
_INITIALS = {"e": "statute", "s": "statute", "i": "irish", "c": "cunningham"}
_FRACTIONS = {"½": 0.5, "¼": 0.25, "¾": 0.75}
#: words after a length that show it was no area of land
_NOT_LAND = re.compile(r"\s*(?:of\s+(?:ditch|fence|wall|road|frontage|hedge)|frontage|long|in length)\b")
#: a text without any of this states nothing (kept broad; used to spare the grammar)
HINT = r"(?i)acre|meas|hect|\bha\b|rood|\brds?\b|perch|[eisc]\.\s?m\b|\d\s*a\b|\ba\.?\s?\d|ac\."


@dataclass(frozen=True)
class Quantity:
    """``value`` is null where only a unit is stated."""

    value: float | None
    unit: Unit
    measure: str | None
    start: int

    @property
    def canonical(self) -> float | None:
        return None if self.value is None else self.unit.to_canonical(self.value)


def number(text: str) -> float:
    t = text.strip().replace(",", "")
    if t[-1] in _FRACTIONS:
        return (float(t[:-1]) if t[:-1].strip() else 0.0) + _FRACTIONS[t[-1]]
    total = 0.0
    for part in t.split():
        a, _, b = part.partition("/")
        total += float(a) / float(b) if b and float(b) else float(a)
    return total


def measure_of(word: str | None) -> str | None:
    return next((m for m, pattern in _MEASURE.items() if word and re.fullmatch(pattern, word)), None)


def _unit(m: re.Match, i: int) -> tuple[Unit, str | None] | None:
    g = m.groupdict()
    if g.get(f"m{i}") or g.get(f"x{i}"):
        which = measure_of(g.get(f"m{i}")) or _INITIALS[(g.get(f"x{i}") or "s")[0]]
        return Unit(STATUTE_ACRE * MEASURES[which], AREA), which
    name = g.get(f"n{i}")
    if not name:
        return None
    unit = NAMES[name]
    if unit.dim == LENGTH and (g.get(f"p{i}") or g.get(f"of{i}")):
        unit = unit.power(3 if (g.get(f"p{i}") or "").startswith("cu") else 2)
    return unit, None


@lru_cache(maxsize=4096)
def quantities(text: str | None) -> tuple[Quantity, ...]:
    """Every quantity and bare unit stated in ``text``, in order of place; none for null or other text."""
    if not text:
        return ()
    low = text.lower()
    found: list[Quantity] = []
    taken: list[tuple[int, int]] = []
    free = lambda m: not any(a < m.end() and m.start() < b for a, b in taken)
    for m in _COMPOUND.finditer(low):
        a, r, q = (m[f"{k}1"] or m[f"{k}2"] for k in "arq")
        if r is None and q is None:
            continue  # a plain "12 acres" is read below
        word = measure_of(m["m1"]) or (_INITIALS[m["x1"][0]] if m["x1"] else None)
        unit = Unit(STATUTE_ACRE * MEASURES[word or "statute"], AREA)
        found.append(Quantity(float(a) + float(r or 0) / 4 + float(q or 0) / 160, unit, word, m.start()))
        taken.append(m.span())
    for m in _VALUE.finditer(low):
        if free(m) and (u := _unit(m, 1)):
            if u[0].dim == LENGTH and _NOT_LAND.match(low, m.end()):
                continue
            unit = u[0]
            if m["n2"] and (over := _unit(m, 2)):
                unit = unit.per(over[0])
            found.append(Quantity(number(m["v"]), unit, u[1], m.start()))
            taken.append(m.span())
    for m in _MARKED.finditer(low):
        if free(m) and (u := _unit(m, 1) or _unit(m, 2)):
            found.append(Quantity(None, u[0], u[1], m.start()))
    return tuple(sorted(found, key=lambda x: x.start))


def area(text: str | None) -> tuple[float | None, float | None]:
    """(value, statute acres in one unit) of the first area stated; (None, None) without one."""
    for q in quantities(text):
        if q.unit.dim == AREA:
            return q.value, q.unit.scale / STATUTE_ACRE
    return None, None


_AREA = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("unit_acres", T.DoubleType())])
_QUANTITY = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("canonical", T.DoubleType()), T.StructField("scale", T.DoubleType()), T.StructField("dim", T.ArrayType(T.IntegerType())), T.StructField("measure", T.StringType())])


@F.pandas_udf(_AREA)
def stated_area(text: pd.Series) -> pd.DataFrame:
    """Struct of the first area stated in a text: its number and its unit in statute acres."""
    return pd.DataFrame([area(t) for t in text], columns=["value", "unit_acres"]).astype("float64")


@F.pandas_udf(T.ArrayType(_QUANTITY))
def stated_quantities(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"value": q.value, "canonical": q.canonical, "scale": q.unit.scale, "dim": list(q.unit.dim), "measure": q.measure} for q in quantities(t)])
