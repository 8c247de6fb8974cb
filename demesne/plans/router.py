"""Questions to plans: rule-based slot filling, SQL guard, evidence gate, recovery."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demesne.plans.metrics import METRICS, Slots, compile_slots

ROW_CAP = 300
#: Statements a read-only query may not contain.
BLOCKED = ["insert", "update", "delete", "drop", "alter", "create", "truncate", "replace", "merge", "attach", "detach", "pragma", "vacuum", "grant", "revoke", "call", "set", "use", "load", "copy"]
_WRITES = rf"\b(?:{'|'.join(BLOCKED)})\b"


def strip_literals(sql: Column) -> Column:
    """Without comments, quoted text and quoted names, so that their words don't count."""
    t = F.regexp_replace(sql, r"(?s)/\*.*?\*/|--[^\n]*", " ")
    return F.regexp_replace(t, "(?s)'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", " x ")


def guard_verdict(sql: Column) -> Column:
    """``ok`` or why a text is no single read-only query."""
    t = F.trim(F.regexp_replace(F.regexp_replace(strip_literals(F.coalesce(sql, F.lit(""))), r"\s+", " "), r";\s*$", ""))
    return (
        F.when(t == "", "empty")
        .when(F.instr(t, ";") > 0, "several statements")
        .when(~F.lower(t).rlike(r"^\(*\s*(select|with)\b"), "not a query")
        .when(F.lower(t).rlike(_WRITES), "blocked word")
        .otherwise("ok")
    )


def guarded(spark: SparkSession, sql: str, args: dict | None = None, cap: int = ROW_CAP) -> DataFrame:
    """Runs one read-only query with bound parameters, at most ``cap`` rows (the display cap)."""
    verdict = spark.range(1).select(guard_verdict(F.lit(sql)).alias("v")).first()["v"]
    if verdict != "ok":
        raise ValueError(f"refused: {verdict}")
    return spark.sql(sql, args or {}).limit(cap)


def numbers(text: Column) -> Column:
    """Numbers of a text as written without group commas; a sign or a decimal point belongs to them."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(\d),(\d{3})\b", "$1$2"), r"(\d),(\d{3})\b", "$1$2")
    return F.regexp_extract_all(plain, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))


def unsupported(answer: Column, evidence: Column, least: int = 3) -> Column:
    """Numbers of ``least`` digits or more in an answer that its evidence does not contain as a run of digits."""
    known = F.array_join(numbers(evidence), " ")
    return F.array_distinct(F.filter(numbers(answer), lambda n: (F.length(F.regexp_replace(n, r"\D", "")) >= least) & ~known.contains(n)))


@dataclass
class Reading:
    """What a question asks: the slots, how sure, and words that ground it."""

    slots: Slots | None
    confidence: float
    reason: str
    words: list[str] = field(default_factory=list)


#: Words that point to a metric; the first metric with all words of a group wins.
CUES: list[tuple[str, list[list[str]]]] = [
    ("canada_emigration_count", [["emigra", "canada"], ["sailed", "canada"]]),
    ("emigration_count", [["emigra"], ["ship"], ["sailed"]]),
    ("eviction_event_count", [["eviction"], ["clearance"]]),
    ("evicted_person_count", [["evicted"]]),
    ("population_change", [["population", "change"], ["population", "decline"], ["population", "fall"]]),
    ("uninhabited_houses", [["uninhabited"]]),
    ("population", [["population"], ["populous"], ["census"]]),
    ("avg_holding_acres", [["average", "holding"], ["average", "acres"], ["average", "landholding"]]),
    ("widow_count", [["widow"]]),
    ("tenancy_count", [["tenant"], ["tenanc"]]),
    ("parish_count", [["how many", "parishes"], ["number of", "parishes"]]),
    ("townland_count", [["how many", "townlands"], ["number of", "townlands"]]),
    ("townland_attribute", [["which parish"], ["which barony"], ["which county"], ["what county"], ["what barony"]]),
    ("person_count", [["people"], ["persons"], ["records"]]),
]
#: Subjects the records say nothing about.
OUTSIDE = ["weather", "religion", "crops", "politic", "other estates", "died", "mortality", "approach"]
_DIMS = {"year": ("per year", "by year", "each year", "over time", "trend"), "townland": ("per townland", "by townland", "each townland", "which townland", "townlands"), "parish": ("by parish", "per parish", "each parish"), "ship": ("which ship", "by ship", "per ship", "ships"), "surname": ("by surname", "surnames"), "gender": ("by gender", "male and female", "male versus female", "men and women"), "role": ("by role",), "county": ("by county", "each county", "per county"), "barony": ("by barony", "each barony")}
SUPERLATIVE = ("most", "largest", "highest", "smallest", "fewest", "worst", "top", "busiest")


def read_question(question: str, places: list[str] | tuple[str, ...] = ()) -> Reading:
    """Deterministic reading of a question; no metric means it is refused rather than guessed."""
    q = " ".join(question.lower().split())
    if any(w in q for w in OUTSIDE):
        return Reading(None, 0.0, "outside the records")
    for metric, groups in CUES:
        hit = next((g for g in groups if all(w in q for w in g)), None)
        if hit is None:
            continue
        m = METRICS[metric]
        dims = tuple(d for d, cues in _DIMS.items() if d in m.dims and any(c in q for c in cues))
        filters: dict[str, object] = {}
        years = [int(y) for y in re.findall(r"\b(1[89]\d\d)\b", q)]
        if len(years) == 2 and "year_range" in m.filters and re.search(r"\b(from|between)\b", q):
            filters["year_range"] = (min(years), max(years))
        elif len(years) == 1 and "year" in m.filters:
            filters["year"] = years[0]
        place = max((p for p in places if re.search(rf"\b{re.escape(p.lower())}\b", q)), key=len, default=None)
        if place and "townland" in m.filters:
            filters["townland"] = place
        if "surname" in m.filters and (named := re.search(r"\b(?:surnamed?|named|called)\s+([a-z'’]+)", q)):
            filters["surname"] = named[1].upper()
        if "gender" in m.filters and "gender" not in dims:
            # "male" also stands in "female", which is tried first
            filters.update({"gender": "Female"} if re.search(r"\b(female|women)\b", q) else {"gender": "Male"} if re.search(r"\b(male|men)\b", q) else {})
        limit = None
        if dims:
            limit = 10 if any(re.search(rf"\b{w}\b", q) for w in SUPERLATIVE) else 50
        confidence = min(1.0, 0.5 + 0.15 * len(hit) + 0.1 * len(dims) + 0.1 * len(filters))
        return Reading(Slots(metric, dims, filters, limit), round(confidence, 2), "rule", hit)
    return Reading(None, 0.0, "no metric fits")


def answer(spark: SparkSession, sf_dir: str, question: str, places: list[str] | tuple[str, ...] = (), repair: Callable[[str], str] | None = None) -> DataFrame | None:
    """Plan that answers a question, or None if it is refused; ``repair`` may reword it once."""
    r = read_question(question, places)
    if r.slots is None and repair is not None:
        r = read_question(repair(question), places)
    return None if r.slots is None else compile_slots(spark, sf_dir, r.slots)


def answer_text(question: str, rows: list[dict]) -> str:
    """Deterministic wording of a small result."""
    if not rows:
        return "No record answers this."
    if len(rows) == 1 and len(rows[0]) == 1:
        return f"{next(iter(rows[0].values()))}"
    names = [k for k in rows[0] if k != "value"]
    shown = "; ".join(f"{', '.join(str(r[n]) for n in names)}: {r.get('value')}" for r in rows[:10])
    more = f"; and {len(rows) - 10} more" if len(rows) > 10 else ""
    return shown + more


def chart_spec(rows: list[dict]) -> dict | None:
    """A chart of a result of two rows or more: the first number column after the first; a line over years."""
    if len(rows) < 2:
        return None
    first, *rest = rows[0]
    y = next((c for c in rest if isinstance(rows[0][c], (int, float)) and not isinstance(rows[0][c], bool)), None)
    if y is None:
        return None
    cut = rows[:12]
    return {"kind": "line" if first == "year" else "bar", "x": first, "y": y, "labels": [r[first] for r in cut], "values": [r[y] for r in cut]}
