"""Column functions that clean and normalise ingested values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demesne.runtime import ws_trim

#: Given-name abbreviations of the registers.
ABBREVIATIONS = {"JNO": "JOHN", "WM": "WILLIAM", "JAS": "JAMES", "THOS": "THOMAS", "MARGT": "MARGARET", "MICHL": "MICHAEL", "PATK": "PATRICK", "PAT": "PATRICK", "MATTW": "MATTHEW", "EDWD": "EDWARD"}
#: Words that point to Canada in a destination.
CANADA = ["canada", "quebec", "st andrews", "st. andrews", "st andrew", "grosse isle", "new brunswick", "nova scotia", "ontario", "montreal", "toronto"]
#: Latin letters with accents and their plain forms, for JVM-side folding.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def clean_text(c: Column) -> Column:
    """Trimmed; empty and ``nan`` become null."""
    t = ws_trim(c)
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def to_int(c: Column) -> Column:
    """Lenient integer, cut toward zero; null if not a number."""
    return ws_trim(c).try_cast("double").try_cast("int")


def to_float(c: Column) -> Column:
    return ws_trim(c).try_cast("double")


def clean_gender(c: Column) -> Column:
    g = F.upper(ws_trim(c))
    return F.when(g.isin("M", "MALE"), "M").when(g.isin("F", "FEMALE"), "F")


def to_flag(c: Column) -> Column:
    return F.coalesce(F.lower(ws_trim(c)).isin("1", "true", "yes", "y", "t"), F.lit(False)).cast("int")


def sum_defined(*cols: Column) -> Column:
    """Sum of what is known; 0 if nothing is."""
    out = F.lit(0)
    for c in cols:
        out = out + F.coalesce(c, F.lit(0))
    return out


def children_count(sons: Column, daughters: Column) -> Column:
    return F.when(sons.isNotNull() | daughters.isNotNull(), sum_defined(sons, daughters))


def family_size(*parts: Column) -> Column:
    """1 plus the parts; null if none is above 0."""
    total = sum_defined(*parts)
    return F.when(total > 0, total + 1)


def is_widow(*texts: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.concat_ws(" ", *texts))).contains(" widow").cast("int")


def is_canada(*texts: Column) -> Column:
    words = "|".join(w.replace(".", r"\.") for w in CANADA)
    return F.lower(F.concat_ws(" ", *texts)).rlike(words).cast("int")


def norm_place(c: Column) -> Column:
    return F.upper(F.regexp_replace(ws_trim(c), r"\s+", " "))


def norm_place_unbracketed(c: Column) -> Column:
    return norm_place(F.regexp_replace(c, r"\([^)]*\)", " "))


def word_key(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.upper(c), F.lit("([A-Z0-9]+)"), F.lit(1)), " ")


def compact_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def fold_accents(c: Column) -> Column:
    """Accented Latin letters as plain ones, inside codegen; ``nfkd_fold`` covers all of Unicode."""
    return F.translate(c, ACCENTED, PLAIN)


@F.pandas_udf(T.StringType())
def nfkd_fold(s: pd.Series) -> pd.Series:
    """Compatibility-decomposed text without combining marks."""
    return s.map(lambda t: None if t is None else "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)))


def normalise_text(c: Column) -> Column:
    t = F.translate(fold_accents(c), "’‘", "''")
    t = F.regexp_replace(t, r"[^A-Za-z0-9\s'-]", " ")
    return F.upper(ws_trim(F.regexp_replace(t, r"\s+", " ")))


def drop_brackets(c: Column) -> Column:
    """Without [..], (..) and ?; placeholders of dashes and dots become empty."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\[.*?\]", ""), r"\(.*?\)", ""), r"\?+", "")
    t = ws_trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(t.rlike(r"^[-\s.]*$"), "").otherwise(t)


def expand_forename(c: Column) -> Column:
    """Abbreviated given names written out, token by token."""
    book = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.coalesce(book[t], t)), " ")


def surname_key(c: Column) -> Column:
    """MAC as MC, both and O joined to the name."""
    t = F.regexp_replace(c, r"\b(MC|MAC) ", "$1")
    t = F.regexp_replace(t, r"^MAC", "MC")
    return F.regexp_replace(t, r"\bO['\s]", "O")


def split_person(c: Column, surname_first: bool = False) -> Column:
    """Struct(forename, surname); a single token is a surname."""
    tokens = F.filter(F.split(normalise_text(c), " "), lambda t: (t != "") & ~t.rlike(r"^[-.]+$"))
    n = F.size(tokens)
    sur = F.get(tokens, 0) if surname_first else F.element_at(tokens, -1)
    fore = F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))) if surname_first else F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return F.when(n > 0, F.struct(F.when(n > 1, expand_forename(F.array_join(fore, " "))).otherwise("").alias("forename"), surname_key(sur).alias("surname")))


def parse_year(c: Column) -> Column:
    """A year 1800-1999, else two digits 30-79 read as 1830-1879."""
    full = F.regexp_extract(c, r"\b(1[89]\d{2})\b", 1)
    short = F.regexp_extract(c, r"\b([3-7]\d)\b", 1)
    return F.coalesce(F.when(full != "", full.try_cast("int")), F.when(short != "", short.try_cast("int") + 1800))


def extract_year(c: Column) -> Column:
    y = F.regexp_extract(c, r"\b(18\d{2}|19[0-2]\d)\b", 1)
    return F.when(y != "", y.try_cast("int"))


def decade(c: Column) -> Column:
    return (F.floor(c / 10) * 10).cast("int")


def person_display(canonical: str, forename: str, surname: str) -> Column:
    joined = F.trim(F.concat(F.coalesce(F.trim(F.col(forename)), F.lit("")), F.lit(" "), F.coalesce(F.trim(F.col(surname)), F.lit(""))))
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(blank(F.trim(F.col(canonical))), blank(joined))


def strip_html(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return ws_trim(F.regexp_replace(t, r"\s+", " "))


def sanitise(c: Column, most: int) -> Column:
    """Without control characters (line ends and tabs stay), cut to ``most`` characters."""
    return F.substring(F.regexp_replace(c, r"[\p{Cc}&&[^\n\t]]", ""), 1, most)
