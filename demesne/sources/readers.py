"""Readers: delimited text, feature collections, snapshots, dictionaries, triples."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demesne.functions import cleaning as C
from demesne.operators.upsert import unpivot_years

#: Cleaning of a typed delimited file: column -> kind.
KINDS = {"text": C.clean_text, "int": C.to_int, "float": C.to_float, "gender": C.clean_gender, "flag": C.to_flag, "place": C.norm_place}

#: Class words of the feature groups.
FEATURE_WORDS = {"ring_fort": ["ringfort", "ring-ditch", "ringwork", "ring-barrow", "hillfort"], "holy_well": ["holy well"]}


def find_file(name: str, folders: Iterable[str]) -> str | None:
    """The first of the folders that holds the file."""
    return next((str(Path(f) / name) for f in folders if (Path(f) / name).exists()), None)


def pick_column(columns: list[str], wanted: list[str]) -> str | None:
    """A header for any of the wanted names: the same without case, else one that contains it."""
    low = {c.strip().lower(): c for c in columns}
    for w in wanted:
        if w.lower() in low:
            return low[w.lower()]
    return next((c for w in wanted for c in columns if w.lower() in c.lower()), None)


def read_delimited(spark: SparkSession, path: str, kinds: dict[str, str], sep: str = ",") -> DataFrame:
    """Delimited text with a header, read as strings and cleaned column by column; absent columns are null."""
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    low = {c.strip().lower(): c for c in raw.columns}
    none = F.lit(None).cast("string")
    return raw.select(*[KINDS[k](F.col(f"`{low[c.lower()]}`") if c.lower() in low else none).alias(c) for c, k in kinds.items()])


def read_wide_census(spark: SparkSession, path: str, place: str = "Townland") -> DataFrame:
    """(place, year, kind, value) from columns ``<year> Male`` and the like; duplicates sum, never-seen stays null."""
    raw = spark.read.option("header", True).csv(path)
    numbers = [F.col(f"`{c}`") if c == place else C.to_int(F.col(f"`{c}`")).alias(c) for c in raw.columns]
    return unpivot_years(raw.select(*numbers), place, r"(\d{4}) (Male|Female|Inhabited|Uninhabited)")


_FEATURE = T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.StringType())])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry): one row a feature of GeoJSON files, properties as text, geometry as JSON text."""
    whole = spark.read.option("wholetext", True).text(path)
    features = F.from_json(F.get_json_object("value", "$.features"), T.ArrayType(T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.StringType())])))
    return whole.select(F.explode(features).alias("f")).select("f.properties", "f.geometry")


def point_features(features: DataFrame, classes: dict[str, list[str]] = FEATURE_WORDS, class_key: str = "monument_class") -> DataFrame:
    """(feature_group, name, lon, lat) of point features whose class holds one of a group's words, with coordinates in Ireland."""
    kind = F.lower(F.col("properties")[class_key])
    group = F.when(F.lit(False), "")
    for name, tokens in classes.items():
        hit = F.lit(False)
        for t in tokens:
            hit = hit | kind.contains(t)
        group = group.when(hit, name)
    xy = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<double>")
    out = features.select(group.alias("feature_group"), F.col("properties")["name"].alias("name"), xy[0].alias("lon"), xy[1].alias("lat"))
    return out.where("feature_group is not null and lat between 51 and 56 and lon between -11 and -4")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical_name) from a JSON map; a small dictionary file, read on the driver."""
    text = Path(path).read_text(encoding="utf-8")
    return spark.createDataFrame(sorted(json.loads(text).items()), "alias string, canonical_name string")


#: Fields of a reference snapshot and their kinds.
SNAPSHOT = {"name": "text", "barony": "text", "civil_parish": "text", "electoral_division": "text", "gaelic_name": "text", "area_ha": "float", "url": "text"}


def read_snapshot(spark: SparkSession, path: str, kinds: dict[str, str] = SNAPSHOT) -> DataFrame:
    """Rows of a snapshot: a JSON array or one object a line; absent fields are null, an absent file gives no rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = list(kinds)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raw = spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))
    else:
        raw = spark.read.option("multiLine", True).schema(", ".join(f"`{n}` string" for n in names)).json(path)
    return raw.select(*[KINDS[k](F.col(f"`{n}`")).alias(n) for n, k in kinds.items()])


def fingerprint(spark: SparkSession, path: str, version: str) -> str:
    """``version:time:size`` of a file or folder as its file system reports them; changes when the data do."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return f"{version}:absent"
    summary = system.getContentSummary(hadoop)
    return f"{version}:{system.getFileStatus(hadoop).getModificationTime()}:{summary.getLength()}"


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of one-triple-a-line Turtle or N-Triples text."""
    t = spark.read.text(path)
    pattern = r'^\s*(\S+)\s+(\S+)\s+("(?:[^"\\]|\\.)*"\S*|\S+)\s*\.\s*$'
    term = lambda i: F.regexp_replace(F.regexp_extract("value", pattern, i), r'^[<"]|[>"](?:\^\^\S+|@\S+)?$', "")
    return t.where(F.col("value").rlike(pattern) & ~F.col("value").startswith("@")).select(term(1).alias("s"), term(2).alias("p"), term(3).alias("o"))
