"""Writers: delimited exports with metadata, Turtle, append-if-new, feature files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_delimited(df: DataFrame, path: str, meta: dict[str, str] | None = None) -> None:
    """Delimited files with a header under ``path/data`` and their metadata as JSON under ``path/meta``."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/data")
    facts = {"columns": ",".join(df.columns), **(meta or {})}
    row = df.sparkSession.createDataFrame([tuple(str(v) for v in facts.values())], ", ".join(f"`{k}` string" for k in facts))
    row.write.mode("overwrite").json(f"{path}/meta")


def export_turtle(triples: DataFrame, path: str, base: str = "urn:demesne:") -> None:
    """(s, p, o) as one triple a line; quotes, backslashes and line ends escaped."""
    name = lambda c: F.concat(F.lit(f"<{base}"), F.regexp_replace(c, r'[\s<>"{}|\\^`]', "_"), F.lit(">"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), r"[\r\n]+", r"\\n")
    triples.select(F.concat(name(F.col("s")), F.lit(" "), name(F.col("p")), F.lit(' "'), text, F.lit('" .'))).write.mode("overwrite").text(path)


def export_snapshot(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls left out, for ``readers.read_snapshot`` without ``multiLine``."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys the stored table lacks; returns how many."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    fresh = df.dropDuplicates(keys)
    if exists:
        fresh = fresh.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def export_features(df: DataFrame, path: str, lon: str, lat: str, properties: list[str]) -> None:
    """One GeoJSON point feature a line."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)
