"""Readers and writers. Schemas are given, not inferred; blanks and sentinels become null at the scan."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path, schema: StructType | str, sep: str = ",", encoding: str = "UTF-8", skip_rows: int = 0, comma_decimals: list[str] | None = None) -> DataFrame:
    """CSV with a header. ``skip_rows`` leaves out that many lines (blank ones not counted) above it; ``comma_decimals`` names columns written 1,5."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    text = StructType.fromDDL(", ".join(f"`{f.name}` string" for f in schema))
    if skip_rows:
        # A file's rows are consecutive in its task, so row numbers count from the file's first row.
        lines = spark.read.schema(text).options(header=False, sep=sep, encoding=encoding).csv(path)
        lines = lines.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
        first = lines.where("_b = 0").groupBy("_f").agg(F.min("_i").alias("_first"))  # a row a file
        raw = lines.join(F.broadcast(first), "_f", "left").where((F.col("_b") > 0) | (F.col("_i") - F.col("_first") > skip_rows))
    else:
        raw = spark.read.schema(text).options(header=True, sep=sep, encoding=encoding).csv(path)
    commas = set(comma_decimals or [])
    out = []
    for f in schema:
        c = F.col(f"`{f.name}`")
        c = F.regexp_replace(c, ",", ".") if f.name in commas else c
        out.append(c.try_cast(f.dataType).alias(f.name))
    return raw.select(*out)


def read_csv_any(spark: SparkSession, path, schema, encodings=("UTF-8", "ISO-8859-1"), **kw) -> DataFrame:
    """The first encoding under which no replacement sign is read."""
    for e in encodings[:-1]:
        df = read_csv(spark, path, schema, encoding=e, **kw)
        texts = [c for c, t in df.dtypes if t == "string"]
        bad = F.lit(False)
        for c in texts:
            bad = bad | F.coalesce(F.col(f"`{c}`").contains("�"), F.lit(False))
        if df.where(bad).isEmpty():
            return df
    return read_csv(spark, path, schema, encoding=encodings[-1], **kw)


def read_csv_folder(spark: SparkSession, path: str, schema, **kw) -> DataFrame:
    """All CSV files of a folder, with ``source_file`` (its name without ending)."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    df = spark.read.schema(schema).options(header=True, **kw).csv(path)
    return df.withColumn("source_file", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1))


def read_parquet(spark: SparkSession, path) -> DataFrame:
    """Parquet without left-over index columns."""
    df = spark.read.parquet(path)
    return df.drop(*[c for c in df.columns if "Unnamed" in c])


def read_geojson(spark: SparkSession, path, properties: str) -> DataFrame:
    """One row a feature: the properties (a DDL string), ``parts`` (all polygons, each with its outer ring and holes, of points x, y) and
    ``ring``, the outer ring of the first polygon."""
    schema = f"features array<struct<properties:struct<{properties}>, geometry:struct<type:string, coordinates:string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    one = F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>", {"mode": "PERMISSIVE"})
    polygons = F.when(F.col("f.geometry.type") == "Polygon", one).when(F.col("f.geometry.type") == "MultiPolygon", many)
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    parts = F.transform(polygons, lambda rings: F.transform(rings, lambda ring: F.transform(ring, point)))
    return raw.select("f.properties.*", parts.alias("parts")).withColumn("ring", F.get(F.get("parts", F.lit(0)), F.lit(0)))


def read_series_payload(df: DataFrame, column: str, series: int = 1) -> DataFrame:
    """Points of one series of an API answer ``{"data": [{"data": [[ms, value], ...]}, ...]}``: (time, value)."""
    parsed = F.from_json(column, "data array<struct<data:array<array<double>>>>")
    points = df.select(F.explode(F.get(parsed["data"], F.lit(series))["data"]).alias("p"))
    return points.select(F.timestamp_millis(F.get("p", F.lit(0)).cast("bigint")).alias("time"), F.get("p", F.lit(1)).alias("value"))


def read_office(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Excel or Stata by pandas on the driver, for files of that size; needs pandas' own reader for the format."""
    import pandas as pd

    pdf = pd.read_stata(path, **kw) if path.endswith(".dta") else pd.read_excel(path, **kw)
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None))


def ingest_once(spark: SparkSession, target: str, make) -> DataFrame:
    """Parquet at ``target``, made from ``make()`` only if it isn't there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(target)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.parquet(target)
    return spark.read.parquet(target)


def read_config(path: str) -> dict:
    """Nested settings from JSON, or from YAML where a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        if os.path.splitext(path)[1] == ".json":
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


def write_csv(df: DataFrame, path: str, date_format: str = "yyyy-MM-dd") -> None:
    df.write.mode("overwrite").options(header=True, dateFormat=date_format).csv(path)


def write_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    w = df.write.mode("overwrite").option("compression", "snappy")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def geojson_lines(df: DataFrame, ring: str = "ring") -> DataFrame:
    """One GeoJSON feature a row (``value``), ready for ``write.text``; several ``parts`` as a MultiPolygon."""
    parts = F.col("parts") if "parts" in df.columns else F.array(F.array(ring))
    props = F.struct(*[F.col(c) for c in df.columns if c not in (ring, "parts")])
    coords = F.transform(parts, lambda part: F.transform(part, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    single = F.size(parts) == 1
    shape = F.concat(
        F.lit('{"type":"'), F.when(single, "Polygon").otherwise("MultiPolygon"), F.lit('","coordinates":'), F.when(single, F.to_json(F.get(coords, F.lit(0)))).otherwise(F.to_json(coords)), F.lit("}")
    )
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(props), F.lit(',"geometry":'), shape, F.lit("}")).alias("value"))


def write_geojson(df: DataFrame, path: str, ring: str = "ring", collection: bool = False) -> None:
    """Features as lines in parts, or, for a table of one file's size, as one FeatureCollection."""
    lines = geojson_lines(df, ring)
    if not collection:
        return lines.write.mode("overwrite").text(path)
    kind = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}"))
    lines.agg(kind.alias("value")).write.mode("overwrite").text(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A few rows of metrics as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)
