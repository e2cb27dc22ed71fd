"""Shapefiles: what is written is read again, by several tasks, and files made by hand are read."""

import datetime
import os
import struct
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from vigil.functions import geo
from vigil.sources import readers, shapefile

KIND = "name string, n long, v double, day date, ok boolean, parts array<array<array<struct<x: double, y: double>>>>"


def ring(x, y, w, turned=False):
    out = [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    return [(float(a), float(b)) for a, b in (out[::-1] if turned else out)]


ROWS = [
    ("é one", 1, 0.5, datetime.date(2020, 2, 29), True, [[ring(0, 0, 10), ring(2, 2, 3)], [ring(20, 0, 4, True), ring(21, 1, 1, True)]]),
    ("", -5, -1e-300, None, False, [[ring(0, 0, 1)]]),
    (None, None, None, None, None, None),
    ("two", 10**17, 1.0000000000000002, datetime.date(1999, 12, 31), None, [[ring(5, 5, 1, True)]]),
] * 60


def areas(df):
    return sorted((r.name or "", r.n or 0, round(r.s, 9) if r.s is not None else None, len(r.parts or []), sum(map(len, r.parts or []))) for r in df.withColumn("s", geo.parts_area(F.col("parts"))).collect())


def test_round_trip_in_parallel(spark, tmp_path):
    df = spark.createDataFrame(ROWS, KIND).repartition(3)
    shapefile.write_shapefile(df, str(tmp_path / "out"))
    back = shapefile.read_shapefile(spark, str(tmp_path / "out"), records=7)
    assert back.rdd.getNumPartitions() >= 240 // 7 and back.count() == len(ROWS)
    assert sorted(map(str, back.select("name", "n", "v", "day", "ok").collect())) == sorted(map(str, df.select(F.when(F.col("name") != "", F.col("name")).alias("name"), "n", "v", "day", "ok").collect()))
    assert areas(back) == areas(df)
    hand = back.where("n = 1").first()
    assert [len(p) for p in hand.parts] == [2, 2] and {q.x for q in hand.parts[0][1]} == {2.0, 5.0}
    shapefile.write_shapefile(df.limit(0), str(tmp_path / "out"))  # replaces it
    assert shapefile.read_shapefile(spark, str(tmp_path / "out")).count() == 0


def test_equal_to_the_geojson_of_the_same_shapes(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:2], KIND).select("n", "parts")
    readers.write_geojson(df, str(tmp_path / "g"), collection=True)
    shapefile.write_shapefile(df, str(tmp_path / "s"))
    flat = lambda d: sorted((r.n, sorted(sorted({(p.x, p.y) for p in x}) for part in r.parts for x in part)) for r in d.collect())
    assert flat(readers.read_geojson(spark, str(tmp_path / "g"), "n long")) == flat(shapefile.read_shapefile(spark, str(tmp_path / "s")))


def test_file_made_by_hand(spark, tmp_path):
    """Points in metres of the zone with a projection file, attributes in another encoding, records out of order."""
    base = str(tmp_path / "p")
    bodies = [struct.pack("<idd", 1, 500000.0 + i * 1000, 7790000.0) for i in range(3)]
    records = [struct.pack(">ii", i + 1, 10) + b for i, b in enumerate(bodies)]
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<ii8d", 1000, 1, *[0.0] * 8)
    open(base + ".shp", "wb").write(head(50 + 3 * 14) + records[2] + records[0] + records[1])
    open(base + ".shx", "wb").write(head(50 + 12) + b"".join(struct.pack(">ii", 50 + 14 * k, 10) for k in (1, 2, 0)))
    open(base + ".dbf", "wb").write(struct.pack("<4BIHH20x", 3, 100, 1, 1, 3, 65, 7) + b"TXT\0\0\0\0\0\0\0\0C\0\0\0\0\x06\0" + b"\0" * 14 + b"\r" + b" caf\xe9  " + b" b     " + b"       ")
    open(base + ".prj", "w").write('PROJCS["UTM_Zone_23S", PROJECTION["Transverse_Mercator"],PARAMETER["False_Northing",10000000.0],PARAMETER["Central_Meridian",-45.0]]')
    got = sorted(shapefile.read_shapefile(spark, base + ".shp").collect())
    assert [r.TXT for r in got] == ["café", "b", None] and [r.record for r in got] == [0, 1, 2]
    assert abs(got[0].x + 45) < 1e-9 and got[0].y == pytest.approx(-19.98, abs=0.02) and got[1].x > got[0].x
    assert shapefile.read_shapefile(spark, base + ".shp", degrees=False).where("record = 2").first().x == 502000.0
    open(base + ".prj", "w").write('PROJCS["other"]')
    with pytest.raises(ValueError, match="projection"):
        shapefile.read_shapefile(spark, base + ".shp")


def test_names_and_values_that_do_not_fit(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:1], KIND)
    with pytest.raises(Exception, match="10 characters"):
        shapefile.write_shapefile(df.withColumnRenamed("name", "a_long_name"), str(tmp_path / "x"))
    with pytest.raises(Exception, match="more than 254 bytes"):
        shapefile.write_shapefile(df.withColumn("name", F.repeat("name", 200)), str(tmp_path / "y"))


def test_workers_without_the_package(spark, tmp_path):
    shapefile.write_shapefile(spark.createDataFrame(ROWS[:4], KIND), str(tmp_path / "s"))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from vigil.sources import shapefile
print("rows", shapefile.read_shapefile(s, {str(tmp_path / "s")!r}).count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert "rows 4" in out.stdout, out.stderr[-1500:]
