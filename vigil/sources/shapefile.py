"""Shapefiles as a Spark data source: records read in parallel by the offsets of the index file, written a file a task.

A set is ``name.shp`` (shapes), ``name.shx`` (each record's offset), ``name.dbf`` (attributes in records of fixed width), and by choice
``name.cpg`` (encoding) and ``name.prj`` (projection). Only headers are read to plan; a task reads its own stretch of the
index, of the attributes and of the shapes. Paths may be whatever ``pyarrow.fs`` opens.

Numbers of the formats (ESRI white paper of 1998, dBASE III) are little-endian but for record headers. The module travels with
its functions, so workers need no copy of this package.
"""

from __future__ import annotations

import datetime
import struct
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# Shape types that are points or polygons (plain, with z, with m), file code and version.
POINTS, POLYGONS, CODE, VERSION = (1, 11, 21), (5, 15, 25), 9994, 1000
#: Records a task reads unless the option ``records`` says otherwise.
RECORDS = 50_000
PARTS = "parts array<array<array<struct<x: double, y: double>>>>"


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _bytes(path: str, start: int = 0, size: int | None = None) -> bytes:
    system, name = _system(path)
    with system.open_input_file(name) as f:
        return f.read_at(f.size() - start if size is None else size, start)


def _files(path: str) -> list[str]:
    """The .shp files of a path: itself, or those of a folder."""
    from pyarrow import fs

    system, name = _system(path)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = sorted(f.path for f in system.get_file_info(fs.FileSelector(name)) if f.path.lower().endswith(".shp"))
    if not found:
        raise ValueError(f"no .shp file in {path}")
    return [f if path == name else path.rstrip("/") + "/" + f.rsplit("/", 1)[1] for f in found]


def _beside(shp: str, ending: str) -> str:
    return shp[:-4] + (ending.upper() if shp.endswith(".SHP") else ending)


def _exists(path: str) -> bool:
    from pyarrow import fs

    system, name = _system(path)
    return system.get_file_info(name).type == fs.FileType.File


def shape_type(shp: str) -> int:
    head = _bytes(shp, 0, 100)
    if len(head) < 100 or struct.unpack(">i", head[:4])[0] != CODE:
        raise ValueError(f"{shp} is no shapefile")
    return struct.unpack("<i", head[32:36])[0]


def fields(dbf: str) -> tuple[list[tuple[str, str, int, int, int]], int, int, int]:
    """(name, kind, offset in a record, width, decimals) of each field; number of records, bytes before them, bytes of each."""
    count, before, width = struct.unpack("<IHH", _bytes(dbf, 4, 8))
    head, out, at = _bytes(dbf, 32, before - 32), [], 1
    for i in range(0, len(head) - 31, 32):
        if head[i] == 0x0D:
            break
        name = head[i : i + 11].split(b"\0")[0].decode("ascii", "replace")
        out.append((name, chr(head[i + 11]), at, head[i + 16], head[i + 17]))
        at += head[i + 16]
    return out, count, before, width


def kind_of(kind: str, width: int, decimals: int) -> str:
    return {"D": "date", "L": "boolean", "F": "double"}.get(kind) or (("double" if decimals or width > 18 else "long") if kind == "N" else "string")


def value(raw: bytes, kind: str, encoding: str):
    """One attribute; blanks and what doesn't parse are null."""
    text = raw.decode(encoding, "replace").strip("\0 ")
    if not text:
        return None
    try:
        if kind == "long":
            return int(text)
        if kind == "double":
            return float(text)
        if kind == "date":
            return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
    except ValueError:
        return None
    return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper()) if kind == "boolean" else text


def _turn(x: np.ndarray, y: np.ndarray) -> float:
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum())


def _holds(x: np.ndarray, y: np.ndarray, px: float, py: float) -> bool:
    over = (y[:-1] > py) != (y[1:] > py)
    a, b, c, d = x[:-1][over], y[:-1][over], x[1:][over], y[1:][over]
    return bool((px < a + (py - b) * (c - a) / (d - b)).sum() % 2)


def polygons(body: bytes) -> list | None:
    """Polygons of rings of a record's body: outer rings run clockwise, a hole goes to the smallest outer ring around it."""
    kind = struct.unpack("<i", body[:4])[0]
    if kind == 0:
        return None
    n, m = struct.unpack("<ii", body[36:44])
    starts = [*np.frombuffer(body, "<i4", n, 44).tolist(), m]
    xy = np.frombuffer(body, "<f8", 2 * m, 44 + 4 * n).reshape(-1, 2)
    rings = [xy[a:b] for a, b in zip(starts, starts[1:]) if b > a]
    outer = [r for r in rings if _turn(r[:, 0], r[:, 1]) <= 0]
    holes = [r for r in rings if _turn(r[:, 0], r[:, 1]) > 0]
    if not outer:
        outer, holes = rings, []
    parts = [[o] for o in outer]
    size = [abs(_turn(o[:, 0], o[:, 1])) for o in outer]
    for h in holes:
        around = [i for i, o in enumerate(outer) if _holds(o[:, 0], o[:, 1], float(h[:-1, 0].mean()), float(h[:-1, 1].mean())) or _holds(o[:, 0], o[:, 1], *h[0].tolist())]
        if around:
            parts[min(around, key=lambda i: size[i])].append(h)
        else:  # a ring drawn the other way, in no other: a polygon of its own
            parts.append([h])
    return [[[tuple(p) for p in ring.tolist()] for ring in part] for part in parts]


class Stretch(InputPartition):
    def __init__(self, shp: str, first: int, count: int):
        self.shp, self.first, self.count = shp, first, count


class ShapefileReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.names, self.options = [f.name for f in schema], options

    def partitions(self):
        size = int(self.options.get("records", RECORDS))
        out = []
        for shp in _files(self.options["path"]):
            length = struct.unpack(">i", _bytes(_beside(shp, ".shx"), 24, 4))[0]
            n = (2 * length - 100) // 8
            out += [Stretch(shp, i, min(size, n - i)) for i in range(0, n, size)]
        return out or [Stretch("", 0, 0)]  # Spark wants one

    def read(self, partition):
        if not partition.count:
            return
        shp, first, count = partition.shp, partition.first, partition.count
        index = np.frombuffer(_bytes(_beside(shp, ".shx"), 100 + 8 * first, 8 * count), ">i4").reshape(-1, 2).astype(np.int64) * 2
        known, total, before, width = fields(_beside(shp, ".dbf"))
        rows = _bytes(_beside(shp, ".dbf"), before + first * width, max(0, min(count, total - first)) * width)
        encoding = self.options.get("encoding") or (_bytes(_beside(shp, ".cpg")).decode("ascii").strip() if _exists(_beside(shp, ".cpg")) else "ISO-8859-1")
        wanted = {n: (kind_of(k, w, d), at, w) for n, k, at, w, d in known}
        point = shape_type(shp) in POINTS
        system, name = _system(shp)
        with system.open_input_file(name) as f:
            step = 1024
            for i in range(0, len(index), step):
                part = index[i : i + step]
                low, high = int(part[:, 0].min()), int((part[:, 0] + part[:, 1]).max()) + 8
                close = high - low <= 4 * (int(part[:, 1].sum()) + 8 * len(part))  # records in file order: one read
                block = f.read_at(high - low, low) if close else b""
                for j, (at, size) in enumerate(part.tolist()):
                    body = block[at - low + 8 : at - low + 8 + size] if close else f.read_at(size, at + 8)
                    record = rows[(i + j) * width : (i + j + 1) * width]
                    out = []
                    for n in self.names:
                        if n == "record":
                            out.append(first + i + j)
                        elif n == "parts":
                            out.append(polygons(body))
                        elif n in ("x", "y") and point:
                            out.append(None if body[:4] == b"\0\0\0\0" else struct.unpack("<d", body[4:12] if n == "x" else body[12:20])[0])
                        else:
                            kind, start, size = wanted[n]
                            out.append(value(record[start : start + size], kind, encoding))
                    yield tuple(out)


def _dbf_field(name: str, kind: str) -> tuple[str, int, int]:
    """Kind, width and decimals of a column."""
    if len(name) > 10:
        raise ValueError(f"names of attributes have 10 characters at most: {name!r}")
    try:
        return {"string": ("C", 254, 0), "bigint": ("N", 18, 0), "int": ("N", 11, 0), "double": ("F", 25, 15), "date": ("D", 8, 0), "boolean": ("L", 1, 0)}[kind]
    except KeyError:
        raise ValueError(f"no attribute of type {kind}") from None


def _text(v, kind: str, width: int) -> bytes:
    if v is None:
        raw = b""
    elif kind == "D":
        raw = v.strftime("%Y%m%d").encode()
    elif kind == "L":
        raw = b"T" if v else b"F"
    elif kind == "F":
        raw = repr(float(v)).encode()
    else:
        raw = str(v).encode()
    if len(raw) > width:
        raise ValueError(f"{v!r} has more than {width} bytes")
    return raw.rjust(width) if kind in "NF" else raw.ljust(width)


def polygon_body(parts) -> bytes:
    """A record's body of polygons of rings; the first ring of each is turned clockwise, the others the other way."""
    if parts is None:
        return struct.pack("<i", 0)
    rings = []
    for part in parts:
        for k, ring in enumerate(part):
            a = np.array([(p["x"], p["y"]) for p in ring], "<f8").reshape(-1, 2)
            rings.append(a[::-1] if len(a) and (_turn(a[:, 0], a[:, 1]) > 0) == (k == 0) else a)
    xy = np.concatenate(rings) if rings else np.zeros((0, 2), "<f8")
    box = [*xy.min(0), *xy.max(0)] if len(xy) else [0.0] * 4
    starts = np.cumsum([0, *(len(r) for r in rings)])[:-1].astype("<i4")
    return struct.pack("<i4dii", 5, *box, len(rings), len(xy)) + starts.tobytes() + xy.tobytes()


class ShapefileWriter(DataSourceWriter):
    """A set of files a task, ``part-<task>.*``, whose sizes are known once all its records are written."""

    def __init__(self, schema: StructType, options, overwrite: bool):
        self.names = [f.name for f in schema if f.name != "parts"]
        self.kinds = [_dbf_field(f.name, f.dataType.simpleString()) for f in schema if f.name != "parts"]
        self.path, self.overwrite = options["path"], overwrite
        from pyarrow import fs

        system, name = _system(self.path)
        if system.get_file_info(name).type == fs.FileType.Directory:
            if not overwrite:
                raise ValueError(f"{self.path} exists")
            for f in system.get_file_info(fs.FileSelector(name)):
                system.delete_file(f.path)

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        system, name = _system(self.path)
        system.create_dir(name, recursive=True)
        base = f"{name.rstrip('/')}/part-{task.partitionId():05d}"
        index, at, n = [], 50, 0
        low, high = np.full(2, np.inf), np.full(2, -np.inf)
        written = f"{base}.{task.taskAttemptId()}"
        with system.open_output_stream(written + ".s") as shapes, system.open_output_stream(written + ".d") as rows:
            for row in iterator:
                body = polygon_body(row["parts"])
                n += 1
                shapes.write(struct.pack(">ii", n, len(body) // 2) + body)
                rows.write(b" " + b"".join(_text(row[c], k, w) for c, (k, w, _) in zip(self.names, self.kinds)))
                index.append((at, len(body) // 2))
                at += 4 + len(body) // 2
                if len(body) > 4:
                    box = np.array(struct.unpack("<4d", body[4:36]))
                    low, high = np.minimum(low, box[:2]), np.maximum(high, box[2:])
        box = [*low, *high] if np.isfinite(low).all() else [0.0] * 4

        def head(words: int) -> bytes:
            return struct.pack(">7i", CODE, 0, 0, 0, 0, 0, words) + struct.pack("<ii8d", VERSION, 5, *box, 0, 0, 0, 0)

        described = b"".join(c.encode("ascii").ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for c, (k, w, d) in zip(self.names, self.kinds))
        width = 1 + sum(w for _, w, _ in self.kinds)
        starts = {".shp": head(at), ".dbf": struct.pack("<4BIHH20x", 3, 100, 1, 1, n, 33 + len(described), width) + described + b"\r"}
        for ending, body in ((".shp", written + ".s"), (".dbf", written + ".d")):
            with system.open_output_stream(base + ending) as out, system.open_input_stream(body) as f:
                out.write(starts[ending])
                while block := f.read(1 << 20):
                    out.write(block)
            system.delete_file(body)
        with system.open_output_stream(base + ".shx") as out:
            out.write(head(50 + 4 * n) + np.array(index, ">i4").tobytes())
        with system.open_output_stream(base + ".cpg") as out:
            out.write(b"UTF-8")
        return WriterCommitMessage()


class ShapefileSource(DataSource):
    """``spark.read.format("shapefile").load(path)``; options ``encoding`` and ``records`` (of a task)."""

    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        shp = _files(self.options["path"])[0]
        kind = shape_type(shp)
        if kind not in POINTS + POLYGONS:
            raise ValueError(f"shapes of type {kind} are not read")
        known = [f"`{n}` {kind_of(k, w, d)}" for n, k, _, w, d in fields(_beside(shp, ".dbf"))[0]]
        return ", ".join(["record long", *known, PARTS if kind in POLYGONS else "x double, y double"])

    def reader(self, schema):
        return ShapefileReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return ShapefileWriter(schema, dict(self.options), overwrite)


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_shapefile(spark: SparkSession, path: str, degrees: bool = True, **options) -> DataFrame:
    """Records of a shapefile or a folder of them: ``record`` (its number in its file), the attributes and ``parts`` (or x, y of points).

    With ``degrees``, shapes of the projected zone (by the .prj file beside them) become degrees; a projection that isn't known raises.
    """
    from vigil.functions import geo

    spark.dataSource.register(ShapefileSource)
    df = spark.read.format("shapefile").options(**options).load(path)
    prj = _beside(_files(path)[0], ".prj")
    text = _bytes(prj).decode("ascii", "replace").replace(" ", "") if _exists(prj) else ""
    if not degrees or not text.startswith("PROJCS"):
        return df
    if "Transverse_Mercator" not in text or '"Central_Meridian",-45' not in text or '"False_Northing",10000000' not in text:
        raise ValueError(f"the projection of {prj} is not known")

    def point(x, y):
        lat, lon = geo.utm_to_degrees(x, y)
        return lon.alias("x"), lat.alias("y")

    if "parts" not in df.columns:
        lon, lat = point(F.col("x"), F.col("y"))
        return df.withColumns({"x": lon, "y": lat})
    return df.withColumn("parts", F.transform("parts", lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct(*point(p["x"], p["y"]))))))


def write_shapefile(df: DataFrame, path: str) -> None:
    """A folder of shapefiles, one a partition, of ``parts`` (or a ``ring``) and attributes; it replaces what stands there."""
    df.sparkSession.dataSource.register(ShapefileSource)
    if "parts" not in df.columns:
        df = df.withColumn("parts", F.array(F.array("ring"))).drop("ring")
    df.write.format("shapefile").mode("overwrite").save(path)
