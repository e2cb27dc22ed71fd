"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A unit vector is turned by a fast pseudo-rotation, three rounds of random signs and a Hadamard transform,
and falls to the nearest signed axis. Each table has two such polytopes: the first axis names the bucket a vector is
stored in, once a table, and the second orders the vectors within it. A query probes the pairs of axes whose two
coordinates of the turned query sum to a threshold or more: it is sent to the buckets of the first axes, each time with the set
of pairs to look at. While there are few vectors, neighbouring first axes share a bucket, so that one has up to about ``BLOCK`` vectors and a table
``LEAST_BUCKETS``.

The threshold follows from the number of vectors, their dimension and the recall wanted (``threshold``): for directions that are
uniform on the sphere, the hardest case, the chance that a true neighbour's pair is probed in one of the tables is
``RECALL`` or more. Few vectors have no near neighbours (the twentieth of 10,000 random vectors of 64 numbers has a
cosine near 0.35), so most pairs are probed then; the share scored falls as the table grows.

The measure is the inner product, which long vectors win: vectors are indexed by *level*, the power of two of their norm,
each level with the threshold for its own number of vectors, and queries go to all levels.

Long buckets are cut into blocks of about ``BLOCK`` vectors and ``TURN`` queries, and every block of one meets
every block of the other, so a hot axis (say, copies of one vector) is spread over tasks and no bucket is capped. A block
keeps each query's ``top`` by the exact inner product; the best of all blocks follow by a ranking that
Spark limits before and after its shuffle. Vectors and queries travel packed, a row for each bucket and batch.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.runtime import drop_stored, ship, stored

TABLES = 3
RECALL = 0.91
BLOCK = 1 << 16
TURN = 1 << 13
QUERY_BLOCK = 512
LEAST_BUCKETS = 16
CELLS = 1 << 22
GATHER = 8192


def signs(dim: int, tables: int, seed: int = 11) -> np.ndarray:
    """Signs of each table's two rotations, three rounds each."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, 2, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows (their length is a power of two), without scale."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def rotate(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    for s in sign:
        x = hadamard(x * s) / np.sqrt(x.shape[1])
    return x


def _usable(column: pa.Array) -> tuple[list, np.ndarray]:
    """Vectors that are not null, empty or zero and are finite, as float64, and their rows."""
    rows, at = [], []
    for i, v in enumerate(column.to_numpy(zero_copy_only=False)):
        if v is None:
            continue
        v = np.asarray(v, np.float64)
        if len(v) and np.isfinite(v).all() and v.any():
            rows.append(v)
            at.append(i)
    return rows, np.array(at, np.int64)


def _padded(x: np.ndarray) -> np.ndarray:
    n = 1
    while n < x.shape[1]:
        n *= 2
    u = _scaled(x)[0]
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return np.pad(u, ((0, 0), (0, n - x.shape[1])))


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times a power of two that brings their largest component to between a half and 1, and its exponent: norms neither vanish nor overflow."""
    e = np.frexp(np.abs(x).max(axis=1))[1]
    return np.ldexp(x, -e[:, None]), e


def _level(x: np.ndarray) -> np.ndarray:
    """The power of two next above each norm."""
    y, e = _scaled(x)
    return e + np.frexp(np.linalg.norm(y, axis=1))[1]


def threshold(n: int, dim: int, top: int, tables: int, recall: float = RECALL) -> float:
    """Sum of two coordinates from which a pair of axes is probed, for n vectors of a (padded) dimension; -inf: all pairs.

    The ``top``-th of n uniform directions has cosine c with a query; a vector's own two axes have coordinates near the expected
    maximum m, so the query's there are normal with mean c * m and variance (1 - c * c) / dim each.
    """
    if n <= 8 * top:
        return -math.inf
    normal = NormalDist()
    c = min(0.99, max(0.0, normal.inv_cdf(1 - top / n) / math.sqrt(dim)))
    m = normal.inv_cdf(1 - 0.3 / dim) / math.sqrt(dim)
    one_table = 1 - (1 - recall) ** (1 / tables)
    return 2 * m * c + math.sqrt(2 * (1 - c * c) / dim) * normal.inv_cdf(1 - one_table)


def _axes(u: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    r = rotate(u, rotation)
    return np.concatenate([r, -r], axis=1)


def _by_dimension(batch):
    """(dimension, ids, vectors) of the usable vectors of a batch."""
    rows, at = _usable(batch.column(1))
    by_len: dict[int, list[int]] = {}
    for k, v in enumerate(rows):
        by_len.setdefault(len(v), []).append(k)
    for dim, ks in by_len.items():
        yield dim, batch.column(0).take(pa.array(at[ks])), np.stack([rows[k] for k in ks])


def _packed(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Vectors in 4 bytes a number where that is exact, else 8, and that width."""
    narrow = x.astype("<f4")
    return (narrow, 4) if (narrow == x).all() else (x.astype("<f8"), 8)


_KEY = ["dim", "level", "axis"]
_PACK = "dim int, level int, axis int, n int, salt long, width int, ids binary, vecs binary, extra binary"


def _rows(dim: int, level: int, axes: np.ndarray, ids: np.ndarray, x: np.ndarray, extra: np.ndarray) -> pa.RecordBatch:
    """A row for each axis with the ids, vectors and ``extra`` bytes of all that go there; ``axes`` are sorted."""
    packed, width = _packed(x)
    axis, cut = np.unique(axes, return_index=True)
    cut = [*cut.tolist(), len(axes)]
    spans = list(zip(cut, cut[1:]))
    n = len(spans)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, dim), pa.int32()), pa.array(np.full(n, level), pa.int32()), pa.array(axis, pa.int32()), pa.array(np.diff(cut), pa.int32()), pa.array(ids[cut[:-1]], pa.int64()), pa.array(np.full(n, width), pa.int32()),
            pa.array([ids[i:j].astype("<i8").tobytes() for i, j in spans], pa.binary()), pa.array([packed[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([extra[i:j].tobytes() for i, j in spans], pa.binary()),
        ],
        ["dim", "level", "axis", "n", "salt", "width", "ids", "vecs", "extra"],
    )


def _gathered(batches, size: int):
    """(dimension, ids, vectors) of ``size`` vectors or more at a time, to the end."""
    held: dict[int, list] = {}
    for batch in batches:
        for dim, ids, x in _by_dimension(batch):
            got = held.setdefault(dim, [])
            got.append((ids.to_numpy(), x))
            if sum(len(i) for i, _ in got) >= size:
                yield dim, np.concatenate([i for i, _ in got]), np.concatenate([v for _, v in got])
                held[dim] = []
    for dim, got in held.items():
        if got:
            yield dim, np.concatenate([i for i, _ in got]), np.concatenate([v for _, v in got])


def _index_rows(tables: int):
    """Rows of vectors by level, table and first axis; ``extra`` holds their pairs of axes (32 bits)."""

    def run(batches):
        for dim, ids, x in _gathered(batches, GATHER):
            u = _padded(x)
            level = _level(x)
            for t, (one, two) in enumerate(signs(u.shape[1], tables)):
                first, second = _axes(u, one).argmax(axis=1), _axes(u, two).argmax(axis=1)
                for v in np.unique(level):
                    k = np.flatnonzero(level == v)
                    k = k[np.argsort(first[k], kind="stable")]
                    pair = first[k].astype(np.int64) * 2 * u.shape[1] + second[k]
                    yield _rows(dim, int(v), t * 2 * u.shape[1] + first[k], ids[k], x[k], pair.astype("<i4")[:, None])

    return run


def folds(sizes: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """First axes that share a bucket, a power of two, for the vectors of each length and level."""
    out = {}
    for (dim, level), n in sizes.items():
        width = 2 << (dim - 1).bit_length()
        out[dim, level] = min(max(1, width // LEAST_BUCKETS), 1 << int(math.log2(max(1.0, BLOCK * width / max(1, n)))))
    return out


def _probe_rows(tables: int, limits: dict[tuple[int, int], float], fold: dict[tuple[int, int], int]):
    """Rows of queries by level, table and bucket; ``extra`` holds the pairs of axes to look at as bits."""

    def run(batches):
        for dim, ids, x in _gathered(batches, QUERY_BLOCK):
            u = _padded(x)
            width = 2 * u.shape[1]
            levels = [(v, limit) for (d, v), limit in limits.items() if d == dim]
            step = max(1, (1 << 24) // (width * width))  # queries whose pairs of axes are summed at a time
            for t, (one, two) in enumerate(signs(u.shape[1], tables)):
                a, b = _axes(u, one), _axes(u, two)
                for level, limit in levels:
                    for i in range(0, len(x), step):
                        want = a[i : i + step, :, None] + b[i : i + step, None, :] >= limit
                        want = want.reshape(len(want), width // fold[dim, level], -1)
                        bucket, q = np.nonzero(want.any(axis=2).T)
                        if len(q):
                            yield _rows(dim, level, t * (width // fold[dim, level]) + bucket, ids[i + q], x[i + q], np.packbits(want[q, bucket], axis=1))

    return run


def _unpacked(table: pa.Table, kind: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and the extra bytes (``width`` of ``kind`` each) of all rows."""
    dim = table.column("dim")[0].as_py()
    ids = np.concatenate([np.frombuffer(v.as_buffer(), "<i8") for v in table.column("ids")])
    vecs = [np.frombuffer(v.as_buffer(), f"<f{w}").reshape(-1, dim) for v, w in zip(table.column("vecs"), table.column("width").to_pylist())]
    extra = np.concatenate([np.frombuffer(v.as_buffer(), kind).reshape(-1, width) for v in table.column("extra")])
    return ids, np.concatenate(vecs).astype(np.float64), extra


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in order, so that equal vectors give equal numbers."""
    out = np.zeros(len(q))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(q.shape[1]):
            out += q[:, k] * x[:, k]
    return out


def _best(q_id, q, want, x_id, x, bounds, top):
    """Each query's ``top`` among the vectors of a block whose pair of axes it wants: (query, vector, score), ties to the smaller vec_id."""
    allowed = np.repeat(want, np.diff(bounds), axis=1) & (q_id[:, None] != x_id[None, :])
    with np.errstate(over="ignore", invalid="ignore"):
        if want.mean() > 0.3 or len(x) < 32 * np.count_nonzero(np.diff(bounds)):
            approx = q @ x.T
        else:
            approx = np.full((len(q), len(x)), -np.inf)
            for axis in np.flatnonzero(np.diff(bounds)):
                rows = np.flatnonzero(want[:, axis])
                if len(rows):
                    approx[rows, bounds[axis] : bounds[axis + 1]] = q[rows] @ x[bounds[axis] : bounds[axis + 1]].T
        approx[~allowed] = -np.inf
        if np.isnan(approx).any() or not np.isfinite(approx[allowed]).all():  # sums that overflow depend on their order: take the exact one
            approx = sum((q[:, k, None] * x[None, :, k] for k in range(q.shape[1])), np.zeros(approx.shape))
            approx[~allowed | np.isnan(approx)] = -np.inf
    k = min(top, approx.shape[1])
    kth = np.partition(approx, approx.shape[1] - k, axis=1)[:, -k][:, None]
    slack = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(kth), kth, 0)))
    i, j = np.nonzero((approx >= kth - slack) & allowed)
    s = exact_scores(q[i], x[j])
    order = np.lexsort((x_id[j], -np.where(np.isnan(s), -np.inf, s), i))
    i, j, s = i[order], j[order], s[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    keep = rank < top
    return q_id[i[keep]], x_id[j[keep]], s[keep]


def _meetings(index: DataFrame, probe: DataFrame, fold: dict[tuple[int, int], int], top: int) -> DataFrame:
    """query_id, vec_id, score of each block's best."""
    known = index.sparkSession.createDataFrame([(d, v, g) for (d, v), g in fold.items()], "dim int, level int, fold int")
    index = index.join(F.broadcast(known), ["dim", "level"]).withColumn("axis", F.floor(F.col("axis") / F.col("fold")).cast("int"))  # a row each length and level
    size = index.groupBy(*_KEY).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
    size = size.join(probe.groupBy(*_KEY).agg(F.ceil(F.sum("n") / TURN).cast("int").alias("turns")), _KEY)
    parts, turns = F.sequence(F.lit(0), F.col("parts") - 1), F.sequence(F.lit(0), F.col("turns") - 1)
    block, pack = F.xxhash64("salt", "n"), ["n", "width", "ids", "vecs", "extra"]
    spread = index.join(size, _KEY).select(*_KEY, F.pmod(block, F.col("parts")).cast("int").alias("part"), F.explode(turns).alias("turn"), *pack)
    asked = probe.join(size, _KEY).select(*_KEY, F.explode(parts).alias("part"), F.pmod(block, F.col("turns")).cast("int").alias("turn"), *pack)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        xi, x, pair = _unpacked(left, "<i4", 1)
        qi, q, bits = _unpacked(right, "u1", len(right.column("extra")[0].as_buffer()) // right.column("n")[0].as_py())
        want = np.unpackbits(bits, axis=1).astype(bool)
        cell = pair[:, 0] % want.shape[1]  # a bucket holds whole runs of first axes
        order = np.argsort(cell, kind="stable")
        xi, x = xi[order], x[order]
        bounds = np.searchsorted(cell[order], np.arange(want.shape[1] + 1))
        step = max(1, CELLS // len(x))  # queries whose scores are held at a time
        parts = [_best(qi[a : a + step], q[a : a + step], want[a : a + step], xi, x, bounds, top) for a in range(0, len(q), step)]
        return pa.table([pa.array(np.concatenate([p[c] for p in parts])) for c in range(3)], names=["query_id", "vec_id", "score"])

    group = [*_KEY, "part", "turn"]
    return spread.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(meet, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, top: int = 20, tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` largest inner products found for each query, nearest first.

    ``queries`` and ``vectors`` have vec_id (long) and embedding. Rows with a null vec_id, a null, empty or zero
    vector, or one that holds null or non-finite numbers take no part; vectors of another length than the
    query's are no candidates. A query's own vec_id is no candidate. Rows that repeat count once. A query that finds
    fewer than ``top`` is asked again over all pairs of axes, so it gets all candidates there are. Equal products go by the smaller
    vec_id. Components may be of any finite size: directions and levels come from scaled vectors, and a product that
    overflows is infinite (one that is not a number comes last).
    """
    ship(vectors.sparkSession)

    def usable(df):
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null and not exists(embedding, v -> v is null)")

    index = stored(usable(vectors).mapInArrow(_index_rows(tables), _PACK), "index")
    # A row for each length and level; each vector stands once in each table.
    sizes = {(r["dim"], r["level"]): r["n"] // tables for r in index.groupBy("dim", "level").agg(F.sum("n").alias("n")).collect()}
    limits = {k: threshold(n, 1 << (k[0] - 1).bit_length(), top, tables, recall) for k, n in sizes.items()}
    asked, fold = usable(queries), folds(sizes)
    if not sizes:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    probe = stored(asked.mapInArrow(_probe_rows(tables, limits, fold), _PACK), "probe")
    best = stored(_meetings(index, probe, fold, top).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
    if any(limit > -math.inf for limit in limits.values()):
        short = asked.join(best.groupBy("query_id").agg(F.count("*").alias("n")).where(f"n >= {top}").select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
        every = {k: -math.inf for k in limits}  # one table has all pairs
        again = short.mapInArrow(_probe_rows(1, every, fold), _PACK)
        more = _meetings(index.join(_first_table(index, sizes), ["dim", "axis"], "left_semi"), again, fold, top) if not short.isEmpty() else None
        if more is not None:
            best = stored(best.unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
    drop_stored(probe)
    order = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _first_table(index: DataFrame, sizes: dict[tuple[int, int], int]) -> DataFrame:
    """The axes (dim, axis) of the first table."""
    rows = [(dim, axis) for dim in sorted({d for d, _ in sizes}) for axis in range(2 << (dim - 1).bit_length())]
    return index.sparkSession.createDataFrame(rows, "dim int, axis int")
