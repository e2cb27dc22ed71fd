"""Nearest vectors by products of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block of the searched table and of the questions; a product of two blocks takes 8 bytes a pair.
BLOCK, ASKED = 16_384, 512


def nearest_vectors(vectors: DataFrame, asked: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, nearest): for each row of ``asked`` the other key of ``vectors`` at the least squared distance, rounded to millionths; the smaller key on ties.

    Both tables are dealt into blocks; each pair of blocks is one matrix product, after which the pairs that rounding leaves open are summed
    exactly, term by term. A task holds one block of each, a row for each question and block goes on. Every pair is met: the work is the
    product of both tables by its nature. Components that are null count in no sum; distances that aren't numbers come after all others, unknown ones last.
    """
    spark = vectors.sparkSession
    v = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    a = asked.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    rows, width = v.agg(F.count("*"), F.max(F.size("x"))).first()
    width, questions = max(width or 0, 1), a.count()

    def packed(limit: int, copies: bool):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            ids, parts = [], []

            def block():
                i, x = np.concatenate(ids), np.concatenate(parts)
                if copies:  # of equal vectors two keys are enough: one of them is not the question's
                    same, keep = {}, []
                    for r in np.argsort(i, kind="stable"):
                        text = x[r].tobytes()
                        if (n := same.get(text, 0)) < 2:
                            same[text] = n + 1
                            keep.append(r)
                    i, x = i[keep], x[keep]
                return pa.RecordBatch.from_arrays([pa.array([i.tobytes()]), pa.array([x.tobytes()])], ["ids", "xs"])

            n = 0
            for batch in batches:
                x = np.full((batch.num_rows, width), np.nan)
                for r, row in enumerate(batch.column(1).to_pylist()):
                    # Unknown components have a bit pattern of their own, apart from those that aren't numbers.
                    row = [] if row is None else row
                    x[r].view(np.int64)[:] = 0x7FF8DEAD00000001
                    if row:
                        values = np.array([np.nan if c is None else c for c in row], dtype=float)
                        values[np.isnan(values)] = np.nan
                        x[r, : len(row)] = values
                        x[r].view(np.int64)[[k for k, c in enumerate(row) if c is None]] = 0x7FF8DEAD00000001
                ids.append(batch.column(0).to_numpy())
                parts.append(x)
                n += len(x)
                if n >= limit:
                    yield block()
                    ids, parts, n = [], [], 0
            if n:
                yield block()

        return run

    def met(batches):
        import numpy as np
        import pyarrow as pa

        unknown = np.int64(0x7FF8DEAD00000001)

        def distances(q, x):
            """Exact sums of pairs of rows, in the order of components; whether anything was summed."""
            out, known = np.zeros(len(q)), np.zeros(len(q), dtype=bool)
            for k in range(width):
                use = (q[:, k].view(np.int64) != unknown) & (x[:, k].view(np.int64) != unknown)
                d = q[:, k] - x[:, k]
                out += np.where(use, d * d, 0.0)
                known |= use
            return out, known

        for batch in batches:
            for q_id, q, x_id, x in zip(*(batch.column(c).to_pylist() for c in range(4))):
                q_id, x_id = np.frombuffer(q_id, dtype=np.int64), np.frombuffer(x_id, dtype=np.int64)
                q, x = np.frombuffer(q).reshape(-1, width), np.frombuffer(x).reshape(-1, width)
                with np.errstate(all="ignore"):
                    qq, xx = (q * q).sum(1), (x * x).sum(1)
                    plain, odd = np.flatnonzero(np.isfinite(xx)), np.flatnonzero(~np.isfinite(xx))
                    xs, high = x[plain], xx[plain].max(initial=0.0)
                    found = []
                    for start in range(0, len(q), 128):
                        part = slice(start, start + 128)
                        near = qq[part, None] + xx[plain] - 2 * (q[part] @ xs.T)
                        near[q_id[part, None] == x_id[plain]] = np.inf
                        least = near.min(1, initial=np.inf)
                        usable = np.isfinite(qq[part])
                        # What rounding to millionths or of the product may hide.
                        r, c = np.nonzero((near <= (least + 2e-6 + 1e-12 * (qq[part] + high))[:, None]) & np.isfinite(near) & usable[:, None])
                        found.append((r + start, plain[c]))
                        for k in np.flatnonzero(~usable):
                            found.append((np.full(len(plain), k + start), plain))
                        if len(odd):
                            n = len(q[part])
                            found.append((np.repeat(np.arange(n) + start, len(odd)), np.tile(odd, n)))
                    best = {}
                    for r, c in found:
                        for at in range(0, len(r), 65_536):
                            rr, cc = r[at : at + 65_536], c[at : at + 65_536]
                            d, known = distances(q[rr], x[cc])
                            d = np.floor(d * 1e6 + 0.5)
                            kind = np.where(known, np.isnan(d).astype(int), 2)
                            d = np.where(kind == 0, d, 0.0)
                            rr, kind, d, other = (u[q_id[rr] != x_id[cc]] for u in (rr, kind, d, x_id[cc]))
                            order = np.lexsort((other, d, kind, rr))
                            first = order[np.unique(rr[order], return_index=True)[1]]
                            for k, a, b, o in zip(rr[first].tolist(), kind[first].tolist(), d[first].tolist(), other[first].tolist()):
                                best[k] = min(best.get(k, (a, b, o)), (a, b, o))
                at = sorted(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_id[at]), pa.array([best[k][0] for k in at], pa.int32()), pa.array([best[k][1] for k in at], pa.float64()), pa.array([best[k][2] for k in at], pa.int64())], ["id", "kind", "d", "other"]
                )

    parts = lambda n, size: max(1, -(-n // size))
    spread = parts(spark.sparkContext.defaultParallelism, parts(questions, 4 * ASKED))  # few questions: smaller blocks, so that every core has one
    left = a.repartition(parts(questions, 4 * ASKED), "id").mapInArrow(packed(ASKED, False), "ids binary, xs binary").select(F.col("ids").alias("q_ids"), F.col("xs").alias("q_xs"))
    right = v.repartition(max(parts(rows, BLOCK), spread), "id").mapInArrow(packed(BLOCK, True), "ids binary, xs binary")
    pairs = right.hint("shuffle_replicate_nl").crossJoin(left).select("q_ids", "q_xs", "ids", "xs")
    best = pairs.mapInArrow(met, "id long, kind int, d double, other long").groupBy("id").agg(F.min(F.struct("kind", "d", "other")).alias("b"))
    return best.select("id", F.col("b.other").alias("nearest"))
