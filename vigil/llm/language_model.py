"""Bigram language model by deleted interpolation, with counts too large for one machine.

p(w | v) = a_b c(v w) / c(v) + b_b c(w) / N + g_b / (V + 1), where the mixture weights of a bucket b of context
frequencies (powers of two of c(v)) are learned by expectation-maximisation on held-out counts: each training
token is held out of its own counts ("deleted"), so its estimates are (c(v w) - 1) / (c(v) - 1) and
(c(w) - 1) / (N - 1).

Counts are exact (64 bits) and never gathered on one machine. Texts are cut into chunks of about ``CHUNK_BYTES``; a
chunk sends each of its distinct words and bigrams once, with its training count, to the range of hashes
that owns it, and gets the corpus count back in the same order. Blobs are sorted hashes as differences,
byte planes first, so a bigram costs about five bytes. The number of ranges follows the number of
chunks, so what a range holds stays the same: the entries of all chunks that fall into it. A chunk has a row for each range
it has an entry in, so rows are never more than entries, and entries grow with the text; up to about 1 TB rows are
far fewer, and blobs shrink to single entries beyond. A frequent word is one entry a chunk, never a hot
key. Words are known by 64-bit hashes, bigrams by 56 bits: among 1e11 distinct bigrams about one in a million shares
its hash with another.

Expectation-maximisation reads a table of estimates: a token's two estimates are rounded to a quarter of an octave and held above
2**-30 and 2**-40, so its size is fixed. Scores use the exact estimates; what the rounding of the weights' training
costs is under 0.1 % of the log probability (tested).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textcore as tc
from vigil.llm.runtime import ship, stored

CHUNK_BYTES = 8 << 20
END = tc.U64(0xA24BAED4963EE407)
BUCKETS = 32
STEPS = 4  # cells an octave in the table of estimates
Q2, Q1 = 30 * STEPS, 40 * STEPS
WORDS, PAIRS = 0, 1


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes, led by their count and width."""
    x = np.ascontiguousarray(x)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T) if len(x) else np.zeros((x.itemsize, 0), np.uint8)
    used = x.itemsize
    while used > 1 and not planes[used - 1].any():
        used -= 1
    body = b"".join(pack for p in planes[:used] for pack in _framed(p))
    return np.array([len(x), x.itemsize, used], "<u4").tobytes() + body


def _framed(plane: np.ndarray):
    z = pa.compress(pa.py_buffer(plane.tobytes()), codec="zstd", asbytes=True) if len(plane) else b""
    yield np.array([len(z)], "<u4").tobytes()
    yield z


def unpack_numbers(raw: bytes) -> np.ndarray:
    n, item, used = np.frombuffer(raw, "<u4", 3)
    out = np.zeros((int(item), int(n)), np.uint8)
    at = 12
    for k in range(int(used)):
        size = int(np.frombuffer(raw, "<u4", 1, at)[0])
        at += 4
        if size:
            out[k] = np.frombuffer(pa.decompress(raw[at : at + size], decompressed_size=int(n), codec="zstd", asbytes=True), np.uint8)
        at += size
    return np.ascontiguousarray(out.T).view(f"<u{int(item)}").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack_numbers(np.diff(x, prepend=tc.U64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(raw), dtype=tc.U64)


def bigram_hashes(h: np.ndarray) -> np.ndarray:
    """For each token, a 56-bit hash of it and the token before (the first follows an end)."""
    before = np.empty_like(h)
    if len(h):
        before[0] = END
        before[1:] = h[:-1]
    return tc.mix(before * tc.U64(0x9FB21C651E98DF25) + (h ^ (h >> tc.U64(29))) * tc.U64(0xD6E8FEB86659FD93)) >> tc.U64(8)


def _by_frequency(counts: np.ndarray) -> np.ndarray:
    """Positions of a chunk's words, most frequent first."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _chunks(batches):
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    held, size = [], 0

    def out():
        ids = pa.concat_arrays([x[0] for x in held])
        train = np.concatenate([x[1] for x in held])
        lens = np.concatenate([x[2] for x in held])
        h = np.concatenate([x[3] for x in held])
        words, code, count = np.unique(h, return_inverse=True, return_counts=True)
        rank = np.empty(len(words), np.uint32)
        rank[_by_frequency(count)] = np.arange(len(words), dtype=np.uint32)
        one = lambda x, t: pa.array([x], t)
        return pa.RecordBatch.from_arrays(
            [one(chunk, pa.int64()), pa.ListArray.from_arrays(np.array([0, len(ids)], np.int32), ids), one(np.packbits(train).tobytes(), pa.binary()), one(pack_numbers(lens.astype(np.uint32)), pa.binary()),
             one(pack_sorted(words), pa.binary()), one(pack_numbers(count.astype(np.uint32)), pa.binary()), one(pack_numbers(rank[code]), pa.binary())],
            ["chunk", "doc_ids", "train", "lens", "words", "counts", "codes"],
        )

    for batch in batches:
        flags = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for i, buf, off in tc.blocks(batch.column(1)):
            h, first, _, _ = tc.word_hashes(tc.lower(buf), off)
            n = len(off) - 1
            held.append((batch.column(0).slice(i, n), flags[i : i + n], np.diff(first) + 1, np.insert(h, first[1:], END)))
            size += len(buf) + n
            if size >= CHUNK_BYTES:
                yield out()
                chunk, held, size = chunk + 1, [], 0
    if held:
        yield out()


class _Chunk:
    """A row of the chunk table, unpacked."""

    def __init__(self, train, lens, words, counts, codes):
        self.lens = unpack_numbers(lens).astype(np.int64)
        self.train = np.unpackbits(np.frombuffer(train, np.uint8), count=len(self.lens)).astype(bool)
        self.words = unpack_sorted(words)
        self.code = _by_frequency(unpack_numbers(counts))[unpack_numbers(codes)]
        self.of_token = np.repeat(self.train, self.lens)
        pairs = bigram_hashes(self.words[self.code])
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)


_COLUMNS = ["train", "lens", "words", "counts", "codes"]


def _ranges(bits: int):
    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                c = _Chunk(*(batch.column(k + 1)[r].as_py() for k in range(5)))
                for kind, keys, code, width in ((WORDS, c.words, c.code, 64), (PAIRS, c.pairs, c.pair, 56)):
                    count = np.bincount(code[c.of_token], minlength=len(keys)).astype(np.uint64)
                    rows, cut = np.unique(keys >> tc.U64(width - bits), return_index=True)
                    bounds = list(zip(cut.tolist(), [*cut[1:].tolist(), len(keys)]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(rows), pa.int32()), pa.array(rows.astype(np.int32)), pa.array([batch.column(0)[r].as_py()] * len(rows), pa.int64()),
                         pa.array([pack_sorted(keys[i:j]) for i, j in bounds], pa.binary()), pa.array([pack_numbers(count[i:j]) for i, j in bounds], pa.binary())],
                        ["kind", "bucket", "chunk", "keys", "n"],
                    )

    return run


def _summed(table: pa.Table) -> pa.Table:
    """Corpus counts of one range, given back to each chunk in its own order, and the range's totals."""
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    n = [unpack_numbers(x) for x in table.column("n").to_pylist()]
    size = np.array([len(k) for k in keys])
    distinct, code = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.uint64)
    np.add.at(total, code, np.concatenate(n))
    back = np.split(total[code], np.cumsum(size)[:-1])
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    chunk = table.column("chunk").to_pylist()
    m = len(chunk) + 1
    return pa.table({
        "kind": pa.array([kind] * m, pa.int32()), "bucket": pa.array([bucket] * m, pa.int32()), "chunk": pa.array([*chunk, None], pa.int64()),
        "n": pa.array([*map(pack_numbers, back), None], pa.binary()),
        "total": pa.array([*[None] * (m - 1), int(total.sum(dtype=np.int64))], pa.int64()), "seen": pa.array([*[None] * (m - 1), int((total > 0).sum())], pa.int64()),
    })


def _tokens(batch, r) -> tuple[_Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk with, for each token, the corpus counts of its context, itself and their bigram."""
    c = _Chunk(*(batch.column(k + 2)[r].as_py() for k in range(5)))
    got = sorted((x["kind"], x["bucket"], x["n"]) for x in batch.column(7)[r].as_py())
    of = [np.concatenate([unpack_numbers(x[2]) for x in got if x[0] == kind]).astype(np.float64) for kind in (WORDS, PAIRS)]
    word = of[WORDS][c.code]
    end = of[WORDS][np.searchsorted(c.words, END)]
    context = np.empty_like(word)
    context[0], context[1:] = end, word[:-1]
    return c, context, word, of[PAIRS][c.pair]


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(np.floor(np.log2(np.maximum(context, 1))) + 1, BUCKETS - 1), 0).astype(np.int64)


def _cells(p: np.ndarray, limit: int) -> np.ndarray:
    """0 for 0, else 1 + rounded -log2(p) in steps."""
    return np.where(p > 0, np.minimum(np.rint(-np.log2(np.where(p > 0, p, 1)) * STEPS), limit - 2) + 1, 0).astype(np.int64)


def _values(limit: int) -> np.ndarray:
    return np.concatenate([[0.0], 2.0 ** (-np.arange(limit - 1) / STEPS)])


def learn_weights(cells: np.ndarray, n: np.ndarray, vocabulary: int, rounds: int = 40) -> np.ndarray:
    """Weights (bucket, [bigram, unigram, uniform]) by expectation-maximisation; buckets without tokens get the average."""
    b, rest = np.divmod(cells, Q2 * Q1)
    f = np.stack([_values(Q2)[rest // Q1], _values(Q1)[rest % Q1], np.full(len(cells), 1 / (vocabulary + 1))], axis=1)
    w = np.full((BUCKETS, 3), 1 / 3)
    seen = np.bincount(b, weights=n, minlength=BUCKETS)
    for _ in range(rounds):
        part = w[b] * f
        part *= (n / part.sum(axis=1))[:, None]
        new = np.stack([np.bincount(b, weights=part[:, k], minlength=BUCKETS) for k in range(3)], axis=1)
        w = np.where(seen[:, None] > 0, new / np.maximum(seen, 1)[:, None], new.sum(axis=0) / max(seen.sum(), 1) if seen.sum() else 1 / 3)
    floor = 1e-6  # every word keeps a chance
    w = (w + floor) / (1 + 3 * floor)
    none = w[0].copy()
    none[1:] += none[0] / 2
    none[0] = 0
    w[0] = none  # without a context count there is no bigram estimate
    return w


def score_documents(docs: DataFrame, fold: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Learns from rows whose crc32(doc_id) mod ``fold`` is not ``held_out``. A null or empty text is one end. Rows
    that repeat count as often as they stand. Without training rows the model is uniform. A very long text is a chunk of
    its own; rows with a null doc_id are trained on. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    ship(spark)
    rest = tc.crc32_rule("doc_id", fold) == held_out
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(~rest, F.lit(True)).alias("train"))
    chunks = stored(source.mapInArrow(_chunks, "chunk long, doc_ids array<long>, train binary, lens binary, words binary, counts binary, codes binary"), "chunks")
    n_chunks = chunks.count()
    bits = min(30, max(5, (max(n_chunks, 1) // 2).bit_length()))
    parts = chunks.select("chunk", *_COLUMNS).mapInArrow(_ranges(bits), "kind int, bucket int, chunk long, keys binary, n binary")
    counts = stored(parts.groupBy("kind", "bucket").applyInArrow(_summed, "kind int, bucket int, chunk long, n binary, total long, seen long"), "counts")
    sums = counts.where("chunk is null and kind = 0").agg(F.sum("total").alias("n"), F.sum("seen").alias("v")).first()
    tokens, vocabulary = sums["n"] or 0, sums["v"] or 0
    back = counts.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "n")).alias("got"))
    joined = chunks.join(back, "chunk").select("chunk", "doc_ids", *_COLUMNS, "got")

    def estimates(batches):
        for batch in batches:
            for r in range(len(batch)):
                c, context, word, pair = _tokens(batch, r)
                t = c.of_token
                context, word, pair = context[t] - 1, word[t] - 1, pair[t] - 1
                two = np.where(context > 0, pair / np.maximum(context, 1), 0)
                one = word / max(tokens - 1, 1)
                cell = (bucket_of(context) * Q2 + _cells(two, Q2)) * Q1 + _cells(one, Q1)
                k, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["cell", "n"])

    table = joined.mapInArrow(estimates, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas().sort_values("cell")  # at most BUCKETS * Q1 * Q2 rows
    weights = learn_weights(table["cell"].to_numpy(np.int64), table["n"].to_numpy(np.float64), vocabulary)

    def scores(batches):
        for batch in batches:
            for r in range(len(batch)):
                c, context, word, pair = _tokens(batch, r)
                w = weights[bucket_of(context)]
                p = w[:, 0] * np.where(context > 0, pair / np.maximum(context, 1), 0) + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (vocabulary + 1)
                first = np.cumsum(c.lens) - c.lens
                base = np.add.reduceat(np.log10((word + 1) / (tokens + vocabulary + 1)), first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[r].values, pa.array(~c.train), pa.array(c.lens), pa.array(np.add.reduceat((word > 0).astype(np.int64), first)), pa.array(np.full(len(first), tokens), pa.int64()), pa.array(base), pa.array(np.add.reduceat(np.log10(p), first))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return joined.mapInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
