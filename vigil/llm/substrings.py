"""Removal of passages of ``window`` words that also stand in a document with a smaller doc_id.

Pass 1 counts every window in a count-min sketch. Windows are counted under their *anchor*: the smallest
hash among the sub-windows of half the length that they contain. Equal windows have equal anchors, and an
anchor is entered once for each run of windows that share it, so its count is never below the number
of documents that hold any of its windows; the sketch adds to that, never takes away. The sketch has
``CELLS_PER_ANCHOR`` cells or more for each anchor (their number follows from the bytes of text), so its load, and
the share of unrepeated windows that pass, is the same at every size: under 2 % with two rows, under 12 % with one.
Each task's sketch is sparse and saturates at 2; sketches merge by segments of ``2**SPAN_BITS`` cells, so a merge
holds as much at every size. What remains is one bit a cell ("twice or more").

While those bits take ``MAP_BYTES`` at most they are sent to every worker. A larger map stays where it is: its set
cells are joined with the documents' anchors (one row of the sketch then), and documents get the anchors that may
repeat. Both ways let every repeated window pass.

Pass 2 emits (window hash of 96 bits, doc_id) of the windows whose anchor may repeat, once a document, and groups
them exactly: smallest doc_id by partial aggregation, then a join back, which Spark can split on hot keys.
Pass 3 marks the words of the windows found and joins what is kept.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textcore as tc
from vigil.llm.runtime import release, ship, stored

ROWS = 2
SPAN_BITS = 20
CELLS_PER_ANCHOR = 8
#: Anchors a byte of text at most: two in each run of 27 words (windows of 50), words of 6 bytes with their blank.
ANCHORS_PER_BYTE = 0.0125
MAP_BYTES = 32 << 20
FLUSH = 1 << 20
# Odd multipliers, one a row of the sketch.
_ODD = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of n values."""
    width, m = 1, x
    while width * 2 <= n:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = n - width
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of the window at each word position, whether the window lies in one document, whether a run begins."""
    size = len(h) - window + 1
    if size <= 0:
        return np.zeros(0, tc.U64), np.zeros(0, bool), np.zeros(0, bool)
    half = max(1, window // 2)
    key = _sliding_min(tc.window_hashes(h, half), window - half + 1)
    inside = np.ones(size, bool)
    reach = np.zeros(len(h) + 1, np.int32)
    inner = first[1:-1]
    inner = inner[(inner > 0) & (inner < len(h))]
    lo = np.maximum(inner - window + 1, 0)
    np.add.at(reach, lo, 1)
    np.add.at(reach, inner, -1)
    inside = np.cumsum(reach)[:size] == 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (key[1:] != key[:-1])
    return key, inside, begin


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((keys * tc.U64(_ODD[row])) >> tc.U64(64 - bits)).astype(np.int64)


def sketch_bits(docs: DataFrame, window: int) -> int:
    """Logarithm of the number of cells: from ``CELLS_PER_ANCHOR`` to twice that for each anchor expected."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    anchors_expected = size * ANCHORS_PER_BYTE * 52 / (window + 2)
    return min(56, max(16, math.ceil(math.log2(max(1.0, anchors_expected * CELLS_PER_ANCHOR)))))


def merged_sketch(docs: DataFrame, window: int, bits: int, rows: int) -> DataFrame:
    """(row, segment, bits): for each segment of each row of the merged sketch, packed bits "cell counted twice or more"."""
    span_bits = min(SPAN_BITS, bits)
    span = 1 << span_bits

    def sparse(found):
        keys = np.concatenate(found)
        for row in range(rows):
            cell, count = np.unique(cells(keys, row, bits), return_counts=True)
            segment, cut = np.unique(cell >> span_bits, return_index=True)
            cut = np.append(cut, len(cell))
            for s, i, j in zip(segment.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
                step = np.diff(cell[i:j] - s * span, prepend=0).astype("<u4")
                planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes()
                yield row, s, zlib.compress(planes, 1), zlib.compress(np.packbits(count[i:j] > 1).tobytes(), 1), j - i

    def count(batches):
        found, n = [], 0

        def out():
            got = list(sparse(found))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32())
            for i in range(0, len(got), 2048):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*got[i : i + 2048]), kinds)], ["row", "segment", "steps", "more", "n"])

        for batch in batches:
            for _, buf, off in tc.blocks(batch.column(0)):
                h, first, _, _ = tc.word_hashes(buf, off)
                key, _, begin = anchors(h, first, window)
                found.append(key[begin])
                n += len(found[-1])
                if n >= FLUSH:
                    yield from out()
                    found, n = [], 0
        if n:
            yield from out()

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(span, np.uint8)
        for steps, more, n in zip(table.column("steps"), table.column("more"), table.column("n").to_pylist()):
            planes = np.frombuffer(zlib.decompress(steps.as_py()), np.uint8).reshape(4, n)
            cell = np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)
            add = np.unpackbits(np.frombuffer(zlib.decompress(more.as_py()), np.uint8), count=n) + 1
            total[cell] = np.minimum(total[cell] + add, 2)
        return pa.table({"row": table.column("row")[:1], "segment": table.column("segment")[:1], "bits": pa.array([np.packbits(total >= 2).tobytes()], pa.binary())})

    parts = docs.where("doc_id is not null").select("text").mapInArrow(tc.tidied(count), "row int, segment long, steps binary, more binary, n int")
    return parts.groupBy("row", "segment").applyInArrow(merge, "row int, segment long, bits binary")


def _sent_maps(sketch: DataFrame, bits: int, rows: int) -> list[np.ndarray]:
    """The whole map on the driver, for a broadcast: ``rows`` * 2**bits / 8 bytes, which the caller has bounded."""
    out = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(rows)]
    span = 1 << min(SPAN_BITS, bits)
    for r in sketch.toLocalIterator():
        out[r["row"]][r["segment"] * span // 8 : (r["segment"] + 1) * span // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _passed(maps: list[np.ndarray], keys: np.ndarray, bits: int) -> np.ndarray:
    maybe = np.ones(len(keys), bool)
    for row, m in enumerate(maps):
        c = cells(keys, row, bits)
        maybe &= (m[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return maybe


def _open_anchors(docs: DataFrame, sketch: DataFrame, window: int, bits: int) -> DataFrame:
    """doc_id and ``keys``, its anchors in cells counted twice or more, by a join of cells."""
    span = 1 << min(SPAN_BITS, bits)

    def entered(batches):
        for batch in batches:
            for i, buf, off in tc.blocks(batch.column(1)):
                h, first, _, _ = tc.word_hashes(buf, off)
                key, _, begin = anchors(h, first, window)
                at = np.flatnonzero(begin)
                doc, key = np.searchsorted(first, at, side="right") - 1, key[at]
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(cells(key[new], 0, bits)), batch.column(0).take(pa.array(i + doc[new])), pa.array(key[new].view(np.int64))], ["cell", "doc_id", "key"])

    def full(batches):
        for batch in batches:
            for s, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(s * span + np.flatnonzero(np.unpackbits(np.frombuffer(b.as_buffer(), np.uint8))[:span]))], ["cell"])

    mine = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(tc.tidied(entered), "cell long, doc_id long, key long")
    open_cells = sketch.where("row = 0").select("segment", "bits").mapInArrow(tc.tidied(full), "cell long")
    return mine.join(open_cells, "cell").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _candidates(docs: DataFrame, window: int, maps, bits: int) -> DataFrame:
    """(w, c, doc_id): hashes of the windows whose anchor may repeat, by the maps sent or by the documents' own ``keys``."""

    def run(batches):
        for batch in batches:
            for i, buf, off in tc.blocks(batch.column(1)):
                h, first, _, _ = tc.word_hashes(buf, off)
                key, inside, begin = anchors(h, first, window)
                if not begin.any():
                    continue
                lead = np.flatnonzero(begin)
                if maps is not None:
                    maybe = _passed(maps.value, key[lead], bits)
                else:
                    doc = np.searchsorted(first, lead, side="right") - 1
                    cut = np.searchsorted(doc, np.arange(len(off)))
                    maybe = np.zeros(len(lead), bool)
                    for d, known in enumerate(batch.column(2).slice(i, len(off) - 1)):
                        a, b = cut[d], cut[d + 1]
                        maybe[a:b] = np.isin(key[lead[a:b]], known.values.to_numpy().view(np.uint64))
                # A run's verdict holds for all its windows.
                run_of = np.cumsum(begin) - 1
                at = np.flatnonzero(inside & (run_of >= 0) & maybe[np.maximum(run_of, 0)])
                if not len(at):
                    continue
                w, c = tc.window_hashes(h, window)[at], (tc.window_hashes(h, window, True)[at] >> tc.U64(32)).astype(np.uint32)
                doc = np.searchsorted(first, at, side="right") - 1
                order = np.lexsort((c, w, doc))
                w, c, doc = w[order], c[order], doc[order]
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(w[new].view(np.int64)), pa.array(c[new].view(np.int32)), batch.column(0).take(pa.array(i + doc[new]))], ["w", "c", "doc_id"])

    some = docs.where("doc_id is not null").select("doc_id", "text", *(["keys"] if maps is None else []))
    return some.mapInArrow(tc.tidied(run), "w long, c int, doc_id long")


def repeated_windows(docs: DataFrame, window: int = 50, bits: int | None = None, rows: int = ROWS, map_bytes: int = MAP_BYTES) -> DataFrame:
    """doc_id and ``ws``, the hashes of its windows that also start in a document with a smaller doc_id."""
    spark = docs.sparkSession
    ship(spark)
    release(spark)
    docs = docs.select("doc_id", "text")
    bits = sketch_bits(docs, window) if bits is None else bits
    sent = rows * (1 << bits) // 8 <= map_bytes
    sketch = merged_sketch(docs, window, bits, rows if sent else 1)
    if sent:
        maps = spark.sparkContext.broadcast(_sent_maps(sketch, bits, rows))
        found = _candidates(docs, window, maps, bits)
    else:
        keys = stored(_open_anchors(docs, sketch, window, bits), "anchors")
        found = _candidates(docs.join(keys, "doc_id"), window, None, bits)
    # Windows are made anew for each of the two steps, which costs less than keeping them: they outweigh the texts.
    firsts = found.groupBy("w", "c").agg(F.min("doc_id").alias("lo"))
    return found.join(firsts, ["w", "c"]).where("doc_id > lo").groupBy("doc_id").agg(F.collect_list("w").alias("ws"))


def remove_repeated(docs: DataFrame, window: int = 50, bits: int | None = None, rows: int = ROWS, carry: tuple[str, ...] = (), map_bytes: int = MAP_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (kept words joined by one space), and the columns in ``carry``.

    A null text has no words; a text under ``window`` words loses none. Rows that share a doc_id never count
    as smaller than each other. A row with a null doc_id loses nothing and takes nothing from others. A very long text is
    read whole. ``bits`` (logarithm of the cells) follows from the size of the texts unless given; with any value all
    repeated windows are found. Only doc_id, text and ``carry`` are read.
    """
    source = docs.select("doc_id", "text", *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])
    carried = [f"carried_{k}" for k in range(len(carry))]
    hits = repeated_windows(docs, window, bits, rows, map_bytes)

    def run(batches):
        for batch in batches:
            hit = batch.column(2)
            for i, buf, off in tc.blocks(batch.column(1)):
                n = len(off) - 1
                h, first, s, e = tc.word_hashes(buf, off)
                drop = np.zeros(len(h) + 1, np.int32)
                mine = hit.slice(i, n)
                marked = np.flatnonzero(mine.is_valid().to_numpy(zero_copy_only=False))
                if len(marked):
                    all_w = tc.window_hashes(h, window)
                    for d in marked.tolist():
                        a, b = first[d], first[d + 1] - window + 1
                        at = a + np.flatnonzero(np.isin(all_w[a:b], mine[d].values.to_numpy().view(np.uint64)))
                        drop[at] += 1
                        drop[at + window] -= 1
                keep = np.cumsum(drop)[:-1] == 0 if len(h) else np.zeros(0, bool)
                kept_first = np.concatenate([[0], np.cumsum(keep)])[first]
                ks, ke = s[keep], e[keep]
                lens = ke - ks + 1
                some = kept_first[1:] > kept_first[:-1]
                lens[kept_first[1:][some] - 1] -= 1  # no space after a document's last word
                ends = np.concatenate([[0], np.cumsum(lens)])
                at = np.arange(ends[-1]) + np.repeat(ks - ends[:-1], lens)
                text = buf[np.minimum(at, len(buf) - 1)] if len(at) else np.zeros(0, np.uint8)
                sep = np.ones(len(lens), bool)
                sep[kept_first[1:][some] - 1] = False
                text[ends[1:][sep] - 1] = 0x20
                out = pa.StringArray.from_buffers(n, pa.py_buffer(ends[kept_first].astype(np.int32).tobytes()), pa.py_buffer(text.tobytes()))
                words = np.diff(first)
                more = [batch.column(3 + k).slice(i, n) for k in range(len(carried))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(words, pa.int64()), pa.array(words - np.diff(kept_first), pa.int64()), out, *more], ["doc_id", "n_words", "n_removed", "kept", *carried])

    kinds = "".join(f", {c} {source.schema[c].dataType.simpleString()}" for c in carried)
    result = source.join(hits, "doc_id", "left").select("doc_id", "text", "ws", *carried).mapInArrow(tc.tidied(run), "doc_id long, n_words long, n_removed long, kept string" + kinds)
    return result.withColumnsRenamed({f"carried_{k}": c for k, c in enumerate(carry)})


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
