"""Harmonic packing of token sequences into bins of a fixed capacity.

Each document's ids (with an end id) are cut into full sequences and a rest shorter than the capacity C.
A rest with C / (k + 1) < length <= C / k is of class k (at most ``classes``), and a bin of class k takes
exactly k rests. Classes and partitions fill independently: no worker needs another's bins. Documents may be
cut, so what harmonic packing leaves open is closed by a stream: the rests of the last class and those that
fill no whole bin flow, in order, through the gaps of the class bins and then through new bins. Where the gaps
exceed the stream, bins of the last classes are given back to it. Padding remains in the last bin of a run only.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textcore as tc
from vigil.llm.bpe import added_tokens, default_rank_file, default_token_file, encoder
from vigil.llm.runtime import ship

CAPACITY = 1024
CLASSES = 16
END = 0
FLUSH = 1 << 19


def pack(lengths: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES) -> tuple[np.ndarray, ...]:
    """Pieces (document, start, length, bin, offset) of documents given by length; lengths of 0 give none."""
    lengths = np.asarray(lengths, np.int64)
    full = lengths // capacity
    rest = lengths - full * capacity
    doc = [np.repeat(np.arange(len(lengths)), full)]
    k = np.arange(len(doc[0])) - np.repeat(np.cumsum(full) - full, full)
    start, size, bin_, at = [k * capacity], [np.full(len(k), capacity)], [np.arange(len(k))], [np.zeros(len(k), np.int64)]
    n = len(k)
    some = np.flatnonzero(rest > 0)
    kind = np.minimum(capacity // np.maximum(rest[some], 1), classes)  # C/(k+1) < length <= C/k
    loose = [some[kind == classes]]
    room_bin, room_at = [], []
    for c in range(1, classes):
        mine = some[kind == c]
        whole = len(mine) // c * c
        loose.append(mine[whole:])
        mine = mine[:whole].reshape(-1, c)
        if not len(mine):
            continue
        off = np.cumsum(rest[mine], axis=1)
        doc.append(mine.ravel())
        start.append((full[mine] * capacity).ravel())
        size.append(rest[mine].ravel())
        bin_.append(np.repeat(n + np.arange(len(mine)), c))
        at.append((off - rest[mine]).ravel())
        room_bin.append(n + np.arange(len(mine)))
        room_at.append(off[:, -1])
        n += len(mine)
    # Holes: the gaps of harmonic bins in order, then new bins; loose rests flow through them as one stream.
    loose = np.concatenate(loose)
    hb = np.concatenate(room_bin) if room_bin else np.zeros(0, np.int64)
    ha = np.concatenate(room_at) if room_at else np.zeros(0, np.int64)
    total = int(rest[loose].sum())
    gap = capacity - ha
    order = np.flatnonzero(gap > 0)
    hb, ha, gap = hb[order], ha[order], gap[order]
    room = int(gap.sum())
    if room > total and len(hb):
        # More gaps than loose ids: whole harmonic bins of the last classes are undone until they balance.
        back = np.cumsum((gap + ha)[::-1])  # capacity freed with each undone bin, ids and gap alike
        undo = min(len(hb), int(np.searchsorted(back, room - total)) + 1)
        gone = np.zeros(n, bool)
        gone[hb[len(hb) - undo :]] = True
        doc, start, size, bin_, at = (np.concatenate(x) for x in (doc, start, size, bin_, at))
        out = gone[bin_]
        loose = np.concatenate([loose, doc[out]])
        renumber = np.cumsum(~gone) - 1
        doc, start, size, at, bin_ = doc[~out], start[~out], size[~out], at[~out], renumber[bin_[~out]]
        hb, ha, gap = renumber[hb[: len(hb) - undo]], ha[: len(ha) - undo], gap[: len(gap) - undo]
        n = int((~gone).sum())
        total, room = int(rest[loose].sum()), int(gap.sum())
        doc, start, size, bin_, at = [doc], [start], [size], [bin_], [at]
    extra = max(0, -(-(total - room) // capacity))
    hb = np.concatenate([hb, n + np.arange(extra)])
    ha = np.concatenate([ha, np.zeros(extra, np.int64)])
    ends = np.cumsum(np.concatenate([gap, np.full(extra, capacity)]))
    stream = np.cumsum(rest[loose])
    cuts = np.unique(np.concatenate([[0], stream, ends[ends < total]]))
    cuts = cuts[cuts <= total]
    if len(cuts) > 1:
        a, b = cuts[:-1], cuts[1:]
        d = np.searchsorted(stream, a, side="right")
        h = np.searchsorted(ends, a, side="right")
        doc.append(loose[d])
        start.append(full[loose[d]] * capacity + a - (stream - rest[loose])[d])
        size.append(b - a)
        bin_.append(hb[h])
        at.append(ha[h] + a - np.concatenate([[0], ends])[h])
    return tuple(np.concatenate(x).astype(np.int64) for x in (doc, start, size, bin_, at))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, rank_file: str | None = None, with_ids: bool = True, token_file: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    A document's ids are those that ``tokenizers`` gives with ``token_file`` (its added tokens are cut out of a text
    first, the rest goes by the same vocabulary's ranks), then ``END``; a null text has END alone. Each
    partition packs by itself in runs of about ``FLUSH`` ids, so memory is bounded and a lost task is redone alone;
    ``sequence_id`` is the partition and run in the high bits (partition * 2**40 + number). Rows that repeat are packed as
    often as they stand. Only doc_id and text are read.
    """
    from pyspark import TaskContext

    ship(docs.sparkSession)
    rank_file = rank_file or default_rank_file()
    marks = added_tokens(token_file or default_token_file())
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches):
        enc = encoder(rank_file)
        base = TaskContext.get().partitionId() << 40
        held, n = [], 0

        def out():
            nonlocal base
            names = pa.concat_arrays([h[0] for h in held])
            ids = np.concatenate([h[1] for h in held])
            lens = np.concatenate([h[2] for h in held])
            first = np.cumsum(lens) - lens
            doc, start, size, bin_, at = pack(lens, capacity, classes)
            ends = np.cumsum(size)
            take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[doc] + start - (ends - size), size)
            flat = ids[take]
            raw = flat.astype("<u4")
            cut = np.concatenate([[0], ends]).tolist()
            crc = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cut, cut[1:])], pa.int64())
            for i in range(0, len(doc), 4096):
                j = min(len(doc), i + 4096)
                columns = [names.take(pa.array(doc[i:j])), pa.array(start[i:j]), pa.array(size[i:j]), crc.slice(i, j - i), pa.array(lens[doc[i:j]]), pa.array(base + bin_[i:j]), pa.array(at[i:j])]
                if with_ids:
                    bounds = (np.array(cut[i : j + 1], np.int64) - cut[i]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(bounds, flat[cut[i] : cut[j]].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, fields[: len(columns)])
            base += int(bin_.max()) + 1 if len(bin_) else 0

        for batch in batches:
            for i, buf, off in tc.blocks(batch.column(1)):
                ids, at = enc.encode_marked(buf, off, marks)
                size = np.diff(at)
                ids = np.insert(ids, at[1:], END)
                held.append((batch.column(0).slice(i, len(size)), ids, size + 1))
                n += len(ids)
                if n >= FLUSH:
                    yield from out()
                    held, n = [], 0
        if held:
            yield from out()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tc.tidied(run), schema)

