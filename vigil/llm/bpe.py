"""Byte-level BPE with vectorised pre-tokenisation and cached pair merging (no regex on any path).

Boundaries. Every code point gets a class from one table: U+0020, other white space, letter, number or
other. Each code point then stands for a transition function of the split automaton that is either the
identity (same run goes on) or a constant (a run begins here); such functions compose associatively, so
one prefix scan (a running maximum over the positions of the constant functions) gives every position
the start of its run. From run starts and neighbours the token bounds follow by element-wise rules:

* a run of white space before something else keeps all but its last code point as one token; the last
  one leads the next run if it is U+0020, else it is a token of its own;
* letter, number and other runs are tokens, led by a U+0020 just before them;
* an apostrophe that is itself a whole run of "other", not led by U+0020, takes one of the endings
  s, t, m, d, re, ve, ll off the letters that follow.

Merging. Distinct slices of a block are merged together: in each round every unfinished slice merges its
leftmost pair of lowest rank. Results stay in a cache of at most ``CACHE_SLICES`` slices per worker.
"""

from __future__ import annotations

import base64
import heapq
import json
import sys
import unicodedata

import numpy as np

from vigil.llm import textcore as tc

CACHE_SLICES = 1 << 17
LONG_SLICE = 48
BLANK, WHITE, LETTER, NUMBER, OTHER = range(5)
# Code points with the Unicode property White_Space other than U+0020.
WHITE_SPACE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_NONE = np.int64(1 << 40)


def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        k = kinds.get(unicodedata.category(chr(cp))[0])
        if k:
            out[cp] = k
    out[WHITE_SPACE] = WHITE
    out[0x20] = BLANK
    return out


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte where each begins."""
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    cp = buf[at].astype(np.int32)
    for low, high, extra, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
        k = np.flatnonzero((cp >= low) & (cp < high)) if extra == 1 else np.flatnonzero((buf[at] >= low) & (buf[at] < high))
        if not len(k):
            continue
        v = buf[at[k]].astype(np.int32) & mask
        for j in range(1, extra + 1):
            v = (v << 6) | (buf[at[k] + j] & 0x3F)
        cp[k] = v
    return cp, at


def _endings(cp: np.ndarray, where: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Length of the contraction ending right after each apostrophe at ``where``; 0: none."""
    n = len(cp)
    a = cp[np.minimum(where + 1, n - 1)]
    b = cp[np.minimum(where + 2, n - 1)]
    one = np.isin(a, [ord(x) for x in "stmd"]) & (where + 1 < stop)
    pair = a.astype(np.int64) * 0x110000 + b
    two = np.isin(pair, [ord(x) * 0x110000 + ord(y) for x, y in ("re", "ve", "ll")]) & (where + 2 < stop)
    return np.where(one, 1, np.where(two, 2, 0))


class Encoder:
    """Encodes by a rank file as ``tiktoken`` does, a block of documents at a time."""

    def __init__(self, rank_file: str):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for k, v in ranks.items():
            self.bytes_of[v] = k
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.pairs = pairs
        self._table(pairs)
        self.classes = _classes()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.flat_off = np.concatenate([[0], np.cumsum(self.lengths)])
        self._clear()

    def _table(self, pairs: dict[int, int]) -> None:
        """Open addressing over a power of two, at a load under one quarter."""
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, mask = tc.U64(64 - bits), (1 << bits) - 1
        self.mask = np.int64(mask)
        keys, vals = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
        k = np.fromiter(pairs.keys(), np.int64, len(pairs))
        v = np.fromiter(pairs.values(), np.int64, len(pairs))
        slot = self._slot(k)
        while len(k):
            _, first = np.unique(slot, return_index=True)
            first = first[keys[slot[first]] == -1]
            keys[slot[first]], vals[slot[first]] = k[first], v[first]
            rest = np.ones(len(k), bool)
            rest[first] = False
            k, v, slot = k[rest], v[rest], (slot[rest] + 1) & self.mask
        self.keys, self.vals = keys, vals

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(tc.U64) * tc.U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.vals[slot], _NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.vals[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def _clear(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.n_ids = 0
        self.at, self.len = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def bounds(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Byte starts of all tokens; documents are split apart."""
        if not len(buf):
            return np.zeros(0, np.int64)
        if buf.max() < 128:
            cp, at = buf, None
            doc = off
        else:
            cp, at = code_points(buf)
            doc = np.searchsorted(at, off)
        kind = self.classes[cp]
        n = len(kind)
        cut = np.zeros(n + 1, bool)
        cut[doc] = True
        run = np.minimum(kind, 4)
        run[run == BLANK] = WHITE
        first = np.empty(n, bool)
        first[0] = True
        first[1:] = (run[1:] != run[:-1]) | cut[1:-1]
        space = run == WHITE
        blank = kind == BLANK
        # The start of each white-space run, or of any other run that no U+0020 of its own document leads.
        led = np.zeros(n, bool)
        led[1:] = blank[:-1] & ~cut[1:-1]
        start = first & (space | ~led)
        # The last white space of a run before something else is apart from the run.
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~cut[1:-1]
        start |= last
        # Contractions.
        quote = np.flatnonzero((cp == 0x27) & first & ~led)
        if len(quote):
            alone = np.ones(len(quote), bool)
            inner = quote + 1 < n
            alone[inner] = first[quote[inner] + 1]
            quote = quote[alone]
            stops = np.append(np.flatnonzero(cut), n)
            stop = stops[np.searchsorted(stops, quote, side="right")]
            size = _endings(cp, quote, stop)
            quote, size = quote[size > 0], size[size > 0]
            if len(quote):
                start[quote + 1] = False
                nxt = quote + 1 + size
                start[nxt[nxt < n]] = True
        out = np.flatnonzero(start)
        return out if at is None else at[out]

    def encode_block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block, and where each document's ids begin (n + 1)."""
        starts = self.bounds(buf, off)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        ends = np.append(starts[1:], len(buf))
        index, inverse = tc.distinct_segments(buf, starts, ends)
        if len(self.cache) > CACHE_SLICES:
            self._clear()
        raw, cache = buf.tobytes(), self.cache
        slices = [raw[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist())]
        rows = [cache.get(x, -1) for x in slices]
        where = np.array(rows, np.int64)
        missing = np.flatnonzero(where < 0)
        if len(missing):
            where[missing] = self._merge([slices[i] for i in missing.tolist()])
        row = where[inverse]
        lens = self.len[row].astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(lens)])
        take = np.arange(bounds[-1]) + np.repeat(self.at[row] - bounds[:-1], lens)
        return self.ids[take], bounds[np.searchsorted(starts, off)]

    def encode_marked(self, buf: np.ndarray, off: np.ndarray, marks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_block``; each occurrence of a mark (the leftmost, of several the longest) is one id of its own."""
        raw = buf.tobytes()
        if not any(m in raw for m in marks):
            return self.encode_block(buf, off)
        found, bounds = [], off.tolist()
        for a, b in zip(bounds, bounds[1:]):
            while True:
                here = [(k, -len(m), m) for m in marks if (k := raw.find(m, a, b)) >= 0]
                if not here:
                    break
                k, size, m = min(here)
                a = k - size
                found.append((k, a, marks[m]))
        if not found:
            return self.encode_block(buf, off)
        begin, end, value = (np.array(x, np.int64) for x in zip(*found))
        cuts = np.unique(np.concatenate([off, begin, end]))
        ids, at = self.encode_block(buf, cuts)
        size = np.diff(at)
        piece = np.searchsorted(cuts, begin)
        keep = np.ones(len(ids), bool)
        for p, v in zip(piece.tolist(), value.tolist()):
            ids[at[p]] = v
            keep[at[p] + 1 : at[p + 1]] = False
        size[piece] = 1
        return ids[keep], np.concatenate([[0], np.cumsum(size)])[np.searchsorted(cuts, off)]

    def _merge(self, new: list[bytes]) -> np.ndarray:
        """Merge new slices and store them; their rows."""
        rows = np.empty(len(new), np.int64)
        base = len(self.cache)
        short = [i for i, x in enumerate(new) if len(x) <= LONG_SLICE]
        ids, lens = self._merge_short([new[i] for i in short])
        parts, sizes, order = [ids], lens.tolist(), list(short)
        for i, x in enumerate(new):
            if len(x) > LONG_SLICE:
                got = self._merge_long(x)
                parts.append(np.array(got, np.int64))
                sizes.append(len(got))
                order.append(i)
        flat = np.concatenate(parts)
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        while base + len(new) > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(len(self.at), np.int64)])
            self.len = np.concatenate([self.len, np.zeros(len(self.len), np.int32)])
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        sizes = np.array(sizes, np.int64)
        self.len[base : base + len(new)] = sizes
        self.at[base : base + len(new)] = self.n_ids + np.cumsum(sizes) - sizes
        self.n_ids += len(flat)
        rows[order] = base + np.arange(len(new))
        self.cache.update(zip((new[i] for i in order), range(base, base + len(new))))
        return rows

    def _merge_short(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.array([len(x) for x in new], np.int64)
        if not len(new):
            return np.zeros(0, np.int64), lens
        seq = self.byte_ids[np.frombuffer(b"".join(new), np.uint8)]
        final_len = np.ones(len(new), np.int64)
        done_word, done_ids = [], []
        word = np.arange(len(new))
        size = lens.copy()
        firsts = np.cumsum(size) - size
        rank = np.full(len(seq), _NONE)
        rank[:-1] = self.pair_ranks(seq[:-1], seq[1:])
        rank[firsts + size - 1] = _NONE
        while len(word):
            best = np.minimum.reduceat(rank, firsts)
            over = best == _NONE
            if over.any():
                keep = np.repeat(~over, size)
                done_word.append(np.repeat(word[over], size[over]))
                done_ids.append(seq[~keep])
                final_len[word[over]] = size[over]
                seq, rank, word, size, best = seq[keep], rank[keep], word[~over], size[~over], best[~over]
                firsts = np.cumsum(size) - size
                if not len(word):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            owner = np.searchsorted(firsts, hit, side="right") - 1
            lead = np.ones(len(hit), bool)
            lead[1:] = owner[1:] != owner[:-1]
            i = hit[lead]  # one position in each slice
            seq[i] = best
            keep = np.ones(len(seq), bool)
            keep[i + 1] = False
            at = i - np.arange(len(i))  # after the removals before it
            seq, rank = seq[keep], rank[keep]
            size = size - 1
            firsts = np.cumsum(size) - size
            rank[at] = _NONE
            right = at < firsts + size - 1
            j = at[right]
            rank[j] = self.pair_ranks(seq[j], seq[j + 1])
            j = at[at > firsts]
            rank[j - 1] = self.pair_ranks(seq[j - 1], seq[j])
        w = np.concatenate(done_word)
        ids = np.concatenate(done_ids)
        return ids[np.argsort(w, kind="stable")], final_len

    def _merge_long(self, x: bytes) -> list[int]:
        """One long slice: a heap of pairs over a linked list."""
        n = len(x)
        ids = self.byte_ids[np.frombuffer(x, np.uint8)].tolist()
        nxt, prev, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        get, size = self.pairs.get, self.size
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = r, False
            nxt[i] = k = nxt[j]
            if k >= 0:
                prev[k] = i
                if (q := get(r * size + ids[k])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[k]))
            if (p := prev[i]) >= 0 and (q := get(ids[p] * size + r)) is not None:
                heapq.heappush(heap, (q, p, ids[p], r))
        return [v for v, ok in zip(ids, alive) if ok]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        lens = self.lengths[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.flat_off[ids] - (ends - lens), lens)]


def encoder(rank_file: str) -> Encoder:
    """The worker's encoder for a rank file, kept over tasks."""
    kept = sys.__dict__.setdefault("_vigil_encoders", {})
    if rank_file not in kept:
        kept[rank_file] = Encoder(rank_file)
    return kept[rank_file]


def added_tokens(token_file: str) -> dict[bytes, int]:
    """Strings that a ``tokenizers`` file gives an id of their own, wherever they stand in a text."""
    with open(token_file, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    odd = [t["content"] for t in found if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]
    if odd:
        raise ValueError(f"added tokens with conditions are not supported: {odd}")
    return {t["content"].encode(): t["id"] for t in found}


def default_rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_token_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs, rank_file: str | None = None, id_column: str = "doc_id", text_column: str = "text"):
    """One row per document: id, ``ids`` (array<int>) and ``offsets`` (byte start of each id in the text).

    Null texts count as empty; no id, no offset. Other columns are not read, so their names can't clash.
    """
    import pyarrow as pa

    from vigil.llm.runtime import ship

    ship(docs.sparkSession)
    rank_file = rank_file or default_rank_file()

    def run(batches):
        enc = encoder(rank_file)
        for batch in batches:
            for i, buf, off in tc.blocks(batch.column(1)):
                ids, at = enc.encode_block(buf, off)
                lens = enc.lengths[ids]
                begin = np.cumsum(lens) - lens
                begin = begin - np.repeat(off[:-1], np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(off) - 1), pa.ListArray.from_arrays(at.astype(np.int32), ids.astype(np.int32)), pa.ListArray.from_arrays(at.astype(np.int32), begin.astype(np.int32))],
                    ["id", "ids", "offsets"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(id_column, text_column).mapInArrow(tc.tidied(run), f"id {kind}, ids array<int>, offsets array<int>")
    return out.withColumnRenamed("id", id_column)


def round_trip(docs, rank_file: str | None = None):
    """Digest of encoding and decoding each document: n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts give no tokens and the digest of no bytes. Rows that repeat stay rows.
    """
    import hashlib

    import pyarrow as pa

    from vigil.llm.runtime import ship

    ship(docs.sparkSession)
    rank_file = rank_file or default_rank_file()

    def run(batches):
        enc = encoder(rank_file)
        sha = hashlib.sha256
        for batch in batches:
            for i, buf, off in tc.blocks(batch.column(1)):
                ids, at = enc.encode_block(buf, off)
                decoded = enc.decode(ids)
                cut = np.concatenate([[0], np.cumsum(enc.lengths[ids])])[at]
                le = ids.astype("<u4")
                a, c = at.tolist(), cut.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, len(off) - 1),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([sha(le[p:q]).hexdigest() for p, q in zip(a, a[1:])], pa.string()),
                        pa.array([sha(decoded[p:q]).hexdigest() for p, q in zip(c, c[1:])], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(tc.tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
