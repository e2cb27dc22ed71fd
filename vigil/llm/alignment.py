"""Alignment of two tokenizers' tokens of one text by byte-owner arrays.

Each text, led by a space, is encoded by a byte-level BPE (A) and by a SentencePiece model (B, which adds the space
itself). ``np.repeat`` of token numbers over their bytes gives each byte its owner in A and in B. Where either owner
changes, a new pair of owners begins: the distinct consecutive pairs are the links, all pairs of tokens whose bytes
overlap. Where both owners change at once lies a cut; cuts divide the tokens into groups that cover the same bytes.

Corpus counts. A task keeps a dictionary of the id pairs of about ``CHUNK_LINKS`` links (a chunk: whole documents,
so one longer document is a chunk of its own) and each document's links as numbers in it. Only dictionaries are
shuffled by id pair, one row a pair and chunk however often it is linked, summed, compared with the highest count of
their B id, and sent back to their chunks. An id pair stands once in each chunk, so no pair is hot; the pairs of one
B id are at most the ids of A. Nothing goes through the driver and nothing is broadcast.

A text that is null or empty has no tokens; nor has one whose tokens' bytes, joined, are not the text led by a
space (SentencePiece reads U+2581 as a space, for one). A's tokens always are the text's bytes.
"""

from __future__ import annotations

import hashlib
import itertools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm import textcore as tc
from vigil.llm.bpe import default_rank_file, encoder
from vigil.llm.runtime import drop_stored, ship, stored

CHUNK_LINKS = 1 << 22
#: Bytes of text aligned at once: owner arrays and tokens take some fifty times as much.
BLOCK_BYTES = 1 << 19
COMMA, BAR, SEMICOLON = range(3)


def default_piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A SentencePiece model and the bytes of its pieces."""

    def __init__(self, piece_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.size = self.model.get_piece_size()
        is_byte, name = self.model.is_byte, self.model.id_to_piece
        data = [bytes([int(name(i)[3:5], 16)]) if is_byte(i) else name(i).replace("▁", " ").encode() for i in range(self.size)]
        self.lengths = np.array([len(b) for b in data], np.int64)
        self.flat = np.frombuffer(b"".join(data), np.uint8)
        self.at = np.cumsum(self.lengths) - self.lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of each."""
        found = self.model.encode(texts, num_threads=1) if texts else []
        sizes = np.array([len(x) for x in found], np.int64)
        return np.fromiter(itertools.chain.from_iterable(found), np.int64, int(sizes.sum())), sizes

    def decode(self, ids: np.ndarray) -> np.ndarray:
        lens = self.lengths[ids]
        ends = np.cumsum(lens)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[ids] - (ends - lens), lens)]


def pieces(piece_file: str) -> Pieces:
    """The worker's model for a file, kept over tasks."""
    kept = sys.__dict__.setdefault("_vigil_pieces", {})
    if piece_file not in kept:
        kept[piece_file] = Pieces(piece_file)
    return kept[piece_file]


def _numbers() -> np.ndarray:
    """Decimal digits of each id and a separator, in 8 bytes padded with zeros: row 3 * id + separator."""
    kept = sys.__dict__.setdefault("_vigil_numbers", [])
    if not kept:
        out = bytearray(8 * 3 << 17)
        for row in range(3 << 17):
            text = b"%d%c" % (row // 3, b",|;"[row % 3])
            out[8 * row : 8 * row + len(text)] = text
        kept.append(np.frombuffer(out, np.uint64))
    return kept[0]


class Aligned:
    """Tokens, links and groups of a block of documents.

    ``a``, ``b``: ids; ``a_at``, ``b_at``, ``link_at``, ``group_at``: each document's first (n + 1); ``link_a``, ``link_b``: the
    tokens of each link; ``group_a``, ``group_b``: each group's first token of A and of B, and the number of tokens at the end.
    """

    def __init__(self, a, a_sizes, a_lens, b, b_sizes, b_lens):
        self.a, self.b = a, b
        self.a_at, self.b_at = (np.concatenate([[0], np.cumsum(s)]) for s in (a_sizes, b_sizes))
        own_a, own_b = np.repeat(np.arange(len(a), dtype=np.int32), a_lens), np.repeat(np.arange(len(b), dtype=np.int32), b_lens)
        n = len(own_a)
        new_a, new_b = np.ones(n, bool), np.ones(n, bool)
        np.not_equal(own_a[1:], own_a[:-1], out=new_a[1:])
        np.not_equal(own_b[1:], own_b[:-1], out=new_b[1:])
        link, cut = np.flatnonzero(new_a | new_b), np.flatnonzero(new_a & new_b)
        self.link_a, self.link_b = own_a[link], own_b[link]
        self.group_a, self.group_b = np.append(own_a[cut], len(a)).astype(np.int64), np.append(own_b[cut], len(b)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(a_lens)])[self.a_at]  # bytes before each document
        self.link_at, self.group_at = np.searchsorted(link, bounds), np.searchsorted(cut, bounds)

    def groups_text(self) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3`` of all documents as bytes, each ending in ``;``, and where each begins (n + 1)."""
        n_a, n_b = np.diff(self.group_a), np.diff(self.group_b)
        index = np.empty(len(self.a) + len(self.b), np.int64)
        for ids, first, size, before, last in ((self.a, self.group_a, n_a, self.group_b[:-1], BAR), (self.b, self.group_b, n_b, self.group_a[1:], SEMICOLON)):
            row = 3 * ids.astype(np.int64) + COMMA
            row[first[1:] - 1] += last
            index[np.arange(len(ids)) + np.repeat(before, size)] = row
        wide = _numbers()[index]
        text = wide.view(np.uint8)
        solid = text != 0
        ends = np.concatenate([[0], np.cumsum(solid.reshape(-1, 8).sum(1))])
        return text[solid], ends[self.a_at + self.b_at]


def align_block(enc, sp: Pieces, column: pa.Array, buf: np.ndarray, off: np.ndarray) -> Aligned:
    """Alignment of the documents of a block (``column``: their texts, ``buf``: their bytes)."""
    some = np.diff(off) > 0
    led, at = np.insert(buf, off[:-1][some], 0x20), off + np.concatenate([[0], np.cumsum(some)])
    a, a_at = enc.encode_block(led, at)
    b, sizes = sp.encode([t for t in column.to_pylist() if t])
    b_sizes = np.zeros(len(some), np.int64)
    b_sizes[some] = sizes
    b_lens = sp.lengths[b]
    b_bytes = np.concatenate([[0], np.cumsum(b_lens)])[np.concatenate([[0], np.cumsum(b_sizes)])]
    decoded = sp.decode(b)
    a_sizes = np.diff(a_at)
    if not (np.array_equal(b_bytes, at) and np.array_equal(decoded, led)):
        same = np.array([np.array_equal(led[p:q], decoded[r:s]) for p, q, r, s in zip(at, at[1:], b_bytes, b_bytes[1:])], bool)
        keep_a, keep_b = np.repeat(same, a_sizes), np.repeat(same, b_sizes)
        a, b, b_lens, a_sizes, b_sizes = a[keep_a], b[keep_b], b_lens[keep_b], a_sizes * same, b_sizes * same
    return Aligned(a, a_sizes, enc.lengths[a], b, b_sizes, b_lens)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(at.astype(np.int32), pa.array(values.astype(np.int32)))


def align_documents(docs: DataFrame, rank_file: str | None = None, piece_file: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, ``a_ids``, ``b_ids``, ``link_a``, ``link_b`` (token numbers of each link), ``group_a``, ``group_b`` (each group's first token).

    All numbers count from 0 within the document. Texts without tokens (see the module) have empty lists. Rows that
    repeat stay rows, a null id stays null; other columns are not read, so their names can't clash.
    """
    ship(docs.sparkSession)
    rank_file, piece_file = rank_file or default_rank_file(), piece_file or default_piece_file()

    def run(batches):
        enc, sp = encoder(rank_file), pieces(piece_file)
        for batch in batches:
            for i, buf, off in tc.blocks(batch.column(1), BLOCK_BYTES):
                n = len(off) - 1
                x = align_block(enc, sp, batch.column(1).slice(i, n), buf, off)
                links, groups = np.diff(x.link_at), np.diff(x.group_at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n), _lists(x.a, x.a_at), _lists(x.b, x.b_at),
                        _lists(x.link_a - np.repeat(x.a_at[:-1], links), x.link_at), _lists(x.link_b - np.repeat(x.b_at[:-1], links), x.link_at),
                        _lists(x.group_a[:-1] - np.repeat(x.a_at[:-1], groups), x.group_at), _lists(x.group_b[:-1] - np.repeat(x.b_at[:-1], groups), x.group_at),
                    ],
                    ["id", "a_ids", "b_ids", "link_a", "link_b", "group_a", "group_b"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "link_a", "link_b", "group_a", "group_b"))
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(tc.tidied(run), schema).withColumnRenamed("id", id_column)


#: Rows of documents have ``pairs`` null; the row of a chunk's dictionary has only ``chunk``, ``pairs`` and ``times``.
_CHUNKS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, pairs array<long>, times array<long>"


def _chunks(docs: DataFrame, rank_file: str, piece_file: str, chunk_links: int) -> DataFrame:
    from pyspark import TaskContext

    def run(batches):
        enc, sp = encoder(rank_file), pieces(piece_file)
        chunk, held, n = TaskContext.get().partitionId() << 32, [], 0

        def out():
            sizes = [len(h[2]) for h in held]
            pairs, where = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
            times = np.bincount(where, np.concatenate([h[3] for h in held]), len(pairs)).astype(np.int64)
            begin = 0
            for (columns, number, _, _, at), size in zip(held, sizes):
                links = _lists(where[begin : begin + size][number], at)
                begin += size
                rows = len(at) - 1
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(chunk), rows), *columns, links, pa.nulls(rows, pa.list_(pa.int64())), pa.nulls(rows, pa.list_(pa.int64()))], _NAMES)
            one = [pa.nulls(1, t) for t in (pa.int64(),) * 5 + (pa.string(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *one, pa.array([pairs], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int64()))], _NAMES)

        for batch in batches:
            for i, buf, off in tc.blocks(batch.column(1), BLOCK_BYTES):
                rows = len(off) - 1
                x = align_block(enc, sp, batch.column(1).slice(i, rows), buf, off)
                text, at = x.groups_text()
                raw, cut = text.tobytes(), at.tolist()
                sha = [hashlib.sha256(raw[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(cut, cut[1:])]
                pairs, number, times = np.unique(x.a[x.link_a].astype(np.int64) * sp.size + x.b[x.link_b], return_inverse=True, return_counts=True)
                counts = [pa.array(np.diff(v)) for v in (x.a_at, x.b_at, x.group_at, x.link_at)]
                held.append(([batch.column(0).slice(i, rows), *counts, pa.array(sha, pa.string())], number.astype(np.int32), pairs, times, x.link_at))
                n += len(number)
                if n >= chunk_links:
                    yield from out()
                    chunk, held, n = chunk + 1, [], 0
        if held:
            yield from out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tc.tidied(run), _CHUNKS)


_NAMES = [c.split()[0] for c in _CHUNKS.split(", ")]


def pair_counts(dictionaries: DataFrame, b_size: int) -> DataFrame:
    """``pair`` (A id * b_size + B id), ``n`` (its links in the corpus) and ``best`` (1 if no pair of the B id has more) of rows (pair, times)."""
    of_b = Window.partitionBy(F.col("pair") % b_size)  # at most as many rows as A has ids
    counted = dictionaries.groupBy("pair").agg(F.sum("times").alias("n"))
    return counted.withColumn("best", (F.col("n") == F.max("n").over(of_b)).cast("long"))


def digest(docs: DataFrame, rank_file: str | None = None, piece_file: str | None = None, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """One row per document: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_best counts the links whose id pair is linked corpus-wide as often as any pair of the same B id, count_sum adds
    the corpus-wide counts of all links. Texts without tokens (see the module) have zeros and an empty string. Rows that
    repeat are counted as often as they stand; a null doc_id stays null; only doc_id and text are read.
    """
    spark = docs.sparkSession
    ship(spark)
    rank_file, piece_file = rank_file or default_rank_file(), piece_file or default_piece_file()
    size = pieces(piece_file).size
    chunks = stored(_chunks(docs, rank_file, piece_file, chunk_links), "aligned")
    dictionaries = chunks.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "p")).select("chunk", "at", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = pair_counts(dictionaries, size)
    answers = dictionaries.join(counts, "pair").select(F.col("chunk").alias("of"), "at", "n", "best")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right["at"].to_numpy()
        n, best = np.zeros((2, len(at)), np.int64)
        n[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy()
        links = left["links"].combine_chunks()
        index = links.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(left["n_links"].to_numpy())])
        sums = [np.diff(np.concatenate([[0], np.cumsum(v[index])])[ends]) for v in (best, n)]
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*(left[c] for c in names), *(pa.array(s) for s in sums), left["groups_sha256"]], names=[*names, "n_best", "count_sum", "groups_sha256"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    rows = chunks.where("pairs is null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    out = stored(rows.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(score, schema), "alignment")
    drop_stored(chunks)
    return out
