"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Sketch: a document's set holds the distinct hashes of its word shingles; the sketch is its k smallest.
   Documents with equal sets (size and 128 bits of digest) form one *class*, known by its smallest doc_id; one
   row of each goes on.
2. Inverted lists: a sketch value found in two classes or more gives a list. Two sets with similarity of
   the threshold or more share at least ``t`` retained values (``overlap_bound``), so each class enters
   only the lists of its rarest values, as prefix filtering does; a common passage then makes no long
   list unless it is most of a document. Lists are split by set size, as similar sets have similar sizes.
3. Links without all pairs: in each list every class is compared with one hub, and links join classes
   into components. Sets in lists that still hold several components are ordered by exact prefixes of the
   full sets; there too each list first meets hubs (the set whose shingles are the most common, so the
   origin of a family where it is there), in rounds that go on while they find links. What is still open
   is joined across components with two exact bounds on the overlap (``_prefix_pairs``), minus pairs compared
   before: no link between different components is lost.
4. Each comparison first estimates the similarity from the union's k smallest values, then verifies on
   the full sets.

The links that decide components are at least a spanning tree; comparisons are in proportion to the lists,
but for pairs that neither a link nor a bound settles. A family without its origin, all of whose
members lie just under the threshold from each other, is left to the last join whole.

Miss probability: for a pair exactly at the threshold, under ``MISS`` by the binomial tail.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textcore as tc
from vigil.llm.graph import components
from vigil.llm.runtime import drop_stored, release, ship, stored

MISS = 1e-9
HUB_ROUNDS = 4
PARTS = 16


def overlap_bound(k: int, threshold: float, miss: float = MISS) -> int:
    """Largest t with P(Binomial(k, threshold) < t) <= miss."""
    total, t = 0.0, 0
    while t < k:
        total += math.comb(k, t) * threshold**t * (1 - threshold) ** (k - t)
        if total > miss:
            return max(t, 1)
        t += 1
    return k


def block_sets(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block, flat, and bounds (n_docs + 1).

    Fewer than n words: the whole sequence is one shingle. No word: an empty set.
    """
    h, first, _, _ = tc.word_hashes(tc.lower(buf), off)
    count = np.diff(first)
    grams = tc.ngram_hashes(h, n)
    parts = []
    sizes = np.zeros(len(count), np.int64)
    f = first.tolist()
    for d in range(len(count)):
        a, b = f[d], f[d + 1]
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        elif b > a:
            s = tc.mix(tc.ngram_hashes(h[a:b], b - a) + tc.U64(b - a))
        else:
            continue
        parts.append(s)
        sizes[d] = len(s)
    flat = np.concatenate(parts) if parts else np.zeros(0, tc.U64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def signatures(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    size = np.diff(at)
    some = size > 0
    one, two = np.zeros(len(size), tc.U64), np.zeros(len(size), tc.U64)
    if some.any():
        b = at[:-1][some]
        one[some] = np.add.reduceat(flat, b)
        two[some] = np.bitwise_xor.reduceat(tc.mix(flat), b)
    return tc.mix(one + size.astype(tc.U64)), tc.mix(two ^ one)


def sketches(docs: DataFrame, n: int, k: int, carry: str | None = None) -> DataFrame:
    """doc_id, n_shingles, one and two (digests of the set; null: empty set), sketch (k smallest, ascending as unsigned), carried."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i, buf, off in tc.blocks(batch.column(1)):
                flat, at = block_sets(buf, off, n)
                size = np.diff(at)
                one, two = signatures(flat, at)
                keep = np.minimum(size, k)
                cut = np.concatenate([[0], np.cumsum(keep)])
                take = np.arange(cut[-1]) + np.repeat(at[:-1] - cut[:-1], keep)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, len(off) - 1),
                        pa.array(size, pa.int64()),
                        pa.array(one.view(np.int64), pa.int64(), mask=size == 0),
                        pa.array(two.view(np.int64), pa.int64(), mask=size == 0),
                        pa.ListArray.from_arrays(cut.astype(np.int32), flat[take].view(np.int64)),
                        batch.column(2).slice(i, len(off) - 1),
                    ],
                    ["doc_id", "n_shingles", "one", "two", "sketch", "carried"],
                )

    carried = (F.col(carry) if carry else F.lit(None)).cast("long")
    return docs.select("doc_id", "text", carried.alias("carried")).mapInArrow(tc.tidied(run), "doc_id long, n_shingles long, one long, two long, sketch array<long>, carried long")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """cid (as given) and the full set (little-endian unsigned 64-bit, sorted) of each text."""

    def run(batches):
        for batch in batches:
            for i, buf, off in tc.blocks(batch.column(1)):
                flat, at = block_sets(buf, off, n)
                raw = flat.astype("<u8").tobytes()
                a = (at * 8).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(off) - 1), pa.array([raw[p:q] for p, q in zip(a, a[1:])], pa.binary())], ["cid", "set"])

    return texts.mapInArrow(tc.tidied(run), "cid long, set binary")


def _verified(pairs: DataFrame, sets: DataFrame, k: int, percent: int, floor: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            x, y = batch.column(2), batch.column(3)
            keep = []
            for r in range(len(a)):
                p, q = np.frombuffer(x[r].as_buffer(), "<u8"), np.frombuffer(y[r].as_buffer(), "<u8")
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    continue
                if len(p) > k and len(q) > k:  # the union sketch: its k smallest values, and how many lie in both
                    common = np.intersect1d(p[:k], q[:k], assume_unique=True)
                    bound = np.partition(np.union1d(p[:k], q[:k]), k - 1)[k - 1]
                    if np.count_nonzero(common <= bound) < floor:
                        continue
                both = len(p) + len(q) - len(np.union1d(p, q))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append(r)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    # Only the sets that the pairs name are dealt out; few pairs are sent to the sets instead (by their known size).
    left = sets.join(pairs.select(F.col("a").alias("cid")).distinct(), "cid", "left_semi").select(F.col("cid").alias("a"), F.col("set").alias("sa"))
    right = sets.join(pairs.select(F.col("b").alias("cid")).distinct(), "cid", "left_semi").select(F.col("cid").alias("b"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(tc.tidied(run), "a long, b long")


def _hub_pairs(here: DataFrame, percent: int, turn: int = 0) -> DataFrame:
    """Each member of a list with the list's hub, if their components differ: first the member with the
    largest ``lead``, so the one that shares most with others; in later turns one picked by hash."""
    lead = -F.col("lead") if turn == 0 else F.xxhash64("cid", F.lit(turn)).cast("double")
    order = F.struct(lead.alias("p"), F.xxhash64("cid").alias("q"), F.col("cid").alias("c"), F.col("comp").alias("k"), F.col("n").alias("nk"))
    hubs = here.groupBy("list").agg(F.min(order).alias("h")).select("list", F.col("h.c").alias("c"), F.col("h.k").alias("k"), F.col("h.nk").alias("nk"))
    near = here.join(hubs, "list").where("comp <> k").where(f"100 * least(n, nk) >= {percent} * greatest(n, nk)")
    return near.select(F.least("cid", "c").alias("a"), F.greatest("cid", "c").alias("b")).distinct()


def _open_entries(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact prefixes of the full sets: cid, n, at (position), v, lead, and ``parts``, the set's shared shingles by hash.

    Shingles are ordered by how many of these sets have them, rarest first. Two sets that reach the overlap
    the threshold asks for have, at their first common shingle, at least that many shingles left in both;
    so shingles of a set's own, which stand first, rule out whole families without comparing sets.
    """
    rows = left.join(sets, "cid").select("cid", "comp", (F.octet_length("set") / 8).cast("long").alias("n"), "set")

    def spread(batches):
        for batch in batches:
            raw = batch.column(3)
            for r in range(len(batch)):
                v = np.frombuffer(raw[r].as_buffer(), "<i8")
                one = [pa.array(np.full(len(v), batch.column(c)[r].as_py()), pa.int64()) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*one, pa.array(v, pa.int64())], ["cid", "comp", "n", "v"])

    flat = stored(rows.mapInArrow(tc.tidied(spread), "cid long, comp long, n long, v long"), "open")
    df = flat.groupBy("v").agg(F.count("*").alias("df"), (F.min("comp") != F.max("comp")).alias("cross")).where("df > 1")
    part = [F.sum((F.pmod(F.col("v"), F.lit(PARTS)) == p).cast("int")) for p in range(PARTS)]
    ranked = (
        flat.join(df, "v")
        .groupBy("cid").agg(F.first("n").alias("n"), F.sum("df").alias("lead"), F.array(*part).alias("parts"), F.array_sort(F.collect_list(F.struct("df", "v", "cross"))).alias("vs"))
        .select("cid", "n", (F.col("lead") / F.col("n")).alias("lead"), "parts", (F.col("n") - F.size("vs")).alias("own"), F.posexplode("vs").alias("i", "e"))
        .select("cid", "n", "lead", "parts", (F.col("own") + F.col("i")).alias("at"), F.col("e.v").alias("v"), F.col("e.cross").alias("cross"))
        .where("cross").where(f"n - at >= ceil({percent} / 100.0D * n - 1e-9D)").drop("cross")
    )
    out = stored(ranked, "entries")
    drop_stored(flat)
    return out


def _prefix_pairs(entries: DataFrame, comp: DataFrame | None, percent: int) -> DataFrame:
    """All pairs of different components that can reach the threshold.

    Beside the bound by positions: the overlap is at most the sum, over ``PARTS`` classes of shingles, of the
    smaller count of the two sets, and that counts words changed in either.
    """
    need = f"ceil({percent} / {100 + percent}.0D * (n + on) - 1e-9D)"
    here = _with_comp(entries, comp)
    cross = here.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("v")
    here = here.join(cross, "v", "left_semi").select("v", "cid", "comp", "n", "at", *[F.col("parts")[p].alias(f"p{p}") for p in range(PARTS)])
    other = here.select("v", F.col("cid").alias("c"), F.col("comp").alias("k"), F.col("n").alias("on"), F.col("at").alias("oat"), *[F.col(f"p{p}").alias(f"q{p}") for p in range(PARTS)])
    both = " + ".join(f"least(p{p}, q{p})" for p in range(PARTS))
    match = (here.v == other.v) & F.expr(f"cid < c and comp <> k and least(n - at, on - oat) >= {need} and {both} >= {need}")
    return here.join(other, match).select(F.col("cid").alias("a"), F.col("c").alias("b")).distinct()


def _with_comp(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return rows.withColumn("comp", F.col("cid"))
    return rows.drop("comp").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


class _Links:
    """Pairs compared so far, links found and the components they make."""

    def __init__(self, sets: DataFrame, k: int, percent: int, floor: int):
        self.sets, self.rules = sets, (k, percent, floor)
        self.pairs: list[DataFrame] = []
        self.found: list[DataFrame] = []
        self.comp: DataFrame | None = None

    def add(self, pairs: DataFrame) -> bool:
        """Compare pairs not compared before; whether a link was found."""
        for old in self.pairs:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        self.pairs.append(pairs)
        if pairs.isEmpty():
            return False
        found = stored(_verified(pairs, self.sets, *self.rules), "links")
        self.found.append(found)
        if found.isEmpty():
            return False
        links = found if self.comp is None else found.select("a", "b").unionByName(self.comp.select(F.col("node").alias("a"), F.col("comp").alias("b")))
        old, self.comp = self.comp, stored(components(links), "comp")
        if old is not None:
            drop_stored(old)
        release(found.sparkSession)
        return True

    def clear(self) -> None:
        for df in (*self.pairs, *self.found):
            drop_stored(df)


def first_of_each(docs: DataFrame, columns: list[str], shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs (their ``columns``, doc_id and text among them) that are the kept ones of their component.

    A row goes by its doc_id and text: of rows that share a doc_id each is judged by its own text, and equal rows
    stay or go together. Rows without a doc_id stay.
    """
    mark = F.coalesce(F.xxhash64("text"), F.lit(0))
    out = near_duplicates(docs.select("doc_id", "text").withColumn("mark", mark), shingle, percent, carry="mark").where("not kept")
    rejected = stored(out.select(F.col("doc_id").alias("gone"), F.col("mark").alias("gone_mark")).distinct(), "rejected")
    drop_stored(out)
    release(docs.sparkSession)
    return docs.select(*columns).join(rejected, (F.col("doc_id") == F.col("gone")) & (mark == F.col("gone_mark")), "left_anti").select(*columns)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = 64, carry: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept, and a long column to carry.

    Null and empty texts have an empty set, link with nothing and stay (component_id is their doc_id). Rows
    that repeat a doc_id are judged by their own texts; sets whose smallest doc_id is the same count as one. A null
    doc_id names no document: such a row gets a null component_id, and stays. A very long text is one set as any
    other. Only doc_id and text are read.
    """
    threshold = percent / 100
    t = overlap_bound(k, threshold)
    key = ["one", "two", "n_shingles"]
    rows = stored(sketches(docs, shingle, k, carry), "sketch")
    known = rows.where("one is not null and doc_id is not null")
    # A class is known by the smallest doc_id that has its set; equal sets are those with equal size and 128 bits.
    classes = known.groupBy(*key).agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")).withColumnRenamed("n_shingles", "n")
    values = classes.select("cid", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    n = F.col("n")
    # Sets whose similar partners all fit in a sketch have an exact bound.
    need = F.when(F.ceil(n / threshold) <= k, F.ceil(n * F.lit(threshold) - F.lit(1e-9))).otherwise(t)
    prefix = (
        classes.select("cid", "one", "two", "n", "copies", F.explode("sketch").alias("v")).join(shared, "v")
        .groupBy("cid", "one", "two", "n").agg(F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
        .withColumn("need", need).where("size(vs) >= need")
        .select("cid", "n", (F.size("vs") + F.col("copies") / (F.col("copies") + 1)).alias("lead"), F.expr("slice(vs, 1, cast(size(vs) - need + 1 as int))").alias("vs"))
    )
    bucket = F.floor(F.ln(n.cast("double")) / F.lit(math.log(1 / threshold) * 1.000001)).cast("int")
    entries = stored(prefix.select("cid", "n", "lead", F.explode("vs.v").alias("v")).select("cid", "n", "lead", "v", F.explode(F.array(bucket, bucket + 1)).alias("z")), "prefix")
    full = entries.groupBy("v", "z").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    lists = stored(entries.join(full, ["v", "z"]).select(F.xxhash64("v", "z").alias("list"), "cid", "n", "lead"), "lists")
    drop_stored(entries)
    wanted = lists.select("cid").distinct()
    chosen = known.join(wanted, known.doc_id == wanted.cid, "left_semi").select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi").select("doc_id", "text")
    sets = _sets(texts, shingle)
    if not known.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").isEmpty():
        sets = sets.dropDuplicates(["cid", "set"])  # without repeated doc_ids there is nothing to drop
    sets = stored(sets, "sets")

    links = _Links(sets, k, percent, t)
    links.add(_hub_pairs(_with_comp(lists, None), percent))
    here = _with_comp(lists, links.comp)
    open_ = here.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("list")
    left = here.join(open_, "list", "left_semi").groupBy("cid").agg(F.first("comp").alias("comp"))
    inner = _open_entries(left, sets, percent)
    for turn in range(HUB_ROUNDS):
        if not links.add(_hub_pairs(_with_comp(inner.withColumn("list", F.col("v")), links.comp), percent, turn)) and turn:
            break
    links.add(_prefix_pairs(inner, links.comp, percent))

    classes = known.groupBy(*key).agg(F.min("doc_id").alias("cid"))
    label = classes.withColumn("component_id", F.col("cid")) if links.comp is None else _with_comp(classes, links.comp).withColumnRenamed("comp", "component_id")
    out = rows.select("doc_id", *key, "carried").join(label.drop("cid"), key, "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    links.clear()
    for df in (lists, inner, sets):
        drop_stored(df)
    more = [F.col("carried").alias(carry)] if carry else []
    return out.select("doc_id", "n_shingles", own.alias("component_id"), *more).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
