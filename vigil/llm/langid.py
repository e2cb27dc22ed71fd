"""Language of a text by a byte convolutional network.

Texts are lower-cased in ASCII, all other ASCII but letters becomes a space, and the bytes are cut into
windows of ``LENGTH`` bytes (the whole text, the last window padded). Filters of widths 2, 3 and 4 slide
over one-hot bytes; their rectified maxima over a window feed a softmax. A document's answer is the
byte-weighted mean of its windows' log-probabilities. The network is trained in numpy, on the driver, on
about ``PER_LANGUAGE`` documents a language at most (a 64-bit hash of doc_id picks them) and ``WINDOWS`` windows of each.

One more class of the softmax, *noise*, learns from windows of those texts with their characters shuffled and from
random letters of many scripts; so a text can also fit no learned language. ``noise`` is that class's probability;
lang_pred and score are of the languages alone. A part of the sample (one document in ``CALIBRATE``) isn't trained on: a limit
for ``noise`` follows from it, which all but about one in 500 of these documents stay under.

For use, the weights of two neighbouring bytes are summed into tables over byte pairs, so a window costs
two table rows a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textcore as tc
from vigil.llm.runtime import ship

LENGTH = 256
PER_LANGUAGE = 900
WINDOWS = 3
FILTERS = 12
WIDTHS = (2, 3, 4)
BATCH = 96
CALIBRATE = 6
NOISE_SHARE = 0.2
KEPT_SHARE = 0.998
LEAST_LIMIT = 0.9
UNKNOWN = "und"
# First and last code points of letters of several scripts, for windows of noise.
SCRIPTS = ((0x61, 0x7A), (0xE0, 0xFE), (0x100, 0x17F), (0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))

_NORMAL = np.full(256, 0x20, np.uint8)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)


def windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix (windows, LENGTH + 3) of normalised bytes, the document of each, and its own bytes."""
    size = np.diff(off)
    count = -(-size // LENGTH)
    doc = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = off[:-1][doc] + k * LENGTH
    own = np.minimum(off[1:][doc] - begin, LENGTH)
    at = begin[:, None] + np.arange(LENGTH + WIDTHS[-1] - 1)
    out = np.where(at < off[1:][doc][:, None], _NORMAL[buf[np.minimum(at, max(len(buf) - 1, 0))]], 0) if len(buf) else np.zeros((0, LENGTH + 3))
    return out.astype(np.uint8), doc, own


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        n = len(languages) + 1  # and noise
        self.noise_limit = 1.0
        self.conv = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), n)).astype(np.float32)
        self.out_bias = np.zeros(n, np.float32)

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_tables"):
            near = np.concatenate([(c[0][:, None] + c[1][None]).reshape(65536, -1) for c in self.conv], axis=1)
            none = np.zeros((256, FILTERS), np.float32)
            far = np.concatenate([(c[2][:, None] + (c[3] if len(c) > 3 else none)[None]).reshape(65536, -1) for c in self.conv[1:]], axis=1)
            self._tables = np.ascontiguousarray(near), np.ascontiguousarray(far)
        return self._tables

    def features(self, x: np.ndarray) -> np.ndarray:
        near, far = self._pairs()
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        y = near[pair[:, :LENGTH]]
        y[:, :, FILTERS:] += far[pair[:, 2 : LENGTH + 2]]
        return np.maximum(y.max(axis=1) + self.bias, 0)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.languages) + 1))
        for i in range(0, len(x), BATCH):
            z = self.features(x[i : i + BATCH]) @ self.out + self.out_bias
            z = z - z.max(axis=1, keepdims=True)
            out[i : i + BATCH] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, rate: float = 0.01, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.conv, self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 64):
                rows = order[i : i + 64]
                b, target = x[rows], y[rows]
                # Some windows are shortened, as short texts are padded.
                short = rng.random(len(b)) < 0.4
                keep = np.where(short, rng.integers(8, LENGTH, len(b)), LENGTH + 3)
                b = np.where(np.arange(b.shape[1])[None] < keep[:, None], b, 0).astype(np.int64)
                pooled, where = [], []
                for c, w in zip(self.conv, WIDTHS):
                    z = c[0][b[:, :LENGTH]]
                    for k in range(1, w):
                        z += c[k][b[:, k : LENGTH + k]]
                    at = z.argmax(axis=1)
                    where.append(at)
                    pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
                pre = np.concatenate(pooled, axis=1) + self.bias
                act = np.maximum(pre, 0)
                z = act @ self.out + self.out_bias
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(b)), target] -= 1
                p /= len(b)
                back = (p @ self.out.T) * (pre > 0)
                grads = []
                for j, (c, w) in enumerate(zip(self.conv, WIDTHS)):
                    g = np.zeros_like(c)
                    part = back[:, j * FILTERS : (j + 1) * FILTERS]
                    f = np.broadcast_to(np.arange(FILTERS), part.shape)
                    for k in range(w):
                        np.add.at(g, (k, np.take_along_axis(b, where[j] + k, 1), f), part)
                    grads.append(g)
                grads += [back.sum(axis=0), act.T @ p, p.sum(axis=0)]
                t += 1
                step = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)))
                for q, g, m, v in zip(params, grads, first, second):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.99
                    v += 0.01 * g * g
                    q -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        self.__dict__.pop("_tables", None)


def noise_windows(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each window one of its length that is in no language: its characters shuffled, or random letters of a script."""
    out = np.zeros_like(x)
    for r, row in enumerate(x):
        chars = list(bytes(row[:LENGTH][row[:LENGTH] > 0]).decode(errors="ignore"))
        if r % 2:
            low, high = SCRIPTS[int(rng.integers(len(SCRIPTS)))]
            chars = [" " if rng.random() < 0.15 else chr(int(rng.integers(low, high + 1))) for _ in chars]
        raw = "".join(chars[k] for k in rng.permutation(len(chars))).encode()[:LENGTH]
        out[r, : len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def training_windows(docs: DataFrame, learn, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, windows, targets and documents of the windows, from about ``per_language`` documents a language at most."""
    base = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null").where(learn)
    share = base.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    languages = sorted(r["lang"] for r in share)
    if not languages:
        return [], np.zeros((0, LENGTH + 3), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    limits = {r["lang"]: tc.share_limit(per_language / r["n"]) for r in share}
    limit = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(limits[k]).cast("long"))])
    chosen = base.where(tc.hash_sample("doc_id", limit[F.col("lang")]))

    def cut(batches):
        for batch in batches:
            texts, langs, ids = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            for i, buf, off in tc.blocks(texts):
                m, doc, own = windows(buf, off)
                count = np.bincount(doc, minlength=len(off) - 1)
                at = np.cumsum(count) - count
                pick = np.unique(np.concatenate([at + (count * j) // WINDOWS for j in range(WINDOWS)])[np.tile(count, WINDOWS) > 0]) if len(doc) else np.zeros(0, np.int64)
                pick = pick[own[pick] >= 8]
                yield pa.RecordBatch.from_arrays([pa.array([langs[i + d] for d in doc[pick]], pa.string()), pa.array([m[p].tobytes() for p in pick], pa.binary()), ids.take(pa.array(i + doc[pick]))], ["lang", "window", "doc_id"])

    rows = chosen.select("text", "lang", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(tc.tidied(cut), "lang string, window binary, doc_id long").collect()  # bounded by per_language * WINDOWS * languages
    rows.sort()
    x = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), np.uint8).reshape(-1, LENGTH + 3)
    return languages, x, np.array([languages.index(r["lang"]) for r in rows], np.int64), np.array([r["doc_id"] for r in rows], np.int64)


def train(docs: DataFrame, learn, per_language: int = PER_LANGUAGE, seed: int = 7) -> Network:
    ship(docs.sparkSession)
    languages, x, y, doc = training_windows(docs, learn, per_language)
    net = Network(languages or [UNKNOWN])
    if len(x):
        rng = np.random.default_rng(seed)
        apart = doc % CALIBRATE == 0
        if apart.all() or not apart.any():
            apart[:] = False
        noise = noise_windows(x[~apart][rng.random(int((~apart).sum())) < NOISE_SHARE], rng)
        net.train(np.concatenate([x[~apart], noise]), np.concatenate([y[~apart], np.full(len(noise), len(languages))]))
        if apart.any():
            found, index = np.unique(doc[apart], return_inverse=True)
            total = np.zeros((len(found), len(languages) + 1))
            np.add.at(total, index, net.log_probabilities(x[apart]))
            total /= np.bincount(index)[:, None]
            usual = float(np.quantile(np.exp(total[:, -1]), KEPT_SHARE))
            net.noise_limit = max(LEAST_LIMIT, (1 + usual) / 2)
    return net


def predict(docs: DataFrame, net: Network, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, noise and the columns in ``carry`` for every row.

    Null texts and texts without a letter are ``und`` with score 0 and noise 1. Without any learned language all rows
    are ``und``. A very long text is read in all its windows. Rows that repeat stay rows, each judged by its own text;
    a null doc_id stays null. Only doc_id, text and ``carry`` are read.
    """
    spark = docs.sparkSession
    ship(spark)
    net._pairs()
    shared = spark.sparkContext.broadcast(net)  # a fixed size for a number of languages
    source = docs.select("doc_id", "text", *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])
    carried = [f"carried_{k}" for k in range(len(carry))]

    def run(batches):
        net = shared.value
        for batch in batches:
            for i, buf, off in tc.blocks(batch.column(1)):
                n = len(off) - 1
                m, doc, own = windows(buf, off)
                logp = net.log_probabilities(m)
                total = np.zeros((n, logp.shape[1]))
                np.add.at(total, doc, logp * own[:, None])
                total /= np.maximum(np.diff(off), 1)[:, None]
                noise = np.exp(total[:, -1])
                total = total[:, :-1]
                p = np.exp(total - total.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                score = p[np.arange(n), best]
                ascii_letter = np.concatenate([[0], np.cumsum((buf | 0x20) - 97 < 26)])[off]
                names = [net.languages[b] for b in best]
                for d in np.flatnonzero(np.diff(ascii_letter) == 0).tolist():
                    if not any(c.isalpha() for c in bytes(buf[off[d] : off[d + 1]]).decode()):
                        names[d], score[d], noise[d] = UNKNOWN, 0.0, 1.0
                more = [batch.column(2 + k).slice(i, n) for k in range(len(carried))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(names, pa.string()), pa.array(score), pa.array(noise), *more], ["doc_id", "lang_pred", "score", "noise", *carried])

    kinds = "".join(f", {c} {source.schema[c].dataType.simpleString()}" for c in carried)
    result = source.mapInArrow(tc.tidied(run), "doc_id long, lang_pred string, score double, noise double" + kinds)
    return result.withColumnsRenamed({f"carried_{k}": c for k, c in enumerate(carry)})


def _learns(fold: int, held_out: int):
    return tc.crc32_rule("doc_id", fold) != held_out


def identify(docs: DataFrame, fold: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, noise; learns from rows whose crc32(doc_id) mod ``fold`` is not ``held_out``."""
    net = train(docs, _learns(fold, held_out))
    rest = F.coalesce(~_learns(fold, held_out), F.lit(False))
    return predict(docs, net).select("doc_id", rest.alias("held_out"), "lang_pred", "score", "noise")


def in_a_language(docs: DataFrame, columns: list[str], fold: int = 4, held_out: int = 2) -> DataFrame:
    """Rows of docs (their ``columns``, doc_id and text among them) that have a letter and fit a learned language."""
    net = train(docs, _learns(fold, held_out))
    out = predict(docs, net, carry=tuple(c for c in columns if c != "doc_id"))
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("noise") <= net.noise_limit)).select(*columns)
