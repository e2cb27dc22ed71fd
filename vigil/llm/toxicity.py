"""Toxicity of texts after noisy-channel deobfuscation.

Channel: a disguised word is a lattice in which a leet sign may stand for letters, a separator inside a
word for nothing, ``*`` for any letter, a run of three or more equal letters for one or two of them, and
blanks between single letters for nothing. Viterbi decoding under a character trigram model picks the
likeliest reading. Signs at the ends of a token are positions as inner ones are; the token without them is read too.
Words of letters alone have one path and are left as they are. Every asterisk is any letter or nothing, however many there are. A run
of three or more of one leet sign is, like one of letters, its letter once or twice, or else ornament. Single characters apart
are joined from two on; the fewer they are, the more the model must gain by it.
Decoding is linear in a token's length, whatever that is; readings of tokens up to ``KEPT`` characters are kept for
the next time. The trigram counts come from all texts (no labels).

Score: logistic regression on presence of words and word beginnings of the restored text. It is fitted on
the driver on a bounded sample of labelled rows (about ``PER_CLASS`` a class at most, picked by a 64-bit hash of doc_id).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textcore as tc
from vigil.llm.bpe import code_points
from vigil.llm.runtime import ship

PER_CLASS = (4000, 2500)  # clean, toxic
FEATURES = 1500
BEGINNINGS = (4, 5, 6)
CACHE = 1 << 17
KEPT = 64

# Signs and the letters they stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "£": "l", "¡": "i",
}
SEPARATORS = ".-_*'~,:;/\\"
EDGE = "\"'`.,;:!?()[]{}<>…#%&*-_~/\\=^|$+@"
#: Edge signs that can't stand for a letter, and those that at one end of a word are more often punctuation.
SENTENCE = "".join(c for c in EDGE if c not in LEET and c != "*")
OPENING, CLOSING = "(<¡", "!"
_ANY = "abcdefghijklmnopqrstuvwxyz"
_RUN = re.compile(r"([^\W\d_])\1\1")
_PIECES = re.compile(r"[\W\d_]+")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+€])(?:[ .\-_]{1,2}(?:[^\W_]|[@$!|+€])){1,}(?!\S)")

# The alphabet of the character model: 0 is everything else (and word bounds).
_CODE = {c: i + 1 for i, c in enumerate(_ANY)} | {chr(c): i + 27 for i, c in enumerate(range(0xDF, 0x100))}
SYMBOLS = len(_CODE) + 1
_TABLE = np.zeros(0x250, np.int32)
for _c, _i in _CODE.items():
    _TABLE[ord(_c)] = _i
for _c in range(0x41, 0x5B):
    _TABLE[_c] = _TABLE[_c + 32]
for _c in (*range(0xC0, 0xD7), *range(0xD8, 0xDF)):
    _TABLE[_c] = _TABLE[_c + 32]


class CharacterModel:
    """Trigram model with additive backing off; log probabilities of a symbol after two others."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
        p2 = (c2 + 20 * p1) / (c2.sum(axis=1, keepdims=True) + 20)
        p3 = (c3 + 20 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 20)
        self.table = np.log(p3)
        self.log = self.table.tolist()

    def decode(self, lattice: list[list[tuple[str, float]]]) -> tuple[float, str]:
        """Best path through a list of positions, each with (letters, channel log probability).

        Up to the first position that may be any letter there are few states and each step goes over them one by
        one; from there on the steps are arrays over all pairs of symbols.
        """
        log = self.log
        lattice = [*lattice, [(" ", 0.0)]]
        wild = next((k for k, choices in enumerate(lattice) if len(choices) > 20), len(lattice))
        states: dict = {(0, 0): (0.0, None)}  # score, (path before, letters): paths share their beginnings
        for choices in lattice[:wild]:
            after: dict = {}
            for (a, b), (score, path) in states.items():
                for text, cost in choices:
                    s, x, y = score + cost, a, b
                    for ch in text:
                        z = _CODE.get(ch, 0)
                        s += log[x][y][z]
                        x, y = y, z
                    best = after.get((x, y))
                    if best is None or s > best[0]:
                        after[x, y] = (s, (path, text))
            states = after
        if wild < len(lattice):
            score, path, tail = self._decode_dense(states, lattice[wild:])
        else:
            (score, path), tail = max(states.values(), key=lambda v: v[0]), []
        parts = []
        while path is not None:
            path, text = path
            parts.append(text)
        return score, "".join([*reversed(parts), *tail])[:-1]

    def _decode_dense(self, states: dict, lattice: list[list[tuple[str, float]]]) -> tuple[float, tuple | None, list[str]]:
        """The rest of a lattice: best score, the path before it and the letters chosen."""
        every = np.arange(SYMBOLS)
        score = np.full((SYMBOLS, SYMBOLS), -np.inf)
        for (a, b), (s, _) in states.items():
            score[a, b] = s
        steps = []
        for choices in lattice:
            best = np.full_like(score, -np.inf)
            pick, before = np.zeros(score.shape, np.int32), np.zeros(score.shape, np.int64)
            single = [k for k, (text, _) in enumerate(choices) if len(text) == 1] if len(choices) > 20 else []
            if single:  # many single letters at once
                codes = np.array([_CODE[choices[k][0]] for k in single])
                cost = np.array([choices[k][1] for k in single])
                first, second = np.flatnonzero(np.isfinite(score).any(axis=1)), np.flatnonzero(np.isfinite(score).any(axis=0))
                total = score[np.ix_(first, second)][:, :, None] + self.table[first[:, None, None], second[:, None], codes]
                x = total.argmax(axis=0)
                at = second[:, None], codes
                best[at] = np.take_along_axis(total, x[None], 0)[0] + cost
                pick[at], before[at] = np.array(single), first[x] * SYMBOLS + second[:, None]
            for k, (text, cost) in enumerate(choices):
                if k in single:
                    continue
                now, back = score, np.arange(SYMBOLS * SYMBOLS).reshape(score.shape)
                for ch in text:
                    z = _CODE.get(ch, 0)
                    total = now + self.table[:, :, z]
                    x = total.argmax(axis=0)
                    now, old = np.full_like(score, -np.inf), back
                    back = np.zeros_like(old)
                    now[:, z], back[:, z] = total[x, every], old[x, every]
                better = now + cost > best
                best[better], pick[better], before[better] = (now + cost)[better], k, back[better]
            steps.append((pick, before))
            score = best
        at = int(score.argmax())
        total, letters = float(score.flat[at]), []
        for (pick, before), choices in zip(reversed(steps), reversed(lattice)):
            letters.append(choices[int(pick.flat[at])][0])
            at = int(before.flat[at])
        return total, states[divmod(at, SYMBOLS)][1], letters[::-1]


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    out: list = []
    i = 0
    while i < len(token):
        ch = token[i]
        j = i
        while j < len(token) and token[j] == ch:
            j += 1
        if ch.isalpha():
            out.append([(ch * (j - i), 0.0)] if j - i < 3 else [(ch, -0.7), (ch * 2, -0.7)])
        elif ch == "*":
            out += [[(x, -1.5) for x in _ANY] + [("", -2.0)]] * (j - i)
        elif ch in LEET:
            nothing = -0.5 if ch in OPENING and i == 0 or ch in CLOSING and j == len(token) else -4.0
            if j - i < 3:
                out += [[(x, -0.5) for x in LEET[ch]] + [("", nothing)]] * (j - i)
            else:
                out.append([(x * n, -1.2) for x in LEET[ch] for n in (1, 2)] + [("", max(nothing, -2.0))])
        elif ch in SEPARATORS:
            out.append([("", -0.5), (" ", -0.5)])
        else:
            out.append([(" ", 0.0)])
        i = j
    return out


class Restorer:
    """Readings of tokens, kept up to ``CACHE`` of them."""

    def __init__(self, model: CharacterModel):
        self.model, self.seen = model, {}

    def token(self, token: str) -> str:
        if len(token) > KEPT:
            return self._read(token)
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            got = self.seen[token] = self._read(token)
        return got

    def _read(self, token: str) -> str:
        if not any(c.isalpha() or (c in LEET and not c.isdigit()) for c in token):
            return token
        return self.model.decode(_lattice(token))[1]

    def spaced(self, segment: str) -> str:
        """Single characters apart: all together, or as they stand; two must gain e**4 by it, three e**2, more nothing."""
        got = self.seen.get(segment)
        if got is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            chars = [c for c in segment if c not in " .-_"]
            lattice = []
            for k, c in enumerate(chars):
                if k:
                    lattice.append([("", min(0.0, len(chars) - 4.0)), (" ", -1.0)])
                lattice.append([(c, 0.0)] if c.isalpha() else [(x, -0.5) for x in LEET.get(c, " ")])
            got = self.model.decode(lattice)[1]
            if len(segment) <= KEPT:
                self.seen[segment] = got
        return got

    def words(self, text: str) -> set[str]:
        """Distinct words of the restored text."""
        low = text.lower()
        tokens = low.split()
        kinds = set(tokens)
        out = {t for t in kinds if t.isalpha()}
        runs = _RUN.search(low) is not None
        if runs:
            for t in list(out):
                if _RUN.search(t):
                    out.update(self.token(t).split())
        for t in kinds - out:
            bare, core = t.strip(EDGE), t.strip(SENTENCE)
            if core != bare:  # signs at the ends can be letters
                out.update(self.token(core).split())
            if bare.isalpha():
                out.add(bare)
                if runs and _RUN.search(bare):
                    out.update(self.token(bare).split())
            elif bare:
                out.update(self.token(bare).split())
                out.update(x for x in _PIECES.split(bare) if x)
        if [*map(len, tokens)].count(1) >= 2:
            for m in _SPACED.finditer(low):
                out.update(self.spaced(m[0]).split())
        return out


def _features(words: set[str]) -> set[str]:
    out = set(words)
    for w in words:
        for n in BEGINNINGS:
            if len(w) > n:
                out.add("^" + w[:n])
    return out


def character_model(docs: DataFrame) -> CharacterModel:
    """Trigram counts over all whole texts; at most SYMBOLS**3 sums reach the driver."""
    ship(docs.sparkSession)

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, buf, off in tc.blocks(batch.column(0)):
                if not len(buf):
                    continue
                cp, at = code_points(buf)
                c = np.where(cp < 0x250, _TABLE[np.minimum(cp, 0x24F)], 0)
                c = np.insert(c, np.searchsorted(at, off), 0)
                c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one bound between words
                # After a bound, what stood before it doesn't count.
                before = np.where(c[1:-1] == 0, 0, c[:-2])
                total += np.bincount((before * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k])], ["k", "n"])

    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in docs.select("text").where("text is not null").mapInArrow(tc.tidied(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["k"]] = r["n"]
    return CharacterModel(counts)


class Classifier:
    def __init__(self, weights: dict[str, float], bias: float, alone: dict[str, float] | None = None):
        """alone: the log odds that a feature gives by itself; the strongest is a lower bound of the score."""
        self.weights, self.bias, self.alone = weights, bias, alone or {}
        self.starts = {f[1 : 1 + BEGINNINGS[0]] for f in weights if f[0] == "^"}

    def score(self, words: set[str]) -> float:
        weights, starts, n = self.weights, self.starts, BEGINNINGS[0]
        hits = {w for w in words if w in weights}
        for w in words:
            if w[:n] in starts:
                hits.update(b for b in ("^" + w[:k] for k in BEGINNINGS if len(w) > k) if b in weights)
        z = self.bias + sum(weights[f] for f in sorted(hits))
        z = max([z, *(self.alone[f] for f in hits if f in self.alone)])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit(samples: list[tuple[str, int]], odds: float) -> Classifier:
    """Logistic regression on the presence of the features that speak most for the class 1.

    Samples are texts of distinct words; features are made anew in each pass, so only counts of those seen in
    class 1 are held.

    ``odds``: toxic to clean among all labelled rows. Without both classes the score is constant.
    """
    n = [sum(1 for _, y in samples if y == k) for k in (0, 1)]
    if not n[0] or not n[1]:
        return Classifier({}, -2.0 if n[0] or not n[1] else 2.0)
    least = max(3, n[1] // 200)
    many: Counter = Counter()
    for w, y in samples:
        if y:
            many.update(_features(set(w.split())))
    seen = [Counter(), Counter({f: t for f, t in many.items() if t >= least})]
    del many
    for w, y in samples:
        if not y:
            seen[0].update(f for f in _features(set(w.split())) if f in seen[1])
    gain = []
    for f, t in seen[1].items():
        p, q = (t + 0.5) / (n[1] + 1), (seen[0][f] + 0.5) / (n[0] + 1)
        if p > 4 * q:
            gain.append((t * math.log(p / q), f))
    names = [f for _, f in sorted(gain, key=lambda g: (-g[0], g[1]))[:FEATURES]]
    if not names:
        return Classifier({}, math.log(odds))
    index = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(samples), len(names)), np.float32)
    for r, (w, _) in enumerate(samples):
        x[r, [index[f] for f in _features(set(w.split())) if f in index]] = 1
    y = np.array([k for _, k in samples], np.float32)
    w, b = np.zeros(len(names), np.float32), np.float32(0)
    m = [np.zeros_like(w), np.zeros_like(w)]
    mb = [0.0, 0.0]
    for t in range(1, 601):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g, gb = x.T @ (p - y) / len(y) + 1e-5 * w, float((p - y).mean())
        m[0] = 0.9 * m[0] + 0.1 * g
        m[1] = 0.99 * m[1] + 0.01 * g * g
        mb = [0.9 * mb[0] + 0.1 * gb, 0.99 * mb[1] + 0.01 * gb * gb]
        w -= 0.1 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8)
        b -= 0.1 * (mb[0] / (1 - 0.9**t)) / (math.sqrt(mb[1] / (1 - 0.99**t)) + 1e-8)
    b += 0.5 * (math.log(odds) - math.log(n[1] / n[0]))
    clean = max(1.0, n[1] / n[0] / odds)  # labelled clean rows for each in the sample, beside the toxic ones
    alone = {f: math.log((seen[1][f] - 2) / ((seen[0][f] + 2) * clean)) for f in names if seen[1][f] >= max(10, n[1] // 50, 10 * seen[0][f] * clean)}
    return Classifier({f: float(v) for f, v in zip(names, w)}, float(b), {f: v for f, v in alone.items() if v > 0})


def train(docs: DataFrame, labels: DataFrame, fold: int = 5, held_out: int = 0, per_class: tuple[int, int] = PER_CLASS) -> tuple[CharacterModel, Classifier]:
    """Both models; labels of rows whose crc32(doc_id) mod ``fold`` is ``held_out`` are never read."""
    model = character_model(docs)
    marks = labels.select("doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").where(tc.crc32_rule("doc_id", fold) != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    limit = [F.lit(tc.share_limit(per_class[k] / n[k] if n.get(k) else 0.0)).cast("long") for k in (0, 1)]
    sample = marks.where(tc.hash_sample("doc_id", F.when(F.col("toxic") == 1, limit[1]).otherwise(limit[0])))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")  # the sample is bounded by per_class
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        restore = Restorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(sorted(restore.words(t))) for t in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["words", "toxic"])

    got = rows.select("text", F.col("toxic").cast("int")).mapInArrow(tc.tidied(run), "words string, toxic int").collect()
    samples = sorted((r["words"], r["toxic"]) for r in got)
    odds = n.get(1, 0) / n[0] if n.get(0) and n.get(1) else 1.0
    return model, fit(samples, odds)


def score(docs: DataFrame, model: CharacterModel, classifier: Classifier, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and the columns in ``carry`` for every row; a null or empty text is scored as one without words.

    A very long text is read whole. Rows that repeat stay rows, each scored by its own text; a null doc_id stays null.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model, classifier))  # fixed size: SYMBOLS**3 and FEATURES numbers
    source = docs.select("doc_id", "text", *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])
    carried = [f"carried_{k}" for k in range(len(carry))]

    def run(batches):
        model, classifier = shared.value
        restore = Restorer(model)
        for batch in batches:
            texts = batch.column(1)
            for i in range(0, len(batch), 256):
                part = texts.slice(i, 256).to_pylist()
                more = [batch.column(2 + k).slice(i, 256) for k in range(len(carried))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), pa.array([classifier.score(restore.words(t or "")) for t in part], pa.float64()), *more], ["doc_id", "score", *carried])

    kinds = "".join(f", {c} {source.schema[c].dataType.simpleString()}" for c in carried)
    return source.mapInArrow(tc.tidied(run), "doc_id long, score double" + kinds).withColumnsRenamed({f"carried_{k}": c for k, c in enumerate(carry)})


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Only doc_id and text are read of the documents."""
    model, classifier = train(docs, labels, fold, held_out)
    rest = F.coalesce(tc.crc32_rule("doc_id", fold) == held_out, F.lit(False))
    return score(docs, model, classifier).select("doc_id", rest.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, labels: DataFrame, columns: list[str], fold: int = 5, held_out: int = 0) -> DataFrame:
    """Rows of docs (their ``columns``, doc_id and text among them) that are not predicted toxic."""
    model, classifier = train(docs, labels, fold, held_out)
    out = score(docs, model, classifier, carry=tuple(c for c in columns if c != "doc_id"))
    return out.where("score < 0.5").select(*columns)
