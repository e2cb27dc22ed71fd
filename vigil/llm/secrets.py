"""Secret scan: Aho-Corasick keywords, anchored expressions near their hits, checksums that the secret itself holds.

One automaton holds every keyword (the words of assignments in every case, the prefixes of keys) and reads each
text once; an expression is tried only where a keyword stands, anchored to it. Long runs of hexadecimal digits
have no word in common, so a second automaton reads the text folded to "digit or not" and its keyword is
``HEX_RUN`` digits in a row. Kinds whose form carries a checksum count only if it holds.

Kinds that go by form alone:

* ``assign``: a word such as ``password`` (ASCII letters of either case), ``:`` or ``=`` and a value of 6 or more characters;
* ``access``: ``AKIA`` and capital letters or digits, 20 or more characters in all;
* ``hex``: a run of 24 or more lower-case hexadecimal digits.

Kinds that must prove themselves: ``github`` and ``npm`` tokens (their last 6 characters are the CRC-32 of the 30
before them, in base 62), ``xprv`` extended private keys (base 58 with the first 4 bytes of a double SHA-256) and
``jwt`` (three parts of base 64, the first two JSON objects, with an algorithm and a signature of the length it has).

Spans are leftmost and don't overlap within a kind; a match that fails by length is dropped and still takes its place,
as in a plain search for the expression. Different kinds may overlap.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textcore as tc
from vigil.llm.runtime import ship

HEX_RUN = 24
SPANS = "array<struct<kind: string, start: long, end: long>>"
#: Spans at one position stand in this order.
KINDS = ["assign", "access", "hex", "github", "npm", "xprv", "jwt"]
BASE_KINDS = KINDS[:3]
# Words that an assignment names, alphabets of base 62 and 58.
WORDS = ["password", "passwd", "secret", "token", "api_key", "apikey"]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
#: Bytes of a signature by algorithm.
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
_FOLD = bytes(0x68 if chr(i) in "0123456789abcdef" else 0x20 for i in range(256))


def base62_crc(body: bytes) -> bytes:
    """CRC-32 of ``body`` in 6 digits of base 62."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out.encode()


def _crc_holds(m: re.Match) -> bool:
    return base62_crc(m[1]) == m[2]


def _base58_holds(m: re.Match) -> bool:
    n = 0
    for c in m[0].decode():
        n = n * 58 + BASE58.index(c)
    if n >> (8 * 82):
        return False
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:78]).digest()).digest()[:4] == raw[78:]


def _unpadded(part: bytes) -> bytes:
    return base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))


def _token_holds(m: re.Match) -> bool:
    try:
        head, body = (json.loads(_unpadded(m[i])) for i in (1, 2))
        sign = _unpadded(m[3])
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return False
    return len(sign) == SIGNATURE.get(head["alg"], len(sign)) and len(sign) >= 32


#: Expression anchored at a keyword, and what a match must hold; a match that fails still takes its place.
RULES = {
    "assign": (re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    "access": (re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= HEX_RUN),
    "github": (re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _crc_holds),
    "npm": (re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _crc_holds),
    "xprv": (re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"), _base58_holds),
    "jwt": (re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)"), _token_holds),
}


def automata():
    """The automaton of keywords and that of digit runs; the value of a hit is (kind, length of the keyword)."""
    kept = sys.__dict__.setdefault("_vigil_secrets", {})
    if "words" not in kept:
        import ahocorasick

        words, runs = ahocorasick.Automaton(), ahocorasick.Automaton()
        for word in WORDS:
            for form in itertools.product(*({c, c.upper()} for c in word)):
                words.add_word("".join(form), ("assign", len(word)))
        for kind, marks in {"access": ["AKIA"], "github": [f"gh{c}_" for c in "pousr"], "npm": ["npm_"], "xprv": ["xprv"], "jwt": ["eyJ"]}.items():
            for mark in marks:
                words.add_word(mark, (kind, len(mark)))
        runs.add_word("h" * HEX_RUN, ("hex", HEX_RUN))
        words.make_automaton()
        runs.make_automaton()
        kept["words"], kept["runs"] = words, runs
    return kept["words"], kept["runs"]


def spans(raw: bytes, off: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each document of a block, in bytes of the block, by start and kind."""
    words, runs = automata()
    out = [[] for _ in range(len(off) - 1)]
    ends = off.tolist()
    for automaton, text in ((words, raw.decode("latin-1")), (runs, raw.translate(_FOLD).decode("latin-1"))):
        hits = [(at + 1 - size, at + 1, kind) for at, (kind, size) in automaton.iter(text)]
        if not hits:
            continue
        doc = np.searchsorted(off, np.array([h[0] for h in hits]), side="right") - 1
        taken = dict.fromkeys(KINDS, 0)
        for d, (start, stop, kind) in sorted(zip(doc.tolist(), hits), key=lambda x: x[1]):
            if stop > ends[d + 1] or start < taken[kind]:  # it would reach into the next text, or stands in a match
                continue
            rule, holds = RULES[kind]
            m = rule.match(raw, start, ends[d + 1])
            if m:
                taken[kind] = m.end()
                if holds(m):
                    out[d].append((kind, start, m.end()))
    order = {k: i for i, k in enumerate(KINDS)}
    for found in out:
        found.sort(key=lambda s: (s[1], order[s[0]]))
    return out


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, ``text`` and ``spans`` (kind, start and end in code points, end exclusive).

    Every whole text is read, however long; a null or empty text has no spans. Rows that repeat stay rows, a null
    id stays null. Only the two columns named are read, so other columns can't clash.
    """
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, buf, off in tc.blocks(texts):
                found = spans(buf.tobytes(), off)
                if any(found):
                    point = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                    found = [[{"kind": k, "start": int(point[a] - point[o]), "end": int(point[b] - point[o])} for k, a, b in s] for s, o in zip(found, off.tolist())]
                n = len(off) - 1
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, n), texts.slice(i, n), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                    ["id", "text", "spans"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(tc.tidied(run), f"id {kind}, text string, spans {SPANS}")
    return out.withColumnsRenamed({"id": id_column, "text": text_column})


def redacted(scanned: DataFrame, text_column: str = "text") -> DataFrame:
    """``scan``'s rows with each span's part of the text replaced by ``[kind]``.

    Where spans overlap, the one that begins first (of several the first kind) gives the name and what the others
    reach beyond it goes too; a null text stays null.
    """
    cut = F.aggregate(
        F.col("spans"),
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["done"], F.substring(F.col(text_column), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["done"]).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substring(F.col(text_column), acc["at"] + 1, F.length(text_column))),
    )
    return scanned.withColumn(text_column, F.when(F.size("spans") > 0, cut).otherwise(F.col(text_column)))


def _written(found):
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the kinds that go by form, the digest of their spans, and all spans as text."""

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return scanned.select("doc_id", *counts, F.sha2(_written(of(*BASE_KINDS)), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
