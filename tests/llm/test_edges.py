"""Nulls, empty and long texts, repeated rows, empty tables and columns with clashing names, for every operator."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from vigil.llm import alignment, ann, bpe, cleaning, langid, language_model, licences, neardup, packing, secrets, substrings, toxicity

LONG = " ".join(f"word{i % 977} and" for i in range(30000)) + "."
WORDS = "id long, text string, lang string, n long"


def docs(spark, rows=None):
    rows = rows if rows is not None else [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, LONG), (6, LONG), (7, "x" * 60000), (8, "Licensed under the MIT License.\nplain line"), (9, "é ü 日本 😀 <|endoftext|>"),
        (None, "a text without an id that is read like all others"), (10, "the idiot and the moron " * 3),
    ]
    # Names that operators use for their own columns.
    df = spark.createDataFrame([(i, t, ("en", "fr")[(i or 0) % 2] if t else None, 1) for i, t in rows], "doc_id long, text string, lang string, n long")
    return df.withColumns({c: F.lit("clash") for c in ("cid", "v", "w", "ws", "kept", "score", "words", "chunk", "train", "id", "ids", "component_id", "set", "found")})


def labels(spark):
    return spark.createDataFrame([(i, 1, int(i == 10)) for i in range(1, 11)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


RUNS = {
    "op2": lambda s, d: language_model.score_documents(d),
    "op3": lambda s, d: packing.pack_documents(d),
    "op4": lambda s, d: cleaning.clean_lines(d),
    "op5": lambda s, d: toxicity.toxicity(d, labels(s)),
    "op6": lambda s, d: licences.digest(licences.scan(d)),
    "op7": lambda s, d: bpe.round_trip(d),
    "op8": lambda s, d: neardup.near_duplicates(d),
    "op9": lambda s, d: substrings.remove_repeated(d, bits=16),
    "op10": lambda s, d: langid.identify(d),
    "op11": lambda s, d: alignment.digest(d, chunk_links=20000),
    "op12": lambda s, d: secrets.digest(secrets.scan(d)),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, name):
    d = docs(spark)
    out = RUNS[name](spark, d).collect()
    if name == "op3":
        assert {r.doc_id for r in out} == {None, *range(1, 11)}
    else:
        assert len(out) == d.count()
    first = {r.doc_id: r for r in out}
    if name == "op2":
        assert first[1].n_tokens == first[2].n_tokens == first[3].n_tokens == 1 and first[4].n_tokens == 2
    elif name == "op3":
        assert first[1].doc_tokens == 1 and first[1].ids_crc32 == zlib.crc32(b"\0\0\0\0")
    elif name == "op4":
        assert first[1].n_words == 0 and first[1].base_failed and not first[1].kept
    elif name == "op6":
        assert first[8].licences == "mit" and first[1].licences == "" and first[1].n_paragraphs == 0
    elif name == "op7":
        empty = hashlib.sha256(b"").hexdigest()
        assert first[1].decoded_sha256 == first[2].ids_sha256 == empty
        assert all(r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for r in out for i, t in [(x.doc_id, x.text) for x in d.collect()] if i == r.doc_id)
    elif name == "op8":
        assert first[1].n_shingles == 0 and first[1].component_id == 1 and first[6].component_id == 5 and not first[6].kept
        assert first[None].component_id is None and first[None].kept
    elif name == "op9":
        assert first[1].n_words == 0 and first[6].n_removed == first[6].n_words and first[5].n_removed == 0 and first[6].kept == ""
    elif name == "op10":
        assert first[1].lang_pred == first[2].lang_pred == "und" and first[4].lang_pred in ("en", "fr")
    elif name == "op11":
        assert (first[1].n_a, first[1].n_links, first[1].count_sum, first[1].groups_sha256) == (0, 0, 0, "") == (first[2].n_b, first[2].n_groups, first[2].n_best, first[2].groups_sha256)
        assert first[3].n_a and first[5].groups_sha256 == first[6].groups_sha256 and first[9].n_b and first[None].n_links
    elif name == "op12":
        assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.n_assign + r.n_access + r.n_hex == 0 for r in out)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark, docs(spark, [])).count() == 0


def test_search_edges(spark):
    e = [(0, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [1.0, None, 0.0]), (7, []), (None, [1.0, 1.0, 1.0]), (8, [0.5, 0.5])]
    v = spark.createDataFrame([(i, x, 1) for i, x in e], "vec_id long, embedding array<float>, key long")
    got = ann.search(v, v.where("vec_id % 20 = 0"), top=3).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0][:2] == [(1, 1.0), (2, 1.0)]
    assert {r.query_id for r in got} == {0, 20} and not {3, 4, 5, 6, 7, 8} & {r.vec_id for r in got}
    assert ann.search(v.limit(0), v.limit(0)).count() == 0


def test_samples_stay_bounded_and_are_never_empty(spark):
    """A share far under 2**-32, as of 1e10 and more rows, still picks its rows; the limit is a 64-bit number."""
    from vigil.llm import textcore

    for total in (1e10, 1e13, 1e15):
        limit = textcore.share_limit(900 / total)
        assert abs((limit + (1 << 63)) / 2.0**64 * total - 900) < 1
    assert textcore.share_limit(1.0) == textcore.share_limit(7.0) == (1 << 63) - 1 and textcore.share_limit(0.0) == -(1 << 63)
    rows = spark.range(200000)
    for share in (1e-3, 0.1, 1.0):
        got = rows.where(textcore.hash_sample("id", F.lit(textcore.share_limit(share)))).count()
        assert abs(got - 200000 * share) <= 5 * (200000 * share) ** 0.5


def test_texts_in_no_language_are_noise(spark):
    import random

    rng = random.Random(3)
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.train(docs_, F.lit(True))
    odd = [(i, "".join(rng.choice("qwxzjkvbpfgh ") for _ in range(900))) for i in range(20)] + [(100 + i, "".join(chr(rng.randrange(0x430, 0x450)) for _ in range(600))) for i in range(20)]
    noise = [r.noise for r in langid.predict(spark.createDataFrame(odd, "doc_id long, text string"), net).collect()]
    assert sum(x > net.noise_limit for x in noise) >= 36
    usual = langid.predict(docs_.where("lang is not null and length(text) > 200"), net).collect()
    assert sum(r.noise > net.noise_limit for r in usual) <= 0.005 * len(usual)


def _recall(spark, x, top=20):
    import numpy as np

    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(v, v.where("vec_id % 20 = 0"), top=top).collect():
        got.setdefault(r.query_id, []).append(r)
    hit = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, min(top, len(x) - 1) + 1)) and all(a.score >= b.score for a, b in zip(mine, mine[1:]))
        assert all(abs(r.score - x[q] @ x[r.vec_id]) <= 1e-9 * abs(r.score) for r in mine)
        hit += len({r.vec_id for r in mine} & set(np.argsort(-s, kind="stable")[:top].tolist()))
    return hit / (len(range(0, len(x), 20)) * min(top, len(x) - 1))


@pytest.mark.parametrize("kind", ["unit", "lognormal", "few long", "copies"])
def test_search_recall_by_norms(spark, kind):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lognormal":
        x *= rng.lognormal(0, 1, (3000, 1))
    elif kind == "few long":
        x[rng.random(3000) < 0.02] *= 20
    elif kind == "copies":
        x[1000:1600] = x[7]
        assert len({r.vec_id for r in ann.search(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), spark.createDataFrame([(7, x[7].tolist())], "vec_id long, embedding array<double>")).collect()}) == 20
        return
    assert _recall(spark, x) >= 0.9


def test_search_finds_all_of_few(spark):
    import numpy as np

    x = np.random.default_rng(5).normal(size=(20, 64))
    assert _recall(spark, x) == 1.0


def test_search_with_tiny_and_huge_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 16))
    x[0] *= 1e-200
    x[1:5] *= 1e-310
    x[20] *= 1e200
    x[21:30] *= 1e180
    x[40] *= 1e307
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(v, v.where("vec_id % 20 = 0"), top=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    with np.errstate(over="ignore", invalid="ignore"):
        for q in (0, 20, 40):
            s = np.zeros(60)
            for k in range(16):
                s += x[q, k] * x[:, k]
            order = sorted((i for i in range(60) if i != q), key=lambda i: (-s[i] if s[i] == s[i] else np.inf, i))[:20]
            assert [(n, i) for n, i, _ in sorted(got[q])] == [(n + 1, i) for n, i in enumerate(order)]
            assert all(a == s[i] or (a != a and s[i] != s[i]) for _, i, a in got[q])
