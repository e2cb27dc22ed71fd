"""Operators against brute force, exact round trips or held-out accuracy."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigil.llm import ann, bpe, cleaning, graph, langid, language_model, licences, neardup, packing, substrings, textcore, toxicity

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def test_word_bounds_and_window_hashes():
    random.seed(2)
    items = ["".join(random.choice(" \t\n\x0b\x1cab é") for _ in range(random.randint(0, 30))) for _ in range(500)]
    for i, buf, off in textcore.blocks(pa.array(items), 700):
        h, first, s, e = textcore.word_hashes(buf, off)
        raw = buf.tobytes()
        for d in range(len(off) - 1):
            assert [raw[a:b].decode() for a, b in zip(s[first[d] : first[d + 1]], e[first[d] : first[d + 1]])] == WORD.findall(items[i + d])
        w = [raw[a:b] for a, b in zip(s, e)]
        for n in (1, 2, 3, 7, 25, 50):  # equal runs have equal hashes, others don't
            runs = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
            for hashes in (textcore.window_hashes(h, n), textcore.window_hashes(h, n, True), textcore.ngram_hashes(h, n)):
                assert len(hashes) == len(runs) and len({*zip(runs, hashes.tolist())}) == len(set(runs)) == len({*hashes.tolist()})


def test_search_recall(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = collections.defaultdict(list)
    for r in ann.search(v, v.where("vec_id % 20 = 0"), top=20).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    p = v.select("vec_id", "embedding").toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    hit = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        mine = sorted(got[ids[k]])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(a[2] >= b[2] for a, b in zip(mine, mine[1:]))
        assert all(math.isclose(m[2], float(x[k] @ x[ids == m[1]][0]), rel_tol=1e-12) for m in mine)
        hit += len(set(best) & {m[1] for m in mine})
        total += 20
    assert hit / total >= 0.9


def test_language_model(documents, texts):
    c = collections.Counter()
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    for i, w in tokens.items():
        if not held[i]:
            c.update(w)
    n, v = sum(c.values()), len(c)
    base = model = 0.0
    for r in language_model.score_documents(documents).collect():
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[t] > 0 for t in w), n, held[r.doc_id])
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w), rel_tol=1e-9)
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    assert model > base


def test_language_model_by_hand(spark, documents, texts, monkeypatch):
    """Scores against counts in plain Python: with the learned weights exactly, with weights from unrounded estimates closely."""
    some = {i: t for i, t in texts.items() if i % 4 == 0}
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in some.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in some}
    one, two = collections.Counter(), collections.Counter()
    for i, w in tokens.items():
        if not held[i]:
            one.update(w)
            two.update(zip([None, *w], w))
    n, v = sum(one.values()), len(one)
    got = []
    learn = language_model.learn_weights
    monkeypatch.setattr(language_model, "learn_weights", lambda *a: got.append(learn(*a)) or got[-1])
    rows = language_model.score_documents(documents.where("doc_id % 4 = 0")).collect()
    bucket = lambda c: int(language_model.bucket_of(np.array([c]))[0])

    def score(words, weights):
        total = 0.0
        for a, b in zip([None, *words], words):
            k = weights[bucket(one[a])]
            total += math.log10(k[0] * (two[a, b] / one[a] if one[a] else 0) + k[1] * one[b] / n + k[2] / (v + 1))
        return total

    exact = np.full((language_model.BUCKETS, 3), 1 / 3)
    seen = collections.Counter()  # (bucket, estimates) of each training token, held out of its own counts
    for i, w in tokens.items():
        if not held[i]:
            for a, b in zip([None, *w], w):
                c = one[a] - 1
                seen[bucket(c), (two[a, b] - 1) / c if c else 0.0, (one[b] - 1) / (n - 1)] += 1
    b, f, m = np.array([k[0] for k in seen]), np.array([[k[1], k[2], 1 / (v + 1)] for k in seen]), np.array([*seen.values()])
    for _ in range(40):
        part = exact[b] * f
        part *= (m / part.sum(axis=1))[:, None]
        new = np.stack([np.bincount(b, weights=part[:, k], minlength=language_model.BUCKETS) for k in range(3)], axis=1)
        total = new.sum(axis=1, keepdims=True)
        exact = np.where(total > 0, new / np.maximum(total, 1e-12), new.sum(axis=0) / new.sum())
    mine = theirs = 0.0
    for r in rows:
        assert math.isclose(r.score, score(tokens[r.doc_id], got[0]), rel_tol=1e-9)
        if held[r.doc_id]:
            mine, theirs = mine + r.score, theirs + score(tokens[r.doc_id], exact)
    assert abs(mine - theirs) < 0.001 * abs(theirs)


def test_counts_beyond_32_bits():
    keys = np.arange(5, dtype=np.uint64) * np.uint64(1 << 40)
    row = {"kind": 0, "bucket": 0, "keys": language_model.pack_sorted(keys), "n": language_model.pack_numbers(np.full(5, 3_000_000_000, np.uint64))}
    table = pa.table({"kind": pa.array([0, 0], pa.int32()), "bucket": pa.array([0, 0], pa.int32()), "chunk": pa.array([1, 2], pa.int64()), "keys": [row["keys"]] * 2, "n": [row["n"]] * 2})
    out = language_model._summed(table).to_pylist()
    assert out[-1]["total"] == 30_000_000_000 and (language_model.unpack_numbers(out[0]["n"]) == 6_000_000_000).all()


def test_interpolation_weights_are_learned():
    rng = np.random.default_rng(0)
    cells = (np.full(4000, 5) * language_model.Q2 + rng.integers(1, 20, 4000)) * language_model.Q1 + rng.integers(40, 60, 4000)
    w = language_model.learn_weights(cells, np.ones(4000), 1000)
    assert w.shape == (language_model.BUCKETS, 3) and np.allclose(w.sum(axis=1), 1) and w[5, 0] > 0.9 and w[0, 0] == 0
    for x in (np.zeros(0, np.uint32), np.arange(300, dtype=np.uint32) ** 2):
        assert (language_model.unpack_numbers(language_model.pack_numbers(x)) == x).all()


@pytest.mark.parametrize("seed", range(8))
def test_packing_is_whole(seed):
    rng = np.random.default_rng(seed)
    for high in (2, 40, 600, 1500, 5000):
        lens = rng.integers(0, high, rng.integers(0, 400))
        doc, start, size, bin_, at = packing.pack(lens, 1024, 16)
        for part, pos, total in ((doc, start, lens), (bin_, at, None)):
            order = np.lexsort((pos, part))
            p, s, z = part[order], pos[order], size[order]
            for k in np.unique(p):
                m = p == k
                assert (s[m] == np.cumsum(z[m]) - z[m]).all() and (z[m].sum() == total[k] if total is not None else z[m].sum() <= 1024)
        if len(bin_):
            assert sorted(np.unique(bin_)) == list(range(bin_.max() + 1)) and (bin_.max() + 1) * 1024 - lens.sum() < 1024


def test_packing_ids(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = documents.where("doc_id < 60")
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in some.collect()}
    for r in packing.pack_documents(some).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == part and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())


def test_cleaning(documents, texts):
    got = cleaning.clean_lines(documents).collect()
    for r in got:
        t = texts[r.doc_id]
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = [False] * len(w)
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                hit[i : i + 3] = [True] * 3
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * sum(hit) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_cleaning_lines_by_hand(spark, documents):
    """Lines dropped, characters kept, the verdict and the cleaned text against the rules in plain Python."""
    odd = ["a | b | c | d", "Home", "home page", "#### $$$ %%%", "what?! yes!", "function() { }", "alle Rechte vorbehalten", "Read our Privacy Policy now", "plain line of words"]
    mine = spark.createDataFrame([(-1 - k, "\n".join([x, *["some words of prose number %d in a row here" % i for i in range(12)], x, ""])) for k, x in enumerate(odd)], "doc_id long, text string")
    both = documents.select("doc_id", "text").unionByName(mine)
    blank = re.compile(r"[\x20\x09-\x0D]+")

    def good(line):
        bare, low = blank.sub("", line), line.strip(" ").lower()
        signs = len(re.findall(r"[#*$%&|<>!?]", bare))
        return not (signs > len(bare) * 0.08 or re.search("[{}]", line) or len(re.findall("[|»·›]", line)) >= 3 or low in cleaning.MENU or any(x in low for x in cleaning.BOILERPLATE))

    texts = {r.doc_id: r.text or "" for r in both.collect()}
    for r in cleaning.clean_lines(both).collect():
        lines = [x for x in texts[r.doc_id].split("\n") if WORD.search(x)]
        kept = [x for x in dict.fromkeys(lines) if good(x)]
        chars = sum(len(blank.sub("", x)) for x in kept)
        assert (r.lines_dropped, r.kept_chars) == (len(lines) - len(kept), chars), r.doc_id
        assert r.kept == (not r.base_failed and chars >= r.word_chars * 0.6) and r.cleaned == ("\n".join(kept) if r.kept else "")


def test_cleaning_verdict_follows_labels(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    r = cleaning.clean_lines(documents).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double"))).collect()
    share = dict(map(tuple, r))
    assert share[1] >= 0.98 and share.get(0, 0) <= 0.1


def test_cleaning_stays_native(documents):
    plan = cleaning.clean_lines(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_restoration():
    text = "the stupid idiot saw a loser and a moron in the trash with an idiot and a pathetic clown " * 40
    model = toxicity.CharacterModel(_trigrams(text))
    r = toxicity.Restorer(model)
    for shown, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("st*pid", "stupid"), ("p@thetic", "pathetic"), ("looooser", "loser"), ("idi.ot", "idiot"), ("tr4sh", "trash")):
        assert meant in r.words(f"you {shown}!"), shown
    assert "idiot" in r.words("what an i d i o t he is")
    assert r.words("Plain words, only.") == {"plain", "words", "only"}


def _trigrams(text):
    s = toxicity.SYMBOLS
    out = np.zeros(s**3, np.int64)
    for w in text.split():
        c = [0, 0, *[toxicity._CODE.get(x, 0) for x in w], 0]
        for a, b, d in zip(c, c[1:], c[2:]):
            out[(a * s + b) * s + d] += 1
    return out


def test_toxicity_held_out(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    r = toxicity.toxicity(documents, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert len(r) > 30 and sum(x.predicted == x.toxic for x in r) / len(r) >= 0.9 and all(0 <= x.score <= 1 for x in r)


def test_licences():
    m = licences.LicenceModel()
    for line, family in (("Licensed under the Apache License, Version 2.0.", "apache"), ("Released under the MIT License.", "mit"), ("All rights reserved.", "proprietary"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under CC BY 4.0.", "cc-by"), ("This work is licensed under the GNU General Public License, version 3.", "gpl")):
        got = m.classify(line.lower())
        assert got and got[0] == family and got[2], line
    for line in ("he lost his driving license last year", "the public rights of way", "nothing of the kind"):
        got = m.classify(line)
        assert not got or not got[2], line


def test_encoder_equals_library():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(4)
    alphabet = " \n\t'sтtmdrevl19é中　 \U0001f600.,!-aBC\x1c\x85²½"
    items = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(4000)]
    items += ["", "'s", "''s", " 's", "\n's", "x'll'", "'re'", "a" * 3000, "ab " * 500, " " * 200, "日本語" * 100, "!" * 500, "it's we'll 'tis", "<|endoftext|>"]
    e = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for i, buf, off in textcore.blocks(pa.array(items), 5000):
        ids, at = e.encode_block(buf, off)
        for d in range(len(off) - 1):
            assert ids[at[d] : at[d + 1]].tolist() == lib.encode_ordinary(items[i + d])
        assert e.decode(ids).tobytes() == buf.tobytes()


def test_offsets(documents, texts):
    e = bpe.encoder(bpe.default_rank_file())
    for r in bpe.encode_documents(documents.where("doc_id < 20")).collect():
        raw = texts[r.doc_id].encode()
        assert all(raw[o : o + len(e.bytes_of[i])] == e.bytes_of[i] for i, o in zip(r.ids, r.offsets))


def components_of(sets, percent=80):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    shared = collections.Counter()
    for m in lists.values():
        for k, a in enumerate(m):
            shared.update((b, a) for b in m[:k])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def shingles(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def test_near_duplicates(documents, texts):
    sets = {i: shingles(WORD.findall(lower(t)), 4) for i, t in texts.items()}
    want = components_of(sets)
    for r in neardup.near_duplicates(documents, 4, 80).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicate_families(spark):
    """A family whose members differ by few or many words, and documents that are mostly one common passage."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base, passage = [rng.choice(vocabulary) for _ in range(150)], [rng.choice(vocabulary) for _ in range(60)]
    items = []
    for _ in range(130):
        x = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, 12])):
            x[rng.randrange(150)] = rng.choice(vocabulary)
        items.append(x)
    items += [passage + [rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 6, 10, 14, 20, 40]))] for _ in range(80)]
    ids = rng.sample(range(100000), len(items))
    want = components_of({i: shingles(x, 4) for i, x in zip(ids, items)})
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in zip(ids, items)], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(d, 4, 80).collect()} == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(80)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def without_repeats(texts, n=50):
    first, out = {}, {}
    for i in sorted(texts):
        w = WORD.findall(texts[i])
        drop = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first.setdefault(tuple(w[k : k + n]), i) < i:
                drop[k : k + n] = [True] * n
        out[i] = (len(w), sum(drop), " ".join(x for x, y in zip(w, drop) if not y))
    return out


@pytest.mark.parametrize(("bits", "map_bytes"), [(10, 1 << 25), (None, 1 << 25), (None, 0), (10, 0), (24, 0)])
def test_repeated_passages(documents, texts, bits, map_bytes):
    """A full sketch (2**10 cells) lets all windows pass and loses none; a map too large to send gives the same."""
    want = without_repeats(texts)
    for r in substrings.remove_repeated(documents, 50, bits, map_bytes=map_bytes).collect():
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]


@pytest.mark.parametrize("size", [2e6, 5e8, 3e10, 1e14])
def test_sketch_load_is_the_same_at_every_size(documents, texts, size):
    """Cells for each anchor stay in a fixed range, so the share of unrepeated windows that pass does too."""
    class Sized:
        def agg(self, *_):
            return self

        def first(self):
            return {"n": size}

    keys = []
    for _, buf, off in textcore.blocks(pa.array(list(texts.values()))):
        h, first, _, _ = textcore.word_hashes(buf, off)
        key, _, begin = substrings.anchors(h, first, 50)
        keys.append(key[begin])
    per_byte = len(np.unique(np.concatenate(keys))) / sum(len(t.encode()) for t in texts.values())
    load = per_byte * size / 2.0 ** substrings.sketch_bits(Sized(), 50)
    assert load <= 0.13 and 1 - math.exp(-load) < 0.13 and (1 - math.exp(-load)) ** 2 < 0.02


def test_digest(documents, texts):
    r = substrings.digest(substrings.remove_repeated(documents.where("doc_id = 3"), bits=12)).first()
    assert r.kept_sha256 == hashlib.sha256(" ".join(WORD.findall(texts[3])).encode()).hexdigest()


def test_language(documents):
    r = langid.identify(documents).join(documents.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").where("held_out and lang is not null").collect()
    assert len(r) > 200 and sum(x.lang_pred == x.lang for x in r) / len(r) >= 0.97
