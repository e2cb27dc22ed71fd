"""Slices and words that a polynomial hash can't tell apart, and added tokens."""

import base64
import random
import zlib

import numpy as np
import pyarrow as pa
from test_llm_operators import WORD, components_of, shingles, without_repeats

from vigil.llm import bpe, neardup, packing, substrings, textcore


def thue_morse(n, one="a", two="b"):
    return "".join((one, two)[bin(i).count("1") % 2] for i in range(n))


COLLIDING = [thue_morse(n, *pair) for n in (1024, 2048, 4096) for pair in (("a", "b"), ("b", "a"))]


def test_slices_are_told_apart_by_bytes(monkeypatch):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    items = COLLIDING + [" ".join(COLLIDING), "plain words and more words"]
    e = bpe.Encoder(bpe.default_rank_file())
    for weak in (False, True):  # with a hash that collides always, the bytes still decide
        if weak:
            monkeypatch.setattr(textcore, "_lane_hashes", lambda lens, *_: lens.astype(np.uint64) % np.uint64(3))
        for i, buf, off in textcore.blocks(pa.array(items)):
            ids, at = e.encode_block(buf, off)
            for d in range(len(off) - 1):
                assert ids[at[d] : at[d + 1]].tolist() == lib.encode_ordinary(items[i + d])
            assert e.decode(ids).tobytes() == buf.tobytes()


def test_words_have_distinct_hashes():
    rng = random.Random(5)
    words = sorted({*COLLIDING, *("".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(20000)), "a" * 8, "a" * 8 + "\0", "a\0"})
    h, *_ = textcore.word_hashes(*[(b, o) for _, b, o in textcore.blocks(pa.array([" ".join(words)]))][0])
    assert len(np.unique(h)) == len(words)
    one, two = (textcore.window_hashes(np.array([h[0], h[1]])[[int(c == "b") for c in x]], 1024) for x in COLLIDING[:2])
    assert one[0] != two[0]


def test_packing_ids_with_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, mark * 2 + "x", f"it's  {mark}'s", f"end {mark}", f"{mark} start", "<|endoftext", "plain", "", *COLLIDING, " ".join(COLLIDING)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    seen = [0] * len(texts)
    for r in packing.pack_documents(df).collect():
        part = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids == part and r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r.doc_id] += r.length
    assert seen == [len(w) for w in want]


def test_duplicates_and_passages_of_colliding_words(spark):
    a, b = COLLIDING[:2]
    line = [f"w{i}" for i in range(60)]
    texts = {1: " ".join([a, *line]), 2: " ".join([b, *line]), 3: " ".join([a] * 55), 4: " ".join([b] * 55), 5: " ".join([a] * 55), 6: a, 7: b}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = components_of({i: shingles(WORD.findall(t), 4) for i, t in texts.items()})
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 4, 80).collect()} == want
    kept = without_repeats(texts)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeated(df).collect()} == kept
