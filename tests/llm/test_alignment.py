"""Alignment against token byte ranges compared one by one, with the libraries' own tokenizers."""

import hashlib
import random
from collections import Counter

import pytest

from vigil.llm import alignment, queries


@pytest.fixture(scope="module")
def tokenize():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    # Characters that stand for bytes in the first vocabulary: printable ones for themselves, the rest counted up from 256.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(sorted({*range(256)} - {*shown}))}
    assert decoders.ByteLevel().decode(["Ġa"]) == " a" and byte_of["Ġ"] == 32

    def run(text):
        if not text:
            return [], []
        want = (" " + text).encode()
        left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        return (left, right) if b"".join(x for _, x in left) == want == b"".join(x for _, x in right) else ([], [])

    return run


def spans(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(texts, tokenize):
    """texts: {id: text}; (n_a, n_b, n_groups, n_links, n_best, count_sum, groups text) of each."""
    rows, counts = {}, Counter()
    for d, t in texts.items():
        left, right = (spans(x) for x in tokenize(t))
        links, j = [], 0
        for i, s, e in left:
            while j and right[j][1] > s:
                j -= 1
            while j < len(right) and right[j][2] <= s:
                j += 1
            k = j
            while k < len(right) and right[k][1] < e:
                links.append((i, right[k][0]))
                k += 1
        counts.update(links)
        ends = sorted({e for *_, e in left} & {e for *_, e in right})
        groups = [(",".join(str(i) for i, s, e in left if lo <= s and e <= hi), ",".join(str(i) for i, s, e in right if lo <= s and e <= hi)) for lo, hi in zip([0, *ends], ends)]
        rows[d] = (len(left), len(right), links, ";".join(f"{x}|{y}" for x, y in groups), len(groups))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return {d: (na, nb, g, len(ln), sum(counts[p] == top[p[1]] for p in ln), sum(counts[p] for p in ln), text) for d, (na, nb, ln, text, g) in rows.items()}


TEXTS = [
    None, "", " ", "  two  spaces ", "\n\n\ttabs", "it's we'll <|endoftext|> <s></s> <0x41>", "a▁b", "▁", "日本語のテキスト 😀😀 é", "nul\0 in", "﻿mark a\xa0b ﬁ", "x" * 3000, "ab" * 2000, "the " * 3000, "1234567890 3.14",
    "Ünïcödé 𝔘𝔫𝔦", "İstanbul ſ K", "the cat", "the cat",
]


@pytest.mark.parametrize("chunk", [1 << 22, 300])
def test_digest(spark, tokenize, chunk):
    rng = random.Random(3)
    texts = dict(enumerate([*TEXTS, *("".join(rng.choice(["the", " ", " cat", "é", "▁", "\n", "ing", "😀", "0", "'s", "x"]) for _ in range(rng.randrange(60))) for _ in range(200))]))
    want = brute(texts, tokenize)
    out = alignment.digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), chunk_links=chunk).collect()
    assert len(out) == len(texts)
    for r in out:
        *numbers, text = want[r.doc_id]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum] == numbers, texts[r.doc_id]
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "")
    assert want[6][:4] == want[7][:4] == (0, 0, 0, 0)  # U+2581 is read as a space


def test_lists_give_the_same_links_and_groups(spark, tokenize):
    texts = dict(enumerate(TEXTS))
    want = brute(texts, tokenize)
    for r in alignment.align_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        na, nb, groups, links, _, _, text = want[r.doc_id]
        assert (len(r.a_ids), len(r.b_ids), len(r.group_a), len(r.link_a)) == (na, nb, groups, links) and len(r.link_b) == links
        ends = list(zip([*r.group_a[1:], na], [*r.group_b[1:], nb]))
        written = [f"{','.join(map(str, r.a_ids[i:j]))}|{','.join(map(str, r.b_ids[k:m]))}" for i, k, (j, m) in zip(r.group_a, r.group_b, ends)]
        assert ";".join(written) == text


def test_query(spark, tokenize):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = brute(docs, tokenize)
    out = queries.op11_alignment(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len(docs)
    for r in out:
        *numbers, text = want[r.doc_id]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum] == numbers
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "")
