"""The corpus pipeline stage by stage against plain Python on its own inputs."""

import re

from test_llm_operators import WORD, components_of, lower, shingles, without_repeats  # noqa: I001

import corpus_pipeline
from vigil.llm.runtime import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), name)
        before, after = ({r.doc_id: r.text for r in d.collect()} if "text" in d.columns else None for d in (docs, out))
        if name in ("language_id", "toxicity"):
            assert set(after.items()) <= set(before.items()) and len(after) >= 0.7 * len(before)
        elif name == "near_duplicates":
            groups = components_of({i: shingles(WORD.findall(lower(t)), 5) for i, t in before.items()})
            assert set(after) == {i for i, g in groups.items() if i == g}
        elif name == "repeated_passages":
            want = {i: (t[2] if t[1] else before[i]) for i, t in without_repeats(before).items() if not t[1] or t[2]}
            assert after == want
        else:
            assert {r.doc_id for r in out.collect()} == set(before)
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    assert re.fullmatch(r"\w+", name)


def _odd(spark, folder, rows):
    """Documents with nulls, empty and very long texts, repeated rows and ids, and columns that clash."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit("clash") for c in ("score", "kept", "noise", "mark", "gone", "carried", "carried_0", "ws")}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(1, 41)] + [(None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_with_odd_rows(spark, tmp_path):
    plain = "the river runs down to the old town and people walk along it in the evening {} sun"
    mean = "you are a stupid idiot and a worthless moron number {} go away"
    rows = [(i, (mean if i % 4 == 0 else plain).format(" ".join(f"word{i}x{k}" for k in range(30))), "en", "s", 1) for i in range(1, 41)]
    long = " ".join(f"the river {i % 991} runs" for i in range(20000))
    rows += [(50, None, "en", "s", None), (51, "", None, None, 0), (52, " \n", "en", "s", 2), (53, "x", "en", "s", 1), (54, long, "en", "s", 9), (55, long, "en", "s", 9), (55, long, "en", "s", 9), (55, "another text with this very id", "en", "s", 9), (None, long, None, "s", 9), (None, rows[3][1], "en", "s", 1), (60, "1234 ###", "en", "s", 8)]
    docs = _odd(spark, str(tmp_path), rows)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    one = [(r.doc_id, r.text) for r in kept["language_id"]]
    assert not {50, 51, 52, 60} & {i for i, _ in one} and {r[0] for r in rows[:40]} <= {i for i, _ in one} and one.count((55, long)) == 2 and (None, long) in one
    two = [(r.doc_id, r.text) for r in kept["toxicity"]]
    assert not {4, 8, 40} & {i for i, _ in two} and (None, rows[3][1]) not in two and {1, 2, 3, 54, 55} <= {i for i, _ in two}
    three = [(r.doc_id, r.text) for r in kept["near_duplicates"]]
    assert (54, long) in three and (55, long) not in three and (55, "another text with this very id") in three and (None, long) in three
    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["repeated_passages"]}


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = _odd(spark, str(tmp_path), [])
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0


def test_null_and_empty_texts_after_language(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5)]
    docs = _odd(spark, str(tmp_path), rows)
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
    assert sorted((r.doc_id, r.doc_tokens) for r in docs.collect())[:2] == [(1, 1), (2, 1)]
