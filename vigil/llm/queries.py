"""The registered query of each operator, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import alignment, ann, bpe, cleaning, conversations, langid, language_model, licences, neardup, packing, secrets, substrings, toxicity

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BOILER = " or ".join(f"contains(low, '{x}')" for x in cleaning.BOILERPLATE)
_MENU = ", ".join(f"'{x}'" for x in cleaning.MENU)

#: DuckDB SQL for the same rows, without sketches or hashes: all pairs of documents with a common shingle, all windows as text.
_SQL: dict[str, str] = {
    "op4_line_cleaning": rf"""
with t as (select doc_id, coalesce(text, '') as t, {_WORDS} as w from documents),
rows as (select row_number() over () as r, * from t),
lines as (
  select r, line, pos, row_number() over (partition by r, line order by pos) as nth from (
    select r, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as pos from rows
  ) where regexp_matches(line, '[^\x20\x09-\x0D]')
),
judged as (
  select *, regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') as bare, lower(trim(line, ' ')) as low from lines
),
verdict as (
  select *, not (
    length(regexp_replace(bare, '[^#*$%&|<>!?]+', '', 'g')) > length(bare) * 0.08 or regexp_matches(line, '[{{}}]')
    or length(regexp_replace(line, '[^|»·›]+', '', 'g')) >= 3 or low in ({_MENU}) or {_BOILER}
  ) as good from judged
),
by_line as (
  select r, count(*) filter (where nth > 1) as n_dup_lines, coalesce(sum(length(bare)) filter (where nth = 1 and good), 0) as kept_chars from verdict group by r
),
grams as (
  select r, pos, w[pos] || ' ' || w[pos + 1] || ' ' || w[pos + 2] as g from (select r, w, unnest(generate_series(1, len(w) - 2)) as pos from rows where len(w) > 2)
),
again as (select r, pos from grams qualify count(*) over (partition by r, g) > 1),
covered as (select r, count(distinct pos + k) as n from again, (values (0), (1), (2)) as o(k) group by r),
counts as (
  select rows.r, doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words, coalesce(kept_chars, 0) as kept_chars
  from rows left join by_line on by_line.r = rows.r left join covered on covered.r = rows.r
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and kept_chars >= word_chars * 0.6 as kept
from counts""",
    "op8_minhash_bottom_k": rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
g as (
  select distinct doc_id, array_to_string(case when len(w) >= 4 then w[p : p + 3] else w end, ' ') as g
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) as p from w where len(w) > 0)
),
n as (select doc_id, count(*) as n from g group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as m from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 80 * (x.n + y.n - m)),
sides as (select a, b from link union all select b, a from link),
reach(a, b) as (select a, b from sides union select reach.a, sides.b from reach join sides on sides.a = reach.b),
least_of as (select a, min(b) as low from reach group by a)
select w.doc_id, coalesce(n, 0) as n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) as component_id, w.doc_id <= coalesce(low, w.doc_id) as kept
from w left join n on n.doc_id = w.doc_id left join least_of on least_of.a = w.doc_id""",
    "op9_substrings": rf"""
with t as (select doc_id, {_WORDS} as w from documents),
windows as (select doc_id, p, array_to_string(w[p : p + 49], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 49)) as p from t where len(w) >= 50)),
hit as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by g) as low from windows) where low < doc_id),
gone as (select doc_id, list_sort(list_distinct(flatten(list(generate_series(p, p + 49))))) as gone from hit group by doc_id),
word as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from t),
lost as (select doc_id, unnest(gone) as p from gone),
kept as (select doc_id, string_agg(x, ' ' order by p) as kept from word where not exists (select 1 from lost where lost.doc_id = word.doc_id and lost.p = word.p) group by doc_id)
select t.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from t left join gone on gone.doc_id = t.doc_id left join kept on kept.doc_id = t.doc_id""",
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of encoding every text and decoding the ids."""
    return bpe.round_trip(_read(spark, sf_dir, "documents"))


def op8_minhash_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.8 or more."""
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, percent=80)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removal of 50-word passages that an earlier document has, with a digest."""
    return substrings.digest(substrings.remove_repeated(_read(spark, sf_dir, "documents"), window=50))


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose vec_id is divisible by 20."""
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), top=20)


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every text."""
    return language_model.score_documents(_read(spark, sf_dir, "documents"))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"), capacity=1024, with_ids=False)


def op4_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of line-first cleaning for every text."""
    return cleaning.clean_lines(_read(spark, sf_dir, "documents")).select(*cleaning.BASE_COLUMNS)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from labels outside the fold held out."""
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every text."""
    return licences.digest(licences.scan(_read(spark, sf_dir, "documents")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned outside the fold held out."""
    return langid.identify(_read(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and counts of two tokenizers' tokens of every text."""
    return alignment.digest(_read(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts by form, and all spans."""
    return secrets.digest(secrets.scan(_read(spark, sf_dir, "documents")))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every damaged conversation."""
    return conversations.repair(conversations.damage(_read(spark, sf_dir, "conversations")))


def queries():
    every = (
        op1_cross_polytope, op2_deleted_interpolation, op3_harmonic_packing, op4_line_cleaning, op5_toxicity, op6_licences, op7_byte_bpe, op8_minhash_bottom_k,
        op9_substrings, op10_language, op11_alignment, op12_secrets, op13_conversations,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
