"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm.common import load


def op5_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm import html_wrappers

    return html_wrappers.main_text(load(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm import quality

    led = quality.judge(quality.ledger(load(spark, sf_dir, "documents")))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm import pii

    return pii.replace(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvina.llm import bpe

    return bpe.encode_decode(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvina.llm import token_binary

    return token_binary.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvina.llm import token_counts

    return token_counts.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm import cap_filters

    return cap_filters.dedup(load(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm import toxicity

    docs = load(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvina.llm import packing

    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm import ngram_join

    return ngram_join.join(load(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm import whitening

    return whitening.whiten(load(spark, sf_dir, "embeddings"))


def op12_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm import impact_index

    return impact_index.top_k(load(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvina.llm import variants

    return variants.group_variants(load(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_bpe": op2_bpe,
        "op3_token_binary": op3_token_binary,
        "op4_token_counts": op4_token_counts,
        "op5_html_wrappers": op5_html_wrappers,
        "op6_quality_rules": op6_quality_rules,
        "op7_cap_filters": op7_cap_filters,
        "op8_toxicity": op8_toxicity,
        "op9_packing": op9_packing,
        "op10_ngram_join": op10_ngram_join,
        "op11_whitening": op11_whitening,
        "op12_impact_topk": op12_impact_topk,
        "op13_spelling_variants": op13_spelling_variants,
        "pipeline": pipeline,
    }


OP6_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (
    select doc_id, text,
        list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from d),
g as (
    select doc_id, i, words[i : i + 4] as win from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w)),
dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from g) where n > 1),
cover as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from dup) group by doc_id),
m as (
    select w.doc_id, len(words)::bigint as n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines,
        coalesce(cover.n, 0)::bigint as n_repeat_words,
        length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) as n_upper,
        length(text) - length(replace(text, '!', '')) as n_excl,
        len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) as n_echo
    from w left join cover using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not (base_failed or 10 * n_symbols > n_words or 10 * n_upper > 4 * word_chars or 10 * n_excl > 3 * n_words
         or 100 * n_echo > 20 * n_words or 2 * n_dup_lines > n_lines or word_chars > 20 * n_words) as kept
from b
"""

OP12_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda c: floor(64 * c::double)::bigint) as x
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (
    select q.vec_id as query_id, v.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * v.x[i]))::bigint as score
    from v as q join v on q.vec_id % 20 = 0 and v.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_quality_rules": OP6_SQL,
        "op12_impact_topk": OP12_SQL,
    }
