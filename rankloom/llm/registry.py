"""The subpackage's queries, named opN_<name>, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontaminate, exact, importance, jaccard, language, manifest, packing, passages, suffixes, tokencount, toxicity, urlfilter
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark, sf_dir):
    return passages.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op4_url_filter(spark, sf_dir):
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op5_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark, sf_dir):
    return suffixes.suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


#: Both turns of the extra conversation say this.
TRICKY = "\\### Assistant: </turn> ok"


def op10_chat_format(spark, sf_dir):
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_conversations(rows))


def op11_merkle_manifest(spark, sf_dir):
    return manifest.manifest_digest(table(spark, sf_dir, "documents"))


def op12_token_counts(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE3 = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, coalesce(doc_id = max(doc_id) over g, false) as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))"""

ORACLE10 = r"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, regexp_replace(text, '\\|###|</turn>', '\\\0', 'g') as esc, replace(regexp_replace(role, '\\|###|</turn>', '\\\0', 'g'), ':', '\:') as erole from r)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(erole) + length(esc) + 14)::bigint as formatted_chars, false as rewritten
from e group by conv_id"""


def queries():
    return {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_exact_dedup, op4_url_filter, op5_jaccard_join, op6_toxicity, op7_decontamination, op8_suffix_dedup, op9_best_fit_packing, op10_chat_format, op11_merkle_manifest, op12_token_counts, op13_importance_resampling)}


def oracle_sql():
    return {"op3_exact_dedup": ORACLE3, "op4_url_filter": urlfilter.oracle(), "op10_chat_format": ORACLE10, "op11_merkle_manifest": manifest.oracle(), "op13_importance_resampling": importance.oracle()}
