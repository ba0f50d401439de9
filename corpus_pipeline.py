"""Cleans and packs a corpus: STAGES over documents, each on all that the one before kept.

toxicity: documents whose toxicity score reaches 0.5 go. exact_dedup: of equal texts the largest doc_id stays.
near_dedup: of each group linked by five-word shingles the smallest doc_id stays. decontaminate: documents that hold a
benchmark item go (an item of few words goes by them alone: one of a single word takes every document that holds it). pack: pieces of at most 2048 tokens in sequences. All stages but the last return the columns of
documents. Rows of a null doc_id can't be linked or labelled: near_dedup keeps them as they are.
A null or empty text is no reason to go but for exact_dedup, where they equal each other; repeated rows are copies. An
empty table passes through all stages and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.llm import decontaminate, exact, jaccard, packing, registry, toxicity
from rankloom.llm.common import WRITTEN, cut, forget, fresh, sweep, table


def drop_toxic(spark, docs, sf_dir):
    own = {c: "text" if c.lower() == "text" else f"_{c}" for c in docs.columns}  # a text goes to the workers and back once
    training = toxicity.training_rows(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items())), training)
    return scored.where(F.col("score") < 0.5).select(*(F.col(f"`{x}`").alias(c) for c, x in own.items()))


def drop_copies(spark, docs, sf_dir):
    nobody = F.lit(-(1 << 63))
    own, digest = fresh(docs, "own", "digest")
    keep = exact.distinct_texts(docs, keep="largest").select(F.coalesce("owner", nobody).alias(own), F.col("digest").alias(digest))
    named = docs.withColumns({own: F.coalesce("doc_id", nobody), digest: F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))})
    # the join already deals rows by both columns, so repeated rows of an owner meet without another exchange
    return named.join(keep.hint("merge"), [own, digest], "left_semi").dropDuplicates([own, digest]).select(*docs.columns)


def drop_near_copies(spark, docs, sf_dir):
    (later,) = fresh(docs, "later")
    classes = jaccard.near_duplicates(docs).where("doc_id != component_id").select(F.col("doc_id").alias(later))
    return docs.join(classes, F.col("doc_id") == F.col(later), "left_anti")


def drop_contaminated(spark, docs, sf_dir):
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    return packing.pack_documents(docs, registry.tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontaminate", drop_contaminated), ("pack", pack)]
#: Models and sequences are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows. Between stages only what the last one kept is left in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        mark, before = len(WRITTEN), docs
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            sweep(spark, mark, docs)
            forget(before)
    return docs
