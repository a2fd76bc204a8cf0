"""From raw documents to packed training sequences: five stages, each written to the shared folder and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm import decontaminate, jaccard, packing, pii, quality_qda
from spanframe.llm.common import bound_batches, stored
from spanframe.llm.queries import CAPACITY, END_ID, KEEP_AT, SURROGATE_KEY, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant accepts; learnt from the labelled ones among them, outside the held fold."""
    model = quality_qda.learn(docs, table(spark, sf_dir, "labels"), 4, 2)
    return quality_qda.score(docs, model, *docs.columns, name="__quality").where(F.col("__quality") >= KEEP_AT).drop("__quality")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies. Rows with a null id stay; rows that repeat an id share its fate."""
    bound_batches(spark)
    groups = jaccard.jaccard_components(docs, 5, 80)
    keep = stored(groups.where("doc_id = component_id").select("doc_id").distinct(), "distinct")
    # By sorted partitions at every size: the ids grow with the documents, so they are not broadcast where they happen to be few.
    named = docs.join(keep.hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data and secrets; n_chars follows the new text."""
    bound_batches(spark)
    out = pii.replaced(docs, SURROGATE_KEY)
    if "n_chars" in docs.columns:
        n = F.when(F.col("text").isNotNull() & F.col("n_chars").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of CAPACITY tokens."""
    bound_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END_ID)


STAGES = [
    ("quality_classifier", keep_quality), ("jaccard_join", keep_distinct), ("decontamination", drop_leaks), ("pii", replace_personal), ("best_fit_packing", pack_sequences),
]

#: Learnt scores, edit distances and a tokenizer's ids have no SQL; the tests run the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage but the last is stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
