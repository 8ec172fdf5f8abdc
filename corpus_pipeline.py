"""A corpus pipeline of the text operators, each stage written as Parquet and read again as the next one's documents.

Toxicity and language identification drop the documents that they reject; line dedup shortens texts, and drops those that were copies whole; near-duplicate removal keeps the document with the least doc_id of each group; packing lays the rest out in training sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayloom.llm import langid, toxicity
from wayloom.llm.common import fresh, written
from wayloom.llm.linededup import dedup_lines
from wayloom.llm.minhash import near_duplicates
from wayloom.llm.packing import pack_documents, token_lengths


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with all columns but doc_id and text under names that no operator uses, and what leads back to docs' columns, changed where a function of that name is given."""
    own = {c: f"own_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}

    def back(out: DataFrame, **changed: Callable[[Column], Column]) -> DataFrame:
        return out.select(*[changed.get(c, lambda x: x)(F.col(own.get(c, c))).alias(c) for c in docs.columns])

    return docs.select(*[F.col(c).alias(own.get(c, c)) for c in docs.columns]), back


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5; the classifier is trained on labels of the documents at hand.

    Null and empty texts have the score of a text without a feature and stay where toxic rows are the fewer; long texts are scored whole; repeated rows share their fate; an empty table stays empty.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    apart, back = _apart(docs)
    return back(toxicity.score(apart, model).where("predicted = 0"))


def drop_foreign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text some language model of the corpus accepts.

    Null and empty texts and those without a letter go; long texts are scored whole; repeated rows share their fate; ties between languages do no harm, as any accepted one will do. Without a row to train on all go.
    """
    apart, back = _apart(docs)
    return back(langid.identify(apart, langid.train(docs)).where("not rejected"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents freed of passages that stand earlier in the corpus, n_chars with them; those that lose all their words go.

    Null and empty texts and rows with a null doc_id stay as they are; long texts are cut whole; rows that repeat a doc_id and text keep the same lines; an empty table stays empty.
    """
    apart, back = _apart(docs)
    cut = dedup_lines(apart)
    cut = cut.where(~((F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")))
    size = F.when(F.col("n_removed") > 0, F.length("text"))
    return back(cut, n_chars=lambda own: F.coalesce(size, own).cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), that with the least doc_id.

    Of rows that repeat a doc_id the one whose text's hash is least stays. Null and empty texts and texts without a word have no copies and stay; so do all rows with a null doc_id. Long texts are compared whole; an empty table stays empty.
    """
    kept_id, turn = fresh(docs.columns, "kept_id"), fresh(docs.columns, "turn")
    kept = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias(kept_id)).distinct()
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    named = docs.join(kept, F.col("doc_id") == F.col(kept_id)).withColumn(turn, F.row_number().over(once)).where(f"`{turn}` = 1").select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in training sequences, by its ids of a byte-level BPE tokenizer and one end id.

    One row for each piece. A null or empty text is its end id alone, a long one several pieces; repeated rows are each placed; an empty table gives no row.
    """
    return pack_documents(token_lengths(docs, public_tokenizers.path("byte_bpe_50k.json")), F.col("length"))


STAGES = [("toxicity", drop_toxic), ("language id", drop_foreign), ("line dedup", drop_lines), ("minhash near-dedup", drop_near_copies), ("best-fit packing", pack)]

#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
