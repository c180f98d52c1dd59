"""A corpus from raw documents to token digests, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents, other columns of the input included, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juncture.llm import bpe, exact_dedup, language, mixing, simhash
from juncture.llm.common import fold, scratch_table
from juncture.llm.plans import tokenizer


def with_own_columns(docs: DataFrame, made: list[str], operate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operate`` on docs, then the columns of docs alone; those named as one of the results step aside meanwhile."""
    aside = {c: f"_own_{c}" for c in docs.columns if c in made}
    out = operate(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the network finds no language go, as do null texts and those without a letter."""
    model = language.fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    return with_own_columns(docs, ["_lang_pred", "_score"], lambda d: language.predict(d, model, lang_col="_lang_pred", score_col="_score").filter(language.in_a_language(model, score_col="_score")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that of the largest doc_id."""
    return with_own_columns(docs, ["text_sha256", "keep_id", "group_size", "kept"], lambda d: exact_dedup.mark_duplicates(d).filter("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document goes, stays or comes up to three times."""
    return with_own_columns(docs, ["size", "source_size", "target", "copies", "taken"], lambda d: mixing.emit_copies(mixing.mix(d)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the bytes that they decode to."""
    return bpe.token_digests(docs.select("doc_id", "text"), *tokenizer())


STAGES = [("language ID", language_id), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies), ("mixing sources", mixture), ("byte-level BPE", tokens)]

#: SQL can express neither the trained network nor XXH64 nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch_table(docs, f"pipeline-{i}")
    return docs
