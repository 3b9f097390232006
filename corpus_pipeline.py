"""A corpus pipeline of five stages over ``documents``: each takes (spark, docs, sf_dir), its result is written as Parquet and read as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import _common as C


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or no letter) go; a null lang is filled with the prediction. Rows that repeat are each kept; no rows give no rows."""
    from quire.llm.langid import with_language

    C.tune(spark)
    return with_language(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays (a null doc_id loses), of rows that repeat doc_id and text one."""
    from quire.llm.exact_dedup import drop_duplicates

    return drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts (five-word shingles, Jaccard similarity of 0.8 and more) stays, that with the smallest doc_id. Rows without a doc_id all stay."""
    from quire.llm import near_copies

    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, copies as rows that repeat; a null source is a source, texts without words are taken as often as their source's whole rate says."""
    from quire.llm.mixing import take

    return take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 4096 ids; a null or empty text is its end id. No rows give no rows."""
    from quire.llm.packing import pack_documents
    from quire.llm.queries import tokenizer_path

    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", identify_language), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL can't express cross-parsing, pivotal rounding or byte-pair encoding; tests hold the operators of the stages, and the whole chain, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each returns is written to the shared folder and read again."""
    docs = C.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = C.materialize(docs, name)
    return docs
