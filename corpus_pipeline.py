"""A cleaning pipeline of five operators over documents. Each stage's rows are written before the next one reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontam, jaccard, langid, packing, toxicity
from threadloom.llm.common import with_text_filter, write_table
from threadloom.llm.queries import table, tokenizer_path

#: The least share of a text's letters that its language holds.
LEAST_SHARE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; null and empty texts are not toxic. Columns and repeated rows stay."""
    score = toxicity.scorer(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return with_text_filter(docs, "text", lambda text: score(text) < toxicity.THRESHOLD)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents one learned language of which holds most letters; texts without letters, and null ones, go. Columns and repeated rows stay."""
    sure = langid.sure(docs, langid.fit(docs), LEAST_SHARE)
    return with_text_filter(docs, "text", lambda text: sure(text))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the least id. Repeated rows, and null ids with equal texts, go too; documents without words all stay."""
    return jaccard.representatives(docs)


def clean_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: those that are mostly passages go, of others the passages are cut and n_chars follows."""
    cleaned = decontam.clean(docs, decontam.scanner(table(spark, sf_dir, "benchmark")))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if cleaned.columns.count("n_chars") == 1 else cleaned


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences: a null text is an empty one, so the end token alone; null ids and repeated rows are packed each on its own, and of equal pieces any comes first; an empty table has no sequences."""
    return packing.pack(packing.digests(docs, tokenizer_path()))


STAGES = [("toxicity", drop_toxic), ("language_id", keep_languages), ("ngram_jaccard", one_of_each), ("decontamination", clean_benchmark), ("best_fit_packing", pack)]

#: SQL cannot express these stages; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs, name)
    return docs
