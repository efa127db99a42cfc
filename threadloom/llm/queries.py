"""The queries of the operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, jaccard, langid, media, packing, quality, toxicity, urlfilter, warc
from .common import held_out

#: Rules of op6: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the tokenizer's file is; the same path on the driver and the executors."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_records(warc.write_archive(table(spark, sf_dir, "pages")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.digests(table(spark, sf_dir, "documents"), tokenizer_path()))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = decontam.scanner(table(spark, sf_dir, "benchmark"))
    return decontam.report(decontam.scan(table(spark, sf_dir, "documents"), items))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = urlfilter.build_index(spark.createDataFrame(URL_RULES, urlfilter.RULES))
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), index)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "sentence")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.sort_turns(table(spark, sf_dir, "conversations"))
    found = chat.recover(turns, chat.fit(turns))
    return found.select("conv_id", "turn", held_out(F.col("conv_id")).alias("held_out"), "role_pred", F.length("rendered").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.media_columns(table(spark, sf_dir, "documents")))


OP6_SQL = r"""
WITH rules(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS row_no
  FROM pages),
won AS (
  SELECT row_no, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY row_no)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM parts LEFT JOIN won USING (row_no)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_warc": op2_warc,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_decontaminate": op5_decontaminate,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity": op7_toxicity,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_quality": op9_quality,
    "op10_media": op10_media,
}

ORACLES: dict[str, str] = {"op6_url_filter": OP6_SQL}
