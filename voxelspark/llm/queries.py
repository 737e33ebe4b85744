"""The registered queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.llm import centroids, chat, decontaminate, hamming, hard_negatives, jaccard, langid, line_dedup, packing, quality, token_blocks, url_lists, warc
from voxelspark.llm.shared import shared_dir

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def captures_and_entries(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures dated by page id, and a dated list drawn from their own hosts, domains and first path segments."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    captures = pages.select("page_id", "url", day(F.col("page_id") % 366).alias("fetched"))
    host = url_lists.host_of(F.col("url"))
    own = pages.select(host.alias("host"), F.regexp_extract(F.lower("url"), url_lists.SEGMENT, 1).alias("segment")).where("host <> ''")
    code = lambda c: F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("long")
    hosts = own.select(F.col("host").alias("pattern")).distinct().withColumn("code", code(F.col("pattern")))
    listed = hosts.where(F.col("code") % 3 == 0)
    parts = [listed.select("pattern", F.lit("add").alias("action"), day(F.col("code") % 200).alias("at")), listed.select("pattern", F.lit("remove").alias("action"), day(F.col("code") % 200 + 60).alias("at")), listed.where(F.col("code") % 2 == 0).select("pattern", F.lit("add").alias("action"), day(F.col("code") % 200 + 150).alias("at"))]
    domains = own.select(F.concat_ws(".", F.slice(F.split("host", r"\."), -2, 2)).alias("pattern")).where(F.size(F.split("pattern", r"\.")) == 2).distinct().withColumn("code", code(F.col("pattern")))
    parts += [domains.select("pattern", F.lit("add").alias("action"), day(F.lit(100) + F.col("code") % 50).alias("at")), domains.select("pattern", F.lit("remove").alias("action"), day(F.lit(160) + F.col("code") % 50).alias("at"))]
    prefixes = own.where("segment <> ''").select(F.concat_ws("/", "host", "segment").alias("pattern")).distinct().withColumn("code", code(F.col("pattern")))
    parts.append(prefixes.where(F.col("code") % 5 == 0).select("pattern", F.lit("add").alias("action"), day(F.col("code") % 300).alias("at")))
    entries = parts[0]
    for p in parts[1:]:
        entries = entries.unionByName(p)
    return captures, entries


def op2_url_list_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = captures_and_entries(_table(spark, sf_dir, "pages"))
    return url_lists.judge(captures, entries).withColumns({c: F.col(c).cast("string") for c in ("fetched", "listed_since")})


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digests(chat.render(chat.fold_events(chat.as_events(turns.unionByName(extra)))))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses_of_pages(_table(spark, sf_dir, "pages")))
    return records.withColumn("record_sha256", F.sha2(F.encode("record", "UTF-8"), 256)).drop("record", "http_headers")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    clean = line_dedup.dedup_lines(docs.select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines")))
    return clean.select("doc_id", F.when(F.col("text").isNotNull(), F.col("n_lines")).alias("n_lines"), "removed_lines", F.length("text").alias("kept_chars"), F.md5(F.encode("text", "UTF-8")).alias("kept_md5"))


def op7_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return hamming.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=10)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    models = langid.fit(docs.where(langid.crc_mod(F.col("doc_id"), 3) != 1))
    scored = langid.score(docs, models)
    return scored.select("doc_id", F.coalesce(langid.crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(langid.crc_mod(F.col("doc_id"), 5) != 0))
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(langid.crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed="3")


def op12_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_blocks.write(_table(spark, sf_dir, "documents"), tokenizer_path(), path, end_id=2)
    return token_blocks.read(spark, path).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_best_fit_packing, op2_url_list_asof, op3_chat_formatting, op4_warc_derivatives, op5_benchmark_decontamination, op6_line_dedup, op7_hamming_top_k, op8_language_id, op9_quality_classifier, op10_ngram_jaccard_join, op11_centroid_clustering, op12_token_blocks, op13_hard_negatives]
    return {f.__name__: f for f in found}
