"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthbook.llm import conversation_repair, language_id, merkle, mpeg_audio, oracles, permutation_index, quality, toxicity, warc
from hearthbook.llm._store import Scratch
from hearthbook.llm.mixing import decide
from hearthbook.llm.near_dedup import near_duplicates
from hearthbook.llm.packing import pack
from hearthbook.llm.span_dedup import remove_repeats
from hearthbook.llm.url_filter import judge

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_mpeg_audio_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = Scratch(spark, "audio").keep("media", mpeg_audio.store(_table(spark, sf_dir, "documents")))
    found = mpeg_audio.inspect(media).withColumn("feature", mpeg_audio.feature())
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "sample_rate", "duration", "frame_offsets")


def op4_fair_queue_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = Scratch(spark, "warc").path("archives")
    warc.write_archives(pages, path)
    page = lambda c: F.expr(f"cast(nullif(regexp_extract({c}, 'page:(.*)>$', 1), '') as {pages.schema['page_id'].dataType.simpleString()})")
    again = F.col("record_type") == "revisit"
    full = F.regexp_extract("http", r"(?m)^Content-Length: (\d+)", 1).cast("long")
    return warc.read_archives(spark, path).select(
        page("record_id").alias("page_id"),
        F.when(again, full).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(again, F.col("digest")).otherwise(warc.base32_sha1(F.col("payload"))).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"),
    )


def op6_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = permutation_index.usable(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return permutation_index.search(vectors, vectors.where("id % 20 = 0"))


def _fold(of: int, held: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == held, F.lit(False))


def op8_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.where(~_fold(4, 2)), labels.where(~_fold(4, 2)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", _fold(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~_fold(5, 0) & F.col("doc_id").isNotNull()))  # a null id has no CRC
    called = language_id.predict(docs.select("doc_id", "text"), model)
    return called.select("doc_id", _fold(5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as vocabulary:
        return pack(_table(spark, sf_dir, "documents"), vocabulary.read())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    found = conversation_repair.repair(conversation_repair.damage(rows)).withColumnRenamed("conv_id", "of")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    joined = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return joined.select("conv_id", *(F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns if c != "of"))


def op12_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks", "verdict")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.documents_manifest(_table(spark, sf_dir, "documents"))
    folded = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_sentence_span_dedup": op2_sentence_span_dedup,
    "op3_mpeg_audio_media": op3_mpeg_audio_media,
    "op4_fair_queue_mixing": op4_fair_queue_mixing,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_redirect_url_filter": op6_redirect_url_filter,
    "op7_permutation_index": op7_permutation_index,
    "op8_nnpu_toxicity": op8_nnpu_toxicity,
    "op9_ecoc_language_id": op9_ecoc_language_id,
    "op10_dp_packing": op10_dp_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_compression_bands": op12_compression_bands,
    "op13_merkle_manifest": op13_merkle_manifest,
}
#: The others have none: trained models, token ids, audio frames, zstandard ratios and an approximate index are not SQL, and substring spans hash runs of sentences; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": oracles.NEAR_DEDUP,
    "op4_fair_queue_mixing": oracles.MIXING,
    "op5_warc_revisits": oracles.REVISITS,
    "op6_redirect_url_filter": oracles.url_filter(URL_RULES),
    "op11_conversation_repair": oracles.REPAIR,
    "op13_merkle_manifest": oracles.MERKLE,
}
