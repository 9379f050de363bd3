"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import align, chat, decontam, langid, license, linededup, mixing, packing, pii, simhash, topk, toxicity
from recollect.llm.common import fold, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated to temperature-0.5 source shares, globally shuffled."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("shuffle_key")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items that share a passage, one row each."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tk")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after line dedup."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data; the session's ``spark.recollect.key`` is the secret."""
    return pii.replace_pii(table(spark, sf_dir, "documents"), spark.conf.get("spark.recollect.key", "a key for tests only")).select("doc_id", "text", "n_entities")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", predicted, "spans")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op9_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotes(table(spark, sf_dir, "conversations"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 1,024 tokens."""
    found = packing.pack(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups of tokens under two tokenizers, and how common its links are."""
    encoded = align.encode(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    found = align.score(encoded.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"))
    long = [F.col(c).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
    return found.select("doc_id", *long, "n_best", "count_sum", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_decontaminate": op2_decontaminate,
        "op3_exact_topk": op3_exact_topk,
        "op4_line_dedup": op4_line_dedup,
        "op5_surrogates": op5_surrogates,
        "op6_toxicity": op6_toxicity,
        "op7_simhash": op7_simhash,
        "op8_language": op8_language,
        "op9_quote_links": op9_quote_links,
        "op10_license_scan": op10_license_scan,
        "op11_pack": op11_pack,
        "op12_align": op12_align,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.MIX_SQL.format(docs="documents"),
        "op3_exact_topk": topk.TOPK_SQL,
        "op9_quote_links": chat.QUOTES_SQL.format(messages="conversations"),
    }
