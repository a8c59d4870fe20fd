"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontaminate, divergence, embedding, minhash, mixing, oracles, quality, sharding, suffix, toxicity, trie, urlfilter
from tidemark.llm.common import table


def vocabulary() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        return f.read()


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_report(table(spark, sf_dir, "documents"), vocabulary())


def bpe_report(docs: DataFrame, spec: str) -> DataFrame:
    done = bpe.encode_and_check(docs.select("doc_id", "text"), spec)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), "decoded_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_url_filter": urlfilter.op3_url_filter,
    "op4_sharding": sharding.op4_sharding,
    "op5_minhash": minhash.op5_minhash,
    "op6_suffix_dedup": suffix.op6_suffix_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_embedding_neardup": embedding.op8_embedding_neardup,
    "op9_bpe": op9_bpe,
    "op10_quality": quality.op10_quality,
    "op11_divergence": divergence.op11_divergence,
    "op12_trie": trie.op12_trie,
    "op13_mixing": mixing.op13_mixing,
}

ORACLES: dict[str, str] = {"op1_decontamination": decontaminate.ORACLE, "op2_chat_formatting": chat.ORACLE, "op3_url_filter": urlfilter.ORACLE, "op5_minhash": oracles.MINHASH, "op6_suffix_dedup": oracles.SUFFIX, "op11_divergence": divergence.ORACLE, "op12_trie": trie.ORACLE, "op13_mixing": mixing.ORACLE}
