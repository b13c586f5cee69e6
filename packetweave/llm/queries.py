"""Registered queries: each operator over its whole table, with the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetweave.llm import decontamination, extraction, langid, merkle, mixing, pii, quality, secrets, simhash, suffix_dedup, topk, trie, warc
from packetweave.llm.spans import labels
from packetweave.storage import materialize, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.document_languages(_table(spark, sf_dir, "documents"))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.page_languages(_table(spark, sf_dir, "pages"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark, _table(spark, sf_dir, "documents"))


def op7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = secrets.scan_history(_table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda s: s["kind"].isin(*secrets.BASE))
    return findings.select(
        "doc_id", *(_count(F.col("findings"), k) for k in secrets.BASE),
        F.sha2(labels(base), 256).alias("base_sha256"), labels(F.col("findings")).alias("spans"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc-archive")
    warc.write_warc(_table(spark, sf_dir, "pages"), folder)
    return warc.page_records(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id", *(_count(F.col("pii"), k) for k in pii.BASE),
        F.sha2(labels(base), 256).alias("base_sha256"), labels(F.col("pii")).alias("spans"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = quality.quality(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(_table(spark, sf_dir, "documents"), merkle.without_breaks)


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, members = trie.prefix_trie(trie.rebuilt(_table(spark, sf_dir, "conversations")))
    nodes = trie.with_end_digests(materialize(nodes, "trie-nodes"), members)
    return nodes.select(
        F.col("first").alias("conv_id"), "depth", F.col("parent_first").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), "ends_sha256")


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_language": op1_language, "op2_mix": op2_mix, "op3_topk": op3_topk, "op4_decontamination": op4_decontamination, "op5_simhash": op5_simhash, "op6_repeats": op6_repeats, "op7_text": op7_text, "op8_secrets": op8_secrets, "op9_warc": op9_warc, "op10_pii": op10_pii,
            "op11_quality": op11_quality, "op12_merkle": op12_merkle, "op13_prefixes": op13_prefixes,
            "page_language": page_language}
