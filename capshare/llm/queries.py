"""The registered query of each operator, over its whole table."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import code_compression, decontamination, jaccard_join, line_dedup, mixing, packing, quality, sharding, suffix_dedup, topk, toxicity, turn_trie, warc
from .common import settle, shared_path, table
from .registry import ORACLE, QUERIES, query
from .sql import LINES_SQL, QUALITY_SQL, TOPK_SQL, WARC_SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


@query("op2_topk_search", TOPK_SQL)
def op2_topk_search(spark, sf):
    vectors = settle(topk.quantised(table(spark, sf, "embeddings")), "vectors")
    return topk.search(vectors.where("id % 20 = 0"), vectors, k=20)


@query("op3_line_dedup", LINES_SQL)
def op3_line_dedup(spark, sf):
    out = line_dedup.dedup_lines(table(spark, sf, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query("op4_mixing", mixing.SQL)
def op4_mixing(spark, sf):
    out = mixing.mix(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


@query("op7_sharding")
def op7_sharding(spark, sf):
    out = sharding.shard(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_quality", QUALITY_SQL)
def op8_quality(spark, sf):
    return quality.judge(table(spark, sf, "documents")).drop("uid", "lang").withColumnRenamed("id", "doc_id")


@query("op10_warc_revisits", WARC_SQL)
def op10_warc_revisits(spark, sf):
    raw, deduped = shared_path(spark, "warc-raw"), shared_path(spark, "warc")
    warc.write_archive(table(spark, sf, "pages"), raw)
    warc.deduplicate(spark, raw, deduped)
    return warc.read_archive(spark, deduped).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to_page").alias("refers_to"))


@query("op5_packing")
def op5_packing(spark, sf):
    import public_tokenizers
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_toxicity")
def op1_toxicity(spark, sf):
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % 5
    out = toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"), fold(F.col("doc_id")) != 0)
    doc_id = F.col("id").cast("long")
    return out.select(doc_id.alias("doc_id"), F.coalesce(fold(doc_id) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query("op9_ngram_jaccard_join")
def op9_ngram_jaccard_join(spark, sf):
    out = jaccard_join.join(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_text_links", "text_id")


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf):
    out = suffix_dedup.dedup(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_prefix_trie", turn_trie.SQL)
def op11_prefix_trie(spark, sf):
    turns = table(spark, sf, "conversations")
    return turn_trie.trie(turn_trie.grafted(turn_trie.sequences(turns, F.col("conv_id") - F.col("conv_id") % 20), F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4))


@query("op12_vector_codes", code_compression.SQL)
def op12_vector_codes(spark, sf):
    return code_compression.compress(table(spark, sf, "embeddings"))


@query("op13_decontamination", decontamination.SQL)
def op13_decontamination(spark, sf):
    out = decontamination.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
