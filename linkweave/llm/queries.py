"""The registered training-data queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.llm import conversations, langid, licenses, lm_scoring, merkle, mixing, ngram_join, oracles, packing, sharding, spotsigs, toxicity, trie_dedup, url_filter
from linkweave.llm.common import table
from linkweave.llm.registry import ORACLES, QUERIES, register

__all__ = ["ORACLES", "QUERIES"]

_SAME = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(
    "op3_exact_dedup",
    f"""WITH t AS (SELECT doc_id, sha256({_SAME}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)""",
)
def op3_exact_dedup(spark, sf_dir):
    return trie_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


@register("op5_source_mix", mixing.MIX_SQL)
def op5_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op8_hash_tree_shards")
def op8_hash_tree_shards(spark, sf_dir):
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@register("op4_language_id")
def op4_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@register("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


@register("op6_harmonic_packing")
def op6_harmonic_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@register("op9_spot_signatures")
def op9_spot_signatures(spark, sf_dir):
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


@register("op10_url_filter")
def op10_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), whole_url=True)


@register("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op7_license_scan")
def op7_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@register("op11_backoff_automaton", oracles.LM_SQL)
def op11_backoff_automaton(spark, sf_dir):
    return lm_scoring.score(table(spark, sf_dir, "documents"))


@register("op12_merkle_manifest", oracles.MERKLE_SQL)
def op12_merkle_manifest(spark, sf_dir):
    proved = merkle.prove(table(spark, sf_dir, "documents"))
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@register("op13_conversation_repair", oracles.REPAIR_SQL)
def op13_conversation_repair(spark, sf_dir):
    return conversations.repair(table(spark, sf_dir, "conversations"))
