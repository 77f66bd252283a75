"""The operators over whole tables, by query name."""

from __future__ import annotations

from . import (best_fit, kd_shards, kn_langid, license_scan, order_minhash, pivot_search, position_index, preference_format, prefix_trie, rule_ledger, secret_cnn,
               source_divergence, url_trust)
from .common import read
from .sql import ORACLE as LLM_ORACLE  # noqa: F401

LLM_QUERIES = {
    "op1_url_trust": lambda spark, sf: url_trust.op1(read(spark, sf, "pages")),
    "op2_secret_cnn": lambda spark, sf: secret_cnn.op2(read(spark, sf, "documents")),
    "op3_order_minhash": lambda spark, sf: order_minhash.op3(read(spark, sf, "documents")),
    "op4_kd_shards": lambda spark, sf: kd_shards.op4(read(spark, sf, "documents")),
    "op5_rule_ledger": lambda spark, sf: rule_ledger.op5(read(spark, sf, "documents")),
    "op6_best_fit": lambda spark, sf: best_fit.op6(read(spark, sf, "documents")),
    "op7_license_scan": lambda spark, sf: license_scan.op7(read(spark, sf, "documents")),
    "op8_position_index": lambda spark, sf: position_index.op8(read(spark, sf, "documents"), read(spark, sf, "benchmark")),
    "op9_kn_langid": lambda spark, sf: kn_langid.op9(read(spark, sf, "documents")),
    "op10_preference_format": lambda spark, sf: preference_format.op10(read(spark, sf, "conversations")),
    "op11_source_divergence": lambda spark, sf: source_divergence.op11(read(spark, sf, "documents")),
    "op12_pivot_search": lambda spark, sf: pivot_search.op12(read(spark, sf, "embeddings")),
    "op13_prefix_trie": lambda spark, sf: prefix_trie.op13(read(spark, sf, "conversations")),
}
