"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, neardup, packing, quality, reputation, secrets, toxicity, warc, wrappers

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_html_wrappers": wrappers.op2_html_wrappers,
    "op3_bpe": bpe.op3_bpe,
    "op4_minhash_near_dedup": neardup.op4_minhash_near_dedup,
    "op5_learned_partitions": ann.op5_learned_partitions,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_warc_revisits": warc.op7_warc_revisits,
    "op8_host_reputation": reputation.op8_host_reputation,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op10_packing": packing.op10_packing,
}
SQL: dict[str, str] = {
    "op7_warc_revisits": warc.SQL,
    "op8_host_reputation": reputation.SQL,
}
