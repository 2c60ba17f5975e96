"""Queries of this subpackage and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from sluice.llm import bpe, decontaminate, line_dedup, near_dedup, quality, secrets, sharding, token_store, topk, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_quality": quality.op2_quality,
    "op3_secrets": secrets.op3_secrets,
    "op4_token_store": token_store.op4_token_store,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_topk": topk.op10_topk,
}
ORACLES: dict[str, str] = {"op6_near_dedup": near_dedup.OP6_SQL, "op8_line_dedup": line_dedup.OP8_SQL, "op10_topk": topk.OP10_SQL}
