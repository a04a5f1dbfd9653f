"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from gaugeline.llm import chat, digest, embeddings, exact_dedup, line_dedup, mixing, near_dedup, pieces, pii, quality, runs, spelling, toxicity

_QUERIES = {
    "op1_near_dedup": (near_dedup.op1_near_dedup, None),
    "op2_digest": (digest.op2_digest, None),
    "op3_pii": (pii.op3_pii, None),
    "op4_toxicity": (toxicity.op4_toxicity, None),
    "op5_pieces": (pieces.op5_pieces, None),
    "op7_quality": (quality.op7_quality, None),
    "op6_chat_formatting": (chat.op6_chat, chat.OP6_SQL),
    "op8_line_dedup": (line_dedup.op8_line_dedup, None),
    "op9_exact_dedup": (exact_dedup.op9_exact_dedup, exact_dedup.OP9_SQL),
    "op10_mixing": (mixing.op10_mixing, mixing.OP10_SQL),
    "op11_spelling": (spelling.op11_spelling, None),
    "op12_embeddings": (embeddings.op12_embeddings, embeddings.OP12_SQL),
    "op13_runs": (runs.op13_runs, None),
}


def queries() -> dict:
    return {name: build for name, (build, _) in _QUERIES.items()}


def oracles() -> dict:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
