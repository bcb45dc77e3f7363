"""The registry of the corpus queries and of the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import chat, collocations, hnsw, html_text, licenses, mixing, near_dups, packing, pii, quality, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_chat": chat.op2_chat,
        "op3_quality": quality.op3_quality,
        "op4_html": html_text.op4_html,
        "op5_mixing": mixing.op5_mixing,
        "op6_pii": pii.op6_pii,
        "op7_warc": warc.op7_warc,
        "op8_near_dups": near_dups.op8_near_dups,
        "op9_packing": packing.op9_packing,
        "op10_nearest": hnsw.op10_nearest,
        "op11_whitening": whitening.op11_whitening,
        "op12_licenses": licenses.op12_licenses,
        "op13_collocations": collocations.op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """The rest is beyond SQL and is tested against brute force, round trips and held-out labels."""
    return {"op7_warc": " ".join(warc.OP7_SQL.split()), "op13_collocations": collocations.OP13_SQL}
