"""The operators' queries, and their SQL where there is one."""

from __future__ import annotations

from snapledger.llm import ann, bpe, htmltext, jaccard, langid, linededup, mixing, order_minhash, quality, toxicity

QUERIES = {
    "op1_language_id": langid.op1,
    "op2_jaccard_join": jaccard.op2,
    "op3_toxicity": toxicity.op3,
    "op4_line_dedup": linededup.op4,
    "op5_byte_bpe": bpe.op5,
    "op6_source_mixing": mixing.op6,
    "op7_order_minhash": order_minhash.op7,
    "op8_nearest_neighbours": ann.op8,
    "op9_html_text": htmltext.op9,
    "op10_quality": quality.op10,
}

SQL = {
    "op6_source_mixing": mixing.OP6_SQL,
}
