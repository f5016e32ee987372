"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, html_extraction, language_id, minhash, mixing, sentencepiece_codec, token_counts, toxicity, url_filter

QUERIES = {
    "op1_language_id": language_id.op1,
    "op2_url_filter": url_filter.op2,
    "op3_token_counts": token_counts.op3,
    "op4_toxicity": toxicity.op4,
    "op5_mixing": mixing.op5,
    "op6_embedding_dedup": embedding_dedup.op6,
    "op7_sentencepiece": sentencepiece_codec.op7,
    "op8_exact_dedup": exact_dedup.op8,
    "op9_minhash": minhash.op9,
    "op10_html_extraction": html_extraction.op10,
}
SQL = {"op5_mixing": mixing.OP5_SQL, "op6_embedding_dedup": embedding_dedup.OP6_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL}
