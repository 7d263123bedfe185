"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from phmspark.llm import alignment, decontamination, divergence, html_text, language, minhash, ngram_join, packing, quality, token_counts, topk_search, toxicity, warc

QUERIES = {
    "op1_topk_search": topk_search.op1_topk_search,
    "op2_html_text": html_text.op2_html_text,
    "op3_language": language.op3_language,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_quality": quality.op6_quality,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_packing": packing.op9_packing,
    "op10_warc_fixity": warc.op10_warc_fixity,
    "op11_alignment": alignment.op11_alignment,
    "op12_minhash": minhash.op12_minhash,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLE_SQL = {
    "op1_topk_search": topk_search.OP1_SQL,
    "op8_decontamination": decontamination.OP8_SQL,
    "op10_warc_fixity": warc.OP10_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
