"""The numbered queries of this subpackage, and SQL twins of those that SQL can express."""

from __future__ import annotations

from . import (
    decontaminate,
    exact_dedup,
    html_text,
    kd_search,
    language_id,
    mixing,
    ngram_join,
    phrases,
    quality,
    substring_dedup,
    token_alignment,
    token_store,
    warc,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_html_extract": html_text.op2_html_extract,
    "op3_warc_salvage": warc.op3_warc_salvage,
    "op4_ngram_jaccard": ngram_join.op4_ngram_jaccard,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_quality": quality.op6_quality,
    "op7_langid": language_id.op7_langid,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_token_store": token_store.op9_token_store,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_phrases": phrases.op11_phrases,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_kd_search": kd_search.op13_kd_search,
}

ORACLE = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op3_warc_salvage": warc.ORACLE,
    "op4_ngram_jaccard": ngram_join.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_phrases": phrases.ORACLE,
    "op13_kd_search": kd_search.ORACLE,
}
