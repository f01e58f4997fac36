"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from mensura.llm.ann_search import op10_ann_search
from mensura.llm.centroid_clustering import op11_centroid_clustering, op11_sql
from mensura.llm.chat_format import OP7_SQL, op7_chat_format
from mensura.llm.conversation_repair import op12_conversation_repair, op12_sql
from mensura.llm.exact_search import OP5_SQL, op5_exact_search
from mensura.llm.language_id import op9_language_id
from mensura.llm.mixing import op1_mixing
from mensura.llm.packing import op8_packing
from mensura.llm.phrase_fingerprint import op13_phrase_fingerprint
from mensura.llm.pii import op2_pii
from mensura.llm.shingle_join import op3_ngram_jaccard_join
from mensura.llm.substring_dedup import op6_substring_dedup
from mensura.llm.url_filter import op4_sql, op4_url_filter

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_pii": op2_pii,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_url_filter": op4_url_filter,
    "op5_exact_search": op5_exact_search,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_ann_search": op10_ann_search,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_phrase_fingerprint": op13_phrase_fingerprint,
}


def sql() -> dict[str, str]:
    return {"op4_url_filter": op4_sql(), "op5_exact_search": OP5_SQL, "op7_chat_format": OP7_SQL, "op11_centroid_clustering": op11_sql(), "op12_conversation_repair": op12_sql()}
