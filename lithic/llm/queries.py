"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from lithic.llm import licences, oracles, topk
from lithic.llm.conversations import op11_conversation_trie
from lithic.llm.decontaminate import op1_decontamination
from lithic.llm.licences import op7_licence_scan
from lithic.llm.lmscore import op13_language_model
from lithic.llm.manifest import op12_merkle_manifest
from lithic.llm.maintext import op5_html_extraction
from lithic.llm.passages import op8_passage_dedup
from lithic.llm.quality import op2_quality_classifier
from lithic.llm.sentencepieces import op4_sentencepiece
from lithic.llm.simhash import op9_simhash_near_dedup
from lithic.llm.substrings import op3_substring_suffix_dedup
from lithic.llm.topk import op6_exact_topk
from lithic.llm.urlrank import op10_url_filter

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_substring_suffix_dedup": op3_substring_suffix_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_html_extraction": op5_html_extraction,
    "op6_exact_topk": op6_exact_topk,
    "op7_licence_scan": op7_licence_scan,
    "op8_passage_dedup": op8_passage_dedup,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_language_model": op13_language_model,
}

ORACLE_SQL: dict[str, str] = {"op6_exact_topk": topk.ORACLE, "op7_licence_scan": licences.ORACLE, "op11_conversation_trie": oracles.TRIE, "op12_merkle_manifest": oracles.MERKLE}
