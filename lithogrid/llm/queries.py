"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from lithogrid.llm import exact_dedup, hard_negatives, prefix_trie, setsketch
from lithogrid.llm.decontaminate import op1_decontaminate
from lithogrid.llm.exact_dedup import op5_exact_dedup
from lithogrid.llm.hard_negatives import op13_hard_negatives
from lithogrid.llm.html_extract import op8_html_extract
from lithogrid.llm.language_id import op10_language_id
from lithogrid.llm.license_scan import op3_license_scan
from lithogrid.llm.lm_score import op6_lm_score
from lithogrid.llm.packing import op2_packing
from lithogrid.llm.prefix_trie import op12_prefix_trie
from lithogrid.llm.setsketch import op11_setsketch_dedup
from lithogrid.llm.simhash import op9_simhash_dedup
from lithogrid.llm.token_files import op7_token_files
from lithogrid.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_packing": op2_packing,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_lm_score": op6_lm_score,
    "op7_token_files": op7_token_files,
    "op8_html_extract": op8_html_extract,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_language_id": op10_language_id,
    "op11_setsketch_dedup": op11_setsketch_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op11_setsketch_dedup": setsketch.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
