"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from taxolith.llm import divergence, prefix_trie
from taxolith.llm.bpe import op1_token_counts
from taxolith.llm.decontamination import op6_decontamination
from taxolith.llm.divergence import op12_source_divergence
from taxolith.llm.fingerprints import op2_fingerprints
from taxolith.llm.html_text import op3_html_text
from taxolith.llm.language import op7_language
from taxolith.llm.near_duplicates import op9_near_duplicates
from taxolith.llm.packing import op8_packing
from taxolith.llm.prefix_trie import op13_prefix_trie
from taxolith.llm.quality import op11_quality
from taxolith.llm.repeats import op5_repeats
from taxolith.llm.secrets import op4_secrets
from taxolith.llm.toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_fingerprints, op3_html_text, op4_secrets, op5_repeats, op6_decontamination, op7_language, op8_packing, op9_near_duplicates, op10_toxicity, op11_quality, op12_source_divergence, op13_prefix_trie)}

ORACLES: dict[str, str] = {"op12_source_divergence": divergence.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
