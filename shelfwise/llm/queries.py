"""The registered queries of the subpackage and their SQL counterparts."""

from shelfwise.llm.decontaminate import op1_decontamination
from shelfwise.llm.divergence import ORACLE as DIVERGENCE_SQL
from shelfwise.llm.divergence import op11_source_divergence
from shelfwise.llm.exact_substrings import op5_suffix_array_dedup
from shelfwise.llm.langid import op2_language_id
from shelfwise.llm.lm import op3_lm_score
from shelfwise.llm.manifest import ORACLE as MANIFEST_SQL
from shelfwise.llm.manifest import op13_merkle_manifest
from shelfwise.llm.packing import op7_best_fit_packing
from shelfwise.llm.pii import op4_pii
from shelfwise.llm.quality import op8_quality_resampling
from shelfwise.llm.search import ORACLE as SEARCH_SQL
from shelfwise.llm.search import op10_topk_search
from shelfwise.llm.simhash import op9_simhash_near_dedup
from shelfwise.llm.toxicity import op6_toxicity
from shelfwise.llm.word_windows import ORACLE as WINDOWS_SQL
from shelfwise.llm.word_windows import op12_substring_dedup

QUERIES = {q.__name__: q for q in (
    op1_decontamination, op2_language_id, op3_lm_score, op4_pii, op5_suffix_array_dedup, op6_toxicity,
    op7_best_fit_packing, op8_quality_resampling, op9_simhash_near_dedup, op10_topk_search,
    op11_source_divergence, op12_substring_dedup, op13_merkle_manifest)}
ORACLE_SQL: dict[str, str] = {
    "op10_topk_search": SEARCH_SQL, "op11_source_divergence": DIVERGENCE_SQL, "op12_substring_dedup": WINDOWS_SQL,
    "op13_merkle_manifest": MANIFEST_SQL}
