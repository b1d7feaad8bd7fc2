"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from cohort.llm.bpe import op5_bpe_chunk_reuse
from cohort.llm.decontaminate import OP7_SQL, op7_decontaminate_suffix_arrays
from cohort.llm.langid import op6_langid_kneser_ney
from cohort.llm.lexical import OP13_SQL, op13_lexical_ball_tree
from cohort.llm.neardup import OP4_SQL, op4_minhash_fast_similarity
from cohort.llm.neighbors import op10_ann_permutation_index
from cohort.llm.pii import op9_pii_anchor_expansion
from cohort.llm.prefixtrie import OP11_SQL, op11_prefix_double_arrays
from cohort.llm.quality import op3_quality_empirical_bayes
from cohort.llm.secrets import op1_secrets_randomness_battery
from cohort.llm.sharding import op12_balanced_label_propagation
from cohort.llm.spans import op8_substring_sentence_spans
from cohort.llm.toxicity import op2_toxicity_classifier_chain

QUERIES = {f.__name__: f for f in (
    op1_secrets_randomness_battery, op2_toxicity_classifier_chain, op3_quality_empirical_bayes, op4_minhash_fast_similarity, op5_bpe_chunk_reuse,
    op6_langid_kneser_ney, op7_decontaminate_suffix_arrays, op8_substring_sentence_spans, op9_pii_anchor_expansion, op10_ann_permutation_index,
    op11_prefix_double_arrays, op12_balanced_label_propagation, op13_lexical_ball_tree,
)}
ORACLES: dict[str, str] = {"op4_minhash_fast_similarity": OP4_SQL, "op7_decontaminate_suffix_arrays": OP7_SQL, "op11_prefix_double_arrays": OP11_SQL, "op13_lexical_ball_tree": OP13_SQL}
