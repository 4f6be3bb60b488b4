"""The registered queries of the training-data operators."""

from wakeline.llm import hard_negatives, jaccard, topk
from wakeline.llm.counts import op7_token_counts
from wakeline.llm.decontaminate import op5_decontaminate
from wakeline.llm.hard_negatives import op13_hard_negatives
from wakeline.llm.html import op6_html_text
from wakeline.llm.huffman import op1_huffman_ids
from wakeline.llm.jaccard import op11_jaccard_join
from wakeline.llm.packing import op3_vector_packing
from wakeline.llm.periodic import op12_periodic_runs
from wakeline.llm.pii import op8_pii
from wakeline.llm.secrets import op4_secret_scan
from wakeline.llm.simhash import op2_simhash
from wakeline.llm.topk import op10_topk_nra
from wakeline.llm.toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_huffman_ids, op2_simhash, op3_vector_packing, op4_secret_scan, op5_decontaminate, op6_html_text, op7_token_counts, op8_pii, op9_toxicity, op10_topk_nra, op11_jaccard_join, op12_periodic_runs, op13_hard_negatives)}
ORACLES: dict[str, str] = {"op10_topk_nra": topk.ORACLE, "op11_jaccard_join": jaccard.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
