"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import ORACLE_OP8, op8_decontaminate
from .hard_negatives import ORACLE_OP11, op11_hard_negatives
from .language import op9_language
from .link_graph import ORACLE_OP3, op3_link_graph
from .merkle import op5_merkle
from .minhash import ORACLE_OP10, op10_minhash
from .packing import op6_best_fit
from .periodic_runs import op13_periodic_runs
from .quality import op2_quality
from .secret_scan import op7_secrets
from .suffix_dedup import op4_suffix_dedup
from .token_store import op1_repair_tokens
from .toxicity import op12_toxicity

QUERIES = {
    "op1_repair_tokens": op1_repair_tokens,
    "op2_quality": op2_quality,
    "op3_link_graph": op3_link_graph,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_merkle": op5_merkle,
    "op6_best_fit": op6_best_fit,
    "op7_secrets": op7_secrets,
    "op8_decontaminate": op8_decontaminate,
    "op9_language": op9_language,
    "op10_minhash": op10_minhash,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_toxicity": op12_toxicity,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE = {
    "op3_link_graph": ORACLE_OP3,
    "op8_decontaminate": ORACLE_OP8,
    "op10_minhash": ORACLE_OP10,
    "op11_hard_negatives": ORACLE_OP11,
}
