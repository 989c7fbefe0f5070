"""The queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from .fixity import OP1_SQL, op1_merkle_fixity
from .language import op8_rank_order_language
from .maxent import op7_hashed_maxent
from .maxscore import OP6_SQL, op6_maxscore_top_k
from .packing import op9_best_fit_packing
from .privacy import op2_information_sanitise
from .quality import op5_quality_rules
from .simhash import op4_covering_simhash
from .substring import op3_block_anchor_dedup
from .tokens import op10_bpe_codec

QUERIES = {
    f.__name__: f
    for f in (
        op1_merkle_fixity,
        op2_information_sanitise,
        op3_block_anchor_dedup,
        op4_covering_simhash,
        op5_quality_rules,
        op6_maxscore_top_k,
        op7_hashed_maxent,
        op8_rank_order_language,
        op9_best_fit_packing,
        op10_bpe_codec,
    )
}
#: The others are not expressible in SQL and are tested against brute force in tests/llm.
SQL = {"op1_merkle_fixity": OP1_SQL, "op6_maxscore_top_k": OP6_SQL}
