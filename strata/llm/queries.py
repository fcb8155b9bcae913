"""The queries of this package, by name, and the SQL that states the same result where SQL can."""

from __future__ import annotations

from .ann import op9_additive_quantisation
from .binary import op4_bitplane_tokens
from .bpe import op6_transducer_bpe
from .packing import op3_pack_histogram
from .pii import op10_skip_chain_pii
from .quality import OP2_SQL, op2_line_frequency
from .secrets import op1_structural_secrets
from .simhash import op5_simhash_variants
from .substring import OP7_SQL, op7_count_min_substrings
from .toxicity import op8_clause_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_structural_secrets,
        op2_line_frequency,
        op3_pack_histogram,
        op4_bitplane_tokens,
        op5_simhash_variants,
        op6_transducer_bpe,
        op7_count_min_substrings,
        op8_clause_toxicity,
        op9_additive_quantisation,
        op10_skip_chain_pii,
    )
}
ORACLES = {"op2_line_frequency": OP2_SQL, "op7_count_min_substrings": OP7_SQL}
