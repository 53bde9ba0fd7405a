"""The training-data queries by name, and their SQL where SQL can state them.

Without SQL, and tested against brute force or held-out labels instead: op1 and op4
(positions of matches), op2 and op6 (trained models), op5 (XXH64), op10 (a sequential
packing), op11 (rounds of propagation).  The pipeline is registered beside them, by the
entry, from its own file.
"""

from __future__ import annotations

from .embedding_dedup import OP8_SQL, op8_embedding_dedup
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .fill_in_middle import OP13_SQL, op13_fill_in_middle
from .mixing import OP9_SQL, op9_source_mix
from .packing import op10_best_fit_packing
from .pii import op4_pii
from .quality import op6_quality
from .secret_scan import op1_secret_scan
from .sharding import op11_sharding
from .simhash_dedup import op5_simhash_dedup
from .substring_dedup import OP3_SQL, op3_substring_dedup
from .toxicity import op2_toxicity
from .vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_pii": op4_pii,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_source_mix": op9_source_mix,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_sharding": op11_sharding,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES = {
    "op3_substring_dedup": OP3_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_embedding_dedup": OP8_SQL,
    "op9_source_mix": OP9_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
