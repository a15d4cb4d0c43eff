"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lexgrove.llm.decontamination import OVERLAPS_SQL, benchmark_overlaps, op2_decontamination
from lexgrove.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from lexgrove.llm.mixing import OP8_SQL, op8_mixing
from lexgrove.llm.near_dedup import OP1_SQL, op1_minhash
from lexgrove.llm.pii import op7_pii
from lexgrove.llm.quality import op4_quality
from lexgrove.llm.shards import op10_sharding
from lexgrove.llm.substring_dedup import OP6_SQL, op6_suffix_array
from lexgrove.llm.tokens import op5_token_counts
from lexgrove.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_decontamination": op2_decontamination,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality": op4_quality,
    "op5_token_counts": op5_token_counts,
    "op6_suffix_array": op6_suffix_array,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_sharding": op10_sharding,
    "benchmark_overlaps": benchmark_overlaps,
}

#: The others have none: SQL can't express them, or only far too slowly. tests/llm holds them against brute force.
ORACLE_SQL = {"benchmark_overlaps": OVERLAPS_SQL, "op1_minhash": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op6_suffix_array": OP6_SQL, "op8_mixing": OP8_SQL}
