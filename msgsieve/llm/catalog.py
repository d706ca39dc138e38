"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from msgsieve.llm import (
    decontamination, near_duplicates, preferences, resampling, sharding, substrings, url_rules,
)
from msgsieve.llm.alignment import op11_token_alignment
from msgsieve.llm.decontamination import op3_simhash_windows
from msgsieve.llm.factorization import op9_factorization_machine
from msgsieve.llm.near_duplicates import op10_odd_sketches
from msgsieve.llm.packing import op5_minimum_slack
from msgsieve.llm.preferences import op7_preference_pairs
from msgsieve.llm.pseudonyms import op1_feistel_pseudonyms
from msgsieve.llm.quality_rules import op6_weak_supervision
from msgsieve.llm.resampling import op12_importance_resampling
from msgsieve.llm.sharding import op4_byte_shards
from msgsieve.llm.substrings import op2_count_min_passages
from msgsieve.llm.toxicity import op8_levenshtein_lexicon
from msgsieve.llm.url_rules import op13_association_rules

QUERIES = {
    query.__name__: query
    for query in (
        op1_feistel_pseudonyms,
        op2_count_min_passages,
        op3_simhash_windows,
        op4_byte_shards,
        op5_minimum_slack,
        op6_weak_supervision,
        op7_preference_pairs,
        op8_levenshtein_lexicon,
        op9_factorization_machine,
        op10_odd_sketches,
        op11_token_alignment,
        op12_importance_resampling,
        op13_association_rules,
    )
}
SQL = {
    "op2_count_min_passages": substrings.SQL,
    "op3_simhash_windows": decontamination.SQL,
    "op4_byte_shards": sharding.SQL,
    "op7_preference_pairs": preferences.SQL,
    "op10_odd_sketches": near_duplicates.SQL,
    "op12_importance_resampling": resampling.SQL,
    "op13_association_rules": url_rules.SQL,
}
