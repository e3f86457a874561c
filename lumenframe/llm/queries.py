"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from .jaccard import op7_divide_skip
from .matroska import op9_matroska
from .mixing import OP4_SQL, op4_poisson_mix
from .neighbours import op10_hash_prefix_forest
from .packing import op2_bin_completion
from .quality import op1_bradley_terry
from .sharding import op8_two_pass_shuffle
from .suffixes import op6_suffix_array
from .toxicity import op3_kneser_ney
from .urls import op5_association_rules

QUERIES = {f.__name__: f for f in (op1_bradley_terry, op2_bin_completion, op3_kneser_ney, op4_poisson_mix, op5_association_rules, op6_suffix_array, op7_divide_skip, op8_two_pass_shuffle, op9_matroska, op10_hash_prefix_forest)}
ORACLES = {"op4_poisson_mix": OP4_SQL}
