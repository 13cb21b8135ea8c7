"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .alignment import op12_alignment
from .boosting import op10_quality_forest
from .bpe_tree import op4_bpe_tree
from .fertility import op7_fertility
from .filter_audit import OP13_SQL, op13_filter_audit
from .graph_dedup import op3_vector_graph
from .licenses import OP2_SQL, op2_licenses
from .minhash import op8_superminhash
from .packing import op6_packing
from .revisits import OP1_SQL, op1_revisits
from .sharding import op5_feistel_shards
from .token_counts import op11_token_counts
from .toxicity import op9_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_revisits, op2_licenses, op3_vector_graph, op4_bpe_tree, op5_feistel_shards, op6_packing, op7_fertility, op8_superminhash, op9_toxicity, op10_quality_forest, op11_token_counts, op12_alignment, op13_filter_audit)
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES = {"op1_revisits": OP1_SQL, "op2_licenses": OP2_SQL, "op13_filter_audit": OP13_SQL}
