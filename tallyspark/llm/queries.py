"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from .balls import OP13_SQL, op13_ball_clusters
from .bytebpe import op11_byte_bpe
from .fim import OP12_SQL, op12_fill_in_middle
from .hnsw import OP4_SQL, op4_embedding_near_dedup
from .lines import op1_line_dedup
from .mixing import op10_mix_sources
from .packing import op8_best_fit_packing
from .qda import op7_quality_classifier
from .quality import OP5_SQL, op5_quality_rules
from .simhash import op3_simhash_near_dedup
from .tokens import op9_token_counts
from .toxicity import op6_toxicity
from .urls import OP2_SQL, op2_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_url_filters, op3_simhash_near_dedup, op4_embedding_near_dedup, op5_quality_rules,
        op6_toxicity, op7_quality_classifier, op8_best_fit_packing, op9_token_counts, op10_mix_sources,
        op11_byte_bpe, op12_fill_in_middle, op13_ball_clusters,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_url_filters": OP2_SQL, "op4_embedding_near_dedup": OP4_SQL, "op5_quality_rules": OP5_SQL, "op12_fill_in_middle": OP12_SQL, "op13_ball_clusters": OP13_SQL}
