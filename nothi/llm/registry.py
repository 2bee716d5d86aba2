"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from nothi.llm.op1_token_files import op1_token_files
from nothi.llm.op2_warc_revisit import SQL as WARC_SQL
from nothi.llm.op2_warc_revisit import op2_warc_revisit
from nothi.llm.op3_mixing import SQL as MIXING_SQL
from nothi.llm.op3_mixing import op3_mixing
from nothi.llm.op4_simhash import op4_simhash
from nothi.llm.op5_threshold_topk import SQL as TOPK_SQL
from nothi.llm.op5_threshold_topk import op5_threshold_topk
from nothi.llm.op6_packing import op6_packing
from nothi.llm.op7_toxicity import op7_toxicity
from nothi.llm.op8_html_mincut import op8_html_mincut
from nothi.llm.op9_hnsw import op9_hnsw
from nothi.llm.op10_hilbert_sharding import op10_hilbert_sharding
from nothi.llm.op11_bpe_prefixes import op11_bpe_prefixes
from nothi.llm.op12_periodic_runs import op12_periodic_runs
from nothi.llm.op13_ball_tree_clusters import SQL as CLUSTERS_SQL
from nothi.llm.op13_ball_tree_clusters import op13_ball_tree_clusters

QUERIES = (op1_token_files, op2_warc_revisit, op3_mixing, op4_simhash, op5_threshold_topk, op6_packing, op7_toxicity, op8_html_mincut, op9_hnsw, op10_hilbert_sharding, op11_bpe_prefixes, op12_periodic_runs, op13_ball_tree_clusters)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"op2_warc_revisit": WARC_SQL, "op3_mixing": MIXING_SQL, "op5_threshold_topk": TOPK_SQL, "op13_ball_tree_clusters": CLUSTERS_SQL}
