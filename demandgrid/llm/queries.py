"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from demandgrid.llm.backoff_lm import OP11_SQL, op11_lm_scores
from demandgrid.llm.bpe import op5_bpe
from demandgrid.llm.embedding_dedup import op8_embedding_dedup
from demandgrid.llm.langid import op2_language_id
from demandgrid.llm.mixing import OP10_SQL, op10_mixing
from demandgrid.llm.near_dedup import OP4_SQL, op4_near_dedup
from demandgrid.llm.neighbours import OP7_SQL, op7_nearest
from demandgrid.llm.periodic_runs import op13_periodic_runs
from demandgrid.llm.pii import op9_pii
from demandgrid.llm.quality import op6_quality
from demandgrid.llm.resampling import OP12_SQL, op12_importance_resampling
from demandgrid.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from demandgrid.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_nearest": op7_nearest,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_pii": op9_pii,
    "op10_mixing": op10_mixing,
    "op11_lm_scores": op11_lm_scores,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {
    "op1_warc": OP1_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_near_dedup": OP4_SQL,
    "op7_nearest": OP7_SQL,
    "op10_mixing": OP10_SQL,
    "op11_lm_scores": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
}
