"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from keyedit.llm.chunk_bpe import op12_bpe
from keyedit.llm.collocations import OP13_SQL, op13_collocations
from keyedit.llm.decontaminate import OP4_SQL, op4_decontaminate
from keyedit.llm.jaccard_join import OP9_SQL, op9_jaccard_join
from keyedit.llm.language_id import op3_language_id
from keyedit.llm.lm_score import op2_lm_score
from keyedit.llm.periodic_runs import op11_periodic_runs
from keyedit.llm.pieces import op8_pieces
from keyedit.llm.quality_model import op10_quality_model
from keyedit.llm.quality_rules import OP1_SQL, op1_quality_rules
from keyedit.llm.secret_scan import op5_secret_scan
from keyedit.llm.suffix_dedup import op6_suffix_dedup
from keyedit.llm.token_ids import op7_token_ids

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_lm_score": op2_lm_score,
    "op3_language_id": op3_language_id,
    "op4_decontaminate": op4_decontaminate,
    "op5_secret_scan": op5_secret_scan,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_ids": op7_token_ids,
    "op8_pieces": op8_pieces,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality_model": op10_quality_model,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_bpe": op12_bpe,
    "op13_collocations": op13_collocations,
}

ORACLE = {
    "op1_quality_rules": OP1_SQL,
    "op4_decontaminate": OP4_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op13_collocations": OP13_SQL,
}
