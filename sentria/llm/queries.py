"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from sentria.llm.decontaminate import op8_decontaminate
from sentria.llm.html_text import op3_html_text
from sentria.llm.importance import OP12_SQL, op12_importance
from sentria.llm.jaccard_join import op9_jaccard_join
from sentria.llm.line_dedup import OP1_SQL, op1_line_dedup
from sentria.llm.lm_scoring import op5_lm_scoring
from sentria.llm.packing import op2_packing
from sentria.llm.periodic_runs import op13_periodic_runs
from sentria.llm.quality_model import op6_quality_model
from sentria.llm.quality_rules import OP10_SQL, op10_quality_rules
from sentria.llm.sanitise import OP11_SQL, op11_sanitise
from sentria.llm.token_files import op4_token_files
from sentria.llm.toxicity import op7_toxicity

QUERIES = {
    "op3_html_text": op3_html_text,
    "op5_lm_scoring": op5_lm_scoring,
    "op9_jaccard_join": op9_jaccard_join,
    "op6_quality_model": op6_quality_model,
    "op7_toxicity": op7_toxicity,
    "op2_packing": op2_packing,
    "op4_token_files": op4_token_files,
    "op8_decontaminate": op8_decontaminate,
    "op1_line_dedup": op1_line_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_sanitise": op11_sanitise,
    "op12_importance": op12_importance,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_sanitise": OP11_SQL,
    "op12_importance": OP12_SQL,
}
