"""Queries of this subpackage and the SQL that states the same result, where SQL can."""

from __future__ import annotations

from gridfold.llm.chat import op6_chat_format
from gridfold.llm.chosenpath import op12_minhash_dedup
from gridfold.llm.decontam import op9_decontamination
from gridfold.llm.langid import op2_language_id
from gridfold.llm.licenses import op5_licenses
from gridfold.llm.linededup import OP10_SQL, op10_line_dedup
from gridfold.llm.mixing import op7_mixing
from gridfold.llm.quality_net import op4_quality_classifier
from gridfold.llm.quality_rules import op1_quality_rules
from gridfold.llm.sharding import op3_sharding
from gridfold.llm.simhash import op8_simhash
from gridfold.llm.spelling import op11_spelling_variants
from gridfold.llm.turnrepair import op13_turn_repair


QUERIES = (
    op1_quality_rules, op2_language_id, op3_sharding, op4_quality_classifier, op5_licenses, op6_chat_format, op7_mixing, op8_simhash,
    op9_decontamination, op10_line_dedup, op11_spelling_variants, op12_minhash_dedup, op13_turn_repair,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": OP10_SQL}
