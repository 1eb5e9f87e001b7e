"""The queries over whole tables, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from tessella.llm.decontaminate import op7_decontaminate
from tessella.llm.divergence import divergence_sql, op11_divergence
from tessella.llm.language import op4_language
from tessella.llm.licenses import op10_license_scan
from tessella.llm.lines import line_sql, op1_line_dedup
from tessella.llm.mixing import mixing_sql, op2_mixing
from tessella.llm.neighbours import op6_neighbours
from tessella.llm.packing import op12_packing
from tessella.llm.passages import op5_passages
from tessella.llm.simhash import op3_simhash
from tessella.llm.spelling import op13_spelling, spelling_sql
from tessella.llm.suffixes import op8_suffixes
from tessella.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_passages": op5_passages,
    "op6_neighbours": op6_neighbours,
    "op7_decontaminate": op7_decontaminate,
    "op8_suffixes": op8_suffixes,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
    "op11_divergence": op11_divergence,
    "op12_packing": op12_packing,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_sql(),
    "op2_mixing": mixing_sql(),
    "op11_divergence": divergence_sql(),
    "op13_spelling": spelling_sql(),
}
