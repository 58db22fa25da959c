"""The operators' registered queries and their SQL."""

from tidegraph.llm import oracles
from tidegraph.llm.op1_hmm import op1_hmm
from tidegraph.llm.op10_license import op10_license
from tidegraph.llm.op2_quality import op2_quality
from tidegraph.llm.op3_tokens import op3_tokens
from tidegraph.llm.op4_mix import op4_mix
from tidegraph.llm.op5_jaccard import op5_jaccard
from tidegraph.llm.op6_warc import op6_warc
from tidegraph.llm.op7_decontaminate import op7_decontaminate
from tidegraph.llm.op8_rules import op8_rules
from tidegraph.llm.op9_sections import op9_sections

QUERIES = {
    "op1_hmm": op1_hmm,
    "op2_quality": op2_quality,
    "op3_tokens": op3_tokens,
    "op4_mix": op4_mix,
    "op5_jaccard": op5_jaccard,
    "op6_warc": op6_warc,
    "op7_decontaminate": op7_decontaminate,
    "op8_rules": op8_rules,
    "op9_sections": op9_sections,
    "op10_license": op10_license,
}

ORACLES = {
    "op4_mix": oracles.MIX,
    "op5_jaccard": oracles.JACCARD,
    "op6_warc": oracles.WARC,
    "op7_decontaminate": oracles.DECONTAMINATE,
    "op8_rules": oracles.RULES,
    "op10_license": oracles.LICENSES,
}
