"""Registered queries of the corpus operators; each runs over its whole tables with production parameters."""

from __future__ import annotations

from cubeflow.llm.covertree import OP8_SQL, op8_covertree
from cubeflow.llm.lines import op9_lines
from cubeflow.llm.minhash import op1_minhash
from cubeflow.llm.mixing import op6_mixing
from cubeflow.llm.packing import op2_packing
from cubeflow.llm.pii import op4_pii
from cubeflow.llm.quality import op7_quality
from cubeflow.llm.simhash import op3_simhash
from cubeflow.llm.suffixes import op10_suffixes
from cubeflow.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_covertree": op8_covertree,
    "op9_lines": op9_lines,
    "op10_suffixes": op10_suffixes,
}
ORACLES: dict[str, str] = {
    "op5_warc": OP5_SQL,
    "op8_covertree": OP8_SQL,
}
