"""The queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from . import lines, mixing, topk
from .embeddings import op4_embeddings
from .minhash import op1_minhash
from .packing import op8_packing
from .quality import op6_quality
from .scoring import op2_scoring
from .secrets import op3_secrets
from .transcripts import op7_transcripts

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_scoring": op2_scoring,
    "op3_secrets": op3_secrets,
    "op4_embeddings": op4_embeddings,
    "op5_lines": lines.op5_lines,
    "op6_quality": op6_quality,
    "op7_transcripts": op7_transcripts,
    "op8_packing": op8_packing,
    "op9_topk": topk.op9_topk,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES: dict[str, str] = {
    "op5_lines": lines.ORACLE,
    "op9_topk": topk.ORACLE,
    "op10_mixing": mixing.oracle(),
}
