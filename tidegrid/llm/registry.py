"""The queries of this subpackage, by the names under which they are registered, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .fingerprints import op10_fingerprints
from .jaccard import op6_jaccard_join
from .licenses import op4_license_scan
from .mixing import op1_mix_sources
from .neighbours import op8_neighbours
from .packing import op5_pack
from .quality import op3_quality
from .scoring import op7_lm_score
from .store import op2_token_store
from .toolcalls import OP9_SQL, op9_link_tool_calls

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_mix_sources": op1_mix_sources,
    "op2_token_store": op2_token_store,
    "op3_quality": op3_quality,
    "op4_license_scan": op4_license_scan,
    "op5_pack": op5_pack,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_lm_score": op7_lm_score,
    "op8_neighbours": op8_neighbours,
    "op9_link_tool_calls": op9_link_tool_calls,
    "op10_fingerprints": op10_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op9_link_tool_calls": OP9_SQL,
}
