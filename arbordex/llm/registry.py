"""The queries of this subpackage, by name, and their SQL where SQL can say the same on whole tables."""

from __future__ import annotations

import corpus_pipeline

from arbordex.llm import op3_substrings, op5_jaccard, op8_suffixes, op10_lines, op12_resampling, op13_decontamination
from arbordex.llm.op1_media import op1_media
from arbordex.llm.op2_language import op2_language
from arbordex.llm.op4_packing import op4_packing
from arbordex.llm.op6_fingerprints import op6_fingerprints
from arbordex.llm.op7_secrets import op7_secrets
from arbordex.llm.op9_pieces import op9_pieces
from arbordex.llm.op11_whitening import op11_whitening

_OPERATORS = (
    op1_media,
    op2_language,
    op3_substrings.op3_substrings,
    op4_packing,
    op5_jaccard.op5_jaccard,
    op6_fingerprints,
    op7_secrets,
    op8_suffixes.op8_suffixes,
    op9_pieces,
    op10_lines.op10_lines,
    op11_whitening,
    op12_resampling.op12_resampling,
    op13_decontamination.op13_decontamination,
)
QUERIES = {f.__name__: f for f in _OPERATORS} | {"pipeline": corpus_pipeline.run}
ORACLE: dict[str, str] = {m.__name__.rsplit(".", 1)[1]: m.ORACLE for m in (op3_substrings, op5_jaccard, op8_suffixes, op10_lines, op12_resampling, op13_decontamination)}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
