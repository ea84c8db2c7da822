"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from lodestrata.llm.embeddings import OP8_SQL, op8_embedding_dedup
from lodestrata.llm.lines import op3_line_dedup
from lodestrata.llm.manifest import OP12_SQL, op12_merkle_manifest
from lodestrata.llm.mixing import OP6_SQL, op6_mixing
from lodestrata.llm.packing import op5_best_fit_packing
from lodestrata.llm.pieces import op13_sentencepiece
from lodestrata.llm.pii import op7_pii
from lodestrata.llm.quality import op9_quality_classifier
from lodestrata.llm.resample import OP11_SQL, op11_importance_resampling
from lodestrata.llm.rules import op10_quality_rules
from lodestrata.llm.simhash import op2_simhash
from lodestrata.llm.tokenfile import op1_token_output
from lodestrata.llm.toxicity import op4_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_output,
        op2_simhash,
        op3_line_dedup,
        op4_toxicity,
        op5_best_fit_packing,
        op6_mixing,
        op7_pii,
        op8_embedding_dedup,
        op9_quality_classifier,
        op10_quality_rules,
        op11_importance_resampling,
        op12_merkle_manifest,
        op13_sentencepiece,
    )
}
#: Only what SQL can express on whole tables; the others are tested against brute force.
SQL = {"op6_mixing": OP6_SQL, "op8_embedding_dedup": OP8_SQL, "op11_importance_resampling": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
