"""The registered queries of this subpackage, by name, and the SQL that checks them."""

from __future__ import annotations

from arcweave.llm import decontamination, periodic_runs, spelling
from arcweave.llm.fingerprints import op1_fingerprints
from arcweave.llm.jaccard_join import op6_ngram_jaccard_join
from arcweave.llm.language_id import op12_language_id
from arcweave.llm.language_model import op8_language_model
from arcweave.llm.packing import op10_best_fit_packing
from arcweave.llm.quality import op2_quality
from arcweave.llm.substring_dedup import op7_substring_dedup
from arcweave.llm.token_counts import op9_token_counts
from arcweave.llm.toxicity import op3_toxicity
from arcweave.llm.warc import op4_warc_index

QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_quality, op3_toxicity, op4_warc_index, decontamination.op5_spaced_seeds, op6_ngram_jaccard_join, op7_substring_dedup, op8_language_model, op9_token_counts, op10_best_fit_packing, spelling.op11_spelling_variants, op12_language_id, periodic_runs.op13_periodic_runs)}
ORACLE_SQL: dict[str, str] = {"op5_spaced_seeds": decontamination.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op13_periodic_runs": periodic_runs.ORACLE}
