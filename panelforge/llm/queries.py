"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import manifest, minhash, mixing, negatives, secrets
from .chat import op1_chat_formatting
from .decontam import op4_benchmark_decontamination
from .fingerprint import op5_document_fingerprints
from .html import op3_html_extraction
from .jaccard import op6_ngram_jaccard_join
from .linededup import op10_line_dedup
from .manifest import op12_dataset_manifest
from .minhash import op11_minhash_near_dedup
from .negatives import op13_hard_negatives
from .quality import op9_quality_classifier
from .toxicity import op2_toxicity

QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_toxicity": op2_toxicity,
    "op3_html_extraction": op3_html_extraction,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
    "op11_minhash_near_dedup": op11_minhash_near_dedup,
    "op12_dataset_manifest": op12_dataset_manifest,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op6_ngram_jaccard_join": minhash.component_sql(3, 90, 100),
    "op7_secret_scans": secrets.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
    "op11_minhash_near_dedup": minhash.ORACLE,
    "op12_dataset_manifest": manifest.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
