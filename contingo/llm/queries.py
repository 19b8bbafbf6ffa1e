"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from contingo.llm.bpe import op6_bpe_encode_decode
from contingo.llm.centroids import OP12_SQL, op12_centroid_clustering
from contingo.llm.chat import OP13_SQL, op13_chat_formatting
from contingo.llm.decontaminate import OP2_SQL, op2_benchmark_decontamination
from contingo.llm.html import op1_html_extraction
from contingo.llm.jaccard import op3_ngram_jaccard_join
from contingo.llm.lattice import op8_lattice_likelihood
from contingo.llm.pii import op5_pii_pseudonyms
from contingo.llm.quality import OP10_SQL, op10_quality_rules
from contingo.llm.secrets import op9_secret_scan
from contingo.llm.tokenfile import op7_token_id_files
from contingo.llm.toxicity import op4_toxicity
from contingo.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_bpe_encode_decode": op6_bpe_encode_decode,
    "op7_token_id_files": op7_token_id_files,
    "op8_lattice_likelihood": op8_lattice_likelihood,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_chat_formatting": op13_chat_formatting,
}
ORACLES = {
    "op2_benchmark_decontamination": OP2_SQL,
    "op10_quality_rules": OP10_SQL,
    "op12_centroid_clustering": OP12_SQL,
    "op13_chat_formatting": OP13_SQL,
}
