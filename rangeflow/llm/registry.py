"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .op1_gam import op1_quality_gam
from .op2_tokens import op2_token_files
from .op3_sigtree import ORACLE_SQL as COMPONENTS_SQL
from .op3_sigtree import op3_signature_tree
from .op4_pack import op4_pack_nnls
from .op5_qgrams import op5_qgram_leaks
from .op6_bwt import ORACLE_SQL as BYTES_SQL
from .op6_bwt import op6_column_bwt
from .op7_recompress import ORACLE_SQL as WORDS_SQL
from .op7_recompress import op7_recompression
from .op8_licences import ORACLE_SQL as LICENCE_SQL
from .op8_licences import op8_sentence_rules
from .op9_hosts import op9_host_words
from .op10_ledger import ABLATIONS_SQL, op10_rule_ledger, rule_ablations
from .op10_ledger import ORACLE_SQL as LEDGER_SQL
from .op11_toxicity import op11_deobfuscated_toxicity
from .op12_whiten import op12_embedding_whitening

QUERIES = {
    "op1_quality_gam": op1_quality_gam,
    "op2_token_files": op2_token_files,
    "op3_signature_tree": op3_signature_tree,
    "op4_pack_nnls": op4_pack_nnls,
    "op5_qgram_leaks": op5_qgram_leaks,
    "op6_column_bwt": op6_column_bwt,
    "op7_recompression": op7_recompression,
    "op8_sentence_rules": op8_sentence_rules,
    "op9_host_words": op9_host_words,
    "op10_rule_ledger": op10_rule_ledger,
    "op11_deobfuscated_toxicity": op11_deobfuscated_toxicity,
    "op12_embedding_whitening": op12_embedding_whitening,
    "rule_ablations": rule_ablations,
}
ORACLE_SQL = {
    "op3_signature_tree": COMPONENTS_SQL,
    "op6_column_bwt": BYTES_SQL,
    "op7_recompression": WORDS_SQL,
    "op8_sentence_rules": LICENCE_SQL,
    "op10_rule_ledger": LEDGER_SQL,
    "rule_ablations": ABLATIONS_SQL,
}
