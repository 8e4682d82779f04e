"""The registered queries of this subpackage: op<N>_<name>, each over its whole table, and EXTRA ones, which show parts of
operators that the former don't reach."""

from __future__ import annotations

from . import chat, infill, secrets
from .bpe import op7_bpe_merge_replay
from .chat import chat_event_log, op6_chat_event_fold
from .cobucket import op13_radix_co_bucketing
from .decontam import op2_bm25_wand_decontamination
from .infill import op12_fill_in_middle
from .license import op3_license_template_automata
from .lm import op1_log_bilinear_nce
from .multiindex import op11_inverted_multi_index
from .quality import op4_importance_resampling
from .secrets import op8_secret_blob_ledger, secret_ledger_versions
from .sharding import op10_rendezvous_sharding
from .simhash import op9_simhash_multi_index
from .spotsigs import op5_spotsigs_fingerprints, spotsigs_near_pairs

QUERIES = {
    "op1_log_bilinear_nce": op1_log_bilinear_nce,
    "op2_bm25_wand_decontamination": op2_bm25_wand_decontamination,
    "op3_license_template_automata": op3_license_template_automata,
    "op4_importance_resampling": op4_importance_resampling,
    "op5_spotsigs_fingerprints": op5_spotsigs_fingerprints,
    "op6_chat_event_fold": op6_chat_event_fold,
    "op7_bpe_merge_replay": op7_bpe_merge_replay,
    "op8_secret_blob_ledger": op8_secret_blob_ledger,
    "op9_simhash_multi_index": op9_simhash_multi_index,
    "op10_rendezvous_sharding": op10_rendezvous_sharding,
    "op11_inverted_multi_index": op11_inverted_multi_index,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_radix_co_bucketing": op13_radix_co_bucketing,
}

EXTRA = {"chat_event_log": chat_event_log, "secret_ledger_versions": secret_ledger_versions, "spotsigs_near_pairs": spotsigs_near_pairs}
QUERIES |= EXTRA

#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {
    "op6_chat_event_fold": chat.ORACLE,
    "chat_event_log": chat.ORACLE,
    "op8_secret_blob_ledger": secrets.ORACLE,
    "op12_fill_in_middle": infill.ORACLE,
    "secret_ledger_versions": secrets.ORACLE,
}
