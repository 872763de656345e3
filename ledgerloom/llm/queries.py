"""The registered queries of this package and their SQL."""

from __future__ import annotations

from ledgerloom.llm.byte_bpe import op7_byte_bpe
from ledgerloom.llm.chat_prefixes import OP4_SQL, op4_prefix_targets
from ledgerloom.llm.decontaminate import OP8_SQL, op8_decontamination
from ledgerloom.llm.filter_audit import OP12_SQL, op12_filter_audit
from ledgerloom.llm.jaccard_join import OP9_SQL, op9_ngram_jaccard_join
from ledgerloom.llm.license_scan import OP3_SQL, op3_license_scan
from ledgerloom.llm.merkle_manifest import OP13_SQL, op13_merkle_manifest
from ledgerloom.llm.orc_tokens import op11_orc_tokens
from ledgerloom.llm.order_minhash import op2_order_minhash
from ledgerloom.llm.pii_surrogates import op1_pii_surrogates
from ledgerloom.llm.quality_qda import op10_quality_qda
from ledgerloom.llm.toxicity import op6_toxicity
from ledgerloom.llm.url_templates import OP5_SQL, op5_path_templates

QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_surrogates,
        op2_order_minhash,
        op3_license_scan,
        op4_prefix_targets,
        op5_path_templates,
        op6_toxicity,
        op7_byte_bpe,
        op8_decontamination,
        op9_ngram_jaccard_join,
        op10_quality_qda,
        op11_orc_tokens,
        op12_filter_audit,
        op13_merkle_manifest,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": OP3_SQL,
    "op4_prefix_targets": OP4_SQL,
    "op5_path_templates": OP5_SQL,
    "op8_decontamination": OP8_SQL,
    "op9_ngram_jaccard_join": OP9_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
