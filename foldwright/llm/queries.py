"""Queries of this subpackage, and SQL for those that SQL can express."""

from . import bpe, chat, fill_middle, fingerprint, importance, language_id, mixing, near_duplicates, quality, secret_ledger, target_draw, toxicity, url_rules

QUERIES = {f.__name__: f for f in (
    language_id.op1_language_id, near_duplicates.op2_near_duplicates, bpe.op3_byte_bpe, secret_ledger.op4_secret_scan,
    quality.op5_repetition_quality, mixing.op6_source_mixing, importance.op7_importance_quality, toxicity.op8_toxicity,
    fingerprint.op9_fingerprints, chat.op10_chat_format, url_rules.op11_url_filter, fill_middle.op12_fill_in_middle, target_draw.op13_target_resampling)}

ORACLE_SQL = {"op6_source_mixing": mixing.oracle(), "op10_chat_format": chat.ORACLE, "op11_url_filter": url_rules.ORACLE, "op12_fill_in_middle": fill_middle.ORACLE,
              "op13_target_resampling": target_draw.ORACLE}
