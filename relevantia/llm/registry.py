"""The queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, licenses, mixing, pii, quality, secrets, simhash, token_store


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_quality": quality.op2_quality,
        "op3_simhash": simhash.op3_simhash,
        "op4_token_store": token_store.op4_token_store,
        "op5_chat": chat.op5_chat,
        "op6_licenses": licenses.op6_licenses,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_secrets": secrets.op8_secrets,
        "op9_pii": pii.op9_pii,
        "op10_bpe": bpe.op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.ORACLE,
        "op2_quality": quality.ORACLE,
        "op5_chat": chat.ORACLE,
        "op6_licenses": licenses.ORACLE,
        "op7_exact_dedup": exact_dedup.ORACLE,
    }
