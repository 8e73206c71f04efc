"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, exact_dedup, fill_middle, language, lexical, lm_score, minhash, mixing, quality, repeats, sharding, simhash, tokens


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_repeats": repeats.op2_repeats,
        "op3_minhash": minhash.op3_minhash,
        "op4_token_counts": tokens.op4_token_counts,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_mixing": mixing.op6_mixing,
        "op7_quality": quality.op7_quality,
        "op8_sharding": sharding.op8_sharding,
        "op9_language_id": language.op9_language_id,
        "op10_lm_score": lm_score.op10_lm_score,
        "op11_simhash": simhash.op11_simhash,
        "op12_lexical_search": lexical.op12_lexical_search,
        "op13_fill_middle": fill_middle.op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op2_repeats": repeats.OP2_SQL,
        "op3_minhash": minhash.OP3_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op12_lexical_search": lexical.OP12_SQL,
        "op13_fill_middle": fill_middle.OP13_SQL,
    }
