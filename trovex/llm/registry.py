"""Queries of this subpackage and their SQL twins, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from trovex.llm.bpe_prefix import op7_prefix_bpe
from trovex.llm.flac_media import op4_flac_columns
from trovex.llm.lang_centroid import op5_nearest_centroid
from trovex.llm.lattice_lm import op9_lattice_lm
from trovex.llm.line_join import OP3_SQL, op3_similar_lines
from trovex.llm.minhash_circulant import op10_circulant_minhash
from trovex.llm.mix_pivotal import op2_pivotal_mix
from trovex.llm.pii_feistel import op6_feistel_pseudonyms
from trovex.llm.quality_suffix import op1_suffix_repetition
from trovex.llm.toxic_ftrl import op8_ftrl_toxicity

SQL: dict[str, str] = {"op3_similar_lines": OP3_SQL}


def queries() -> dict[str, Callable]:
    found = (
        op1_suffix_repetition,
        op2_pivotal_mix,
        op3_similar_lines,
        op4_flac_columns,
        op5_nearest_centroid,
        op6_feistel_pseudonyms,
        op7_prefix_bpe,
        op8_ftrl_toxicity,
        op9_lattice_lm,
        op10_circulant_minhash,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
