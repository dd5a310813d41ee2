"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .alignment import op13_alignment
from .ann import op6_nearest
from .decontaminate import op10_decontaminate
from .manifest import op11_manifest
from .neardup import op7_neardup
from .pieces import op1_pieces
from .quality import op8_quality
from .seeds import op5_seeds
from .sharding import op3_shard
from .simhash import op12_simhash
from .suffixes import op2_suffixes
from .surrogates import op9_surrogates
from .toxicity import op4_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pieces": op1_pieces,
        "op2_suffixes": op2_suffixes,
        "op3_shard": op3_shard,
        "op4_toxicity": op4_toxicity,
        "op5_seeds": op5_seeds,
        "op6_nearest": op6_nearest,
        "op7_neardup": op7_neardup,
        "op8_quality": op8_quality,
        "op9_surrogates": op9_surrogates,
        "op10_decontaminate": op10_decontaminate,
        "op11_manifest": op11_manifest,
        "op12_simhash": op12_simhash,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffixes": oracles.BYTES, "op5_seeds": oracles.WORDS}
