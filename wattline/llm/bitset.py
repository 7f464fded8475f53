"""A bit set of fixed size over 64-bit values: what it lets through may be too much, never too little."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BITS = 24
_BLOCK = 16


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    flags = np.zeros(1 << _BLOCK, dtype=bool)
    flags[pdf["low"].to_numpy()] = True
    return pd.DataFrame({"block": pdf["block"][:1], "flags": [np.packbits(flags).tobytes()]})


def build(values: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """``2**bits`` bits with the low bits of every value set; blocks are made in tasks, so the driver gets 2**bits / 8 bytes."""
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (values.select(F.shiftright(place, _BLOCK).alias("block"), place.bitwiseAND(F.lit((1 << _BLOCK) - 1)).alias("low"))
            .distinct().groupBy("block").applyInPandas(_block, "block long, flags binary").toArrow())
    width = (1 << _BLOCK) // 8
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for b, flags in zip(rows["block"].to_pylist(), rows["flags"].to_pylist()):
        out[b * width:(b + 1) * width] = np.frombuffer(flags, dtype=np.uint8)
    return out


def test(flags: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bits of the values are set."""
    low = values.view(np.uint64) & np.uint64(len(flags) * 8 - 1)
    shift = np.uint8(7) - (low & np.uint64(7)).astype(np.uint8)
    return ((flags[low >> np.uint64(3)] >> shift) & np.uint8(1)).astype(bool)
