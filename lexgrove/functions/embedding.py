"""Vectors that need no weights (OP-R07, C11)."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(text: str, dimension: int) -> np.ndarray:
    """Counts of the words by the remainder of their 64-bit BLAKE2b, at unit length; zeros without words."""
    places = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % dimension for w in re.findall(r"\w+", text.lower())]
    v = np.bincount(places, minlength=dimension).astype(np.float32)
    return v / (np.linalg.norm(v) or np.float32(1))


def hashing_embed(text: Column, dimension: int) -> Column:
    """array<float>; a null text gives zeros."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([hashed(t or "", dimension) for t in texts])

    return run(text)
