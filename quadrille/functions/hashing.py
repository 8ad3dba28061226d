"""Jump consistent hashing as a column (vectorised), and a native string hash for dictionary shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier of the published algorithm (Lamping and Veach, 2014).
MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit key among n."""
    key = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    nxt = np.zeros(len(key), np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            out[live] = nxt[live]
            key[live] = key[live] * np.uint64(MULTIPLIER) + np.uint64(1)
            nxt[live] = ((out[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            live = live[nxt[live] < n]
    return out


def jump_hash(v: Column | str, n: int) -> Column:
    """Home server of a vertex id among n; null stays null."""
    if n < 1:
        raise ValueError("at least one server is needed")

    @F.pandas_udf("int")
    def home(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = pd.array([pd.NA] * len(ids), "Int32")
        if known.any():
            out[known] = jump(ids[known].to_numpy(np.int64), n).astype(np.int32)
        return pd.Series(out)

    return home(F.col(v) if isinstance(v, str) else v)


def shard(term: Column | str, n: int) -> Column:
    """Shard of a term."""
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")
