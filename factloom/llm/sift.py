"""Splitting rows by a table of keys without moving those that have none of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bits of the filter (8 MB); beyond it only more rows take the exact way.
BITS = 1 << 26


def _bloom(keys: DataFrame, key: str) -> np.ndarray:
    """A Bloom filter of two hashes as 64-bit words, built on the executors a word at a time."""
    count = keys.count()
    bits = min(BITS, 1 << max(10, (16 * count - 1).bit_length()))
    h = F.xxhash64(key)
    place = F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 32), F.lit(bits)))).alias("place")
    words = keys.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))).alias("value"))
    found = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("value").to_numpy().view(np.uint64)
    return out


class Sieve:
    """Tells by the hash of a key whether the table ``keys`` of distinct keys may hold it: a Bloom filter of bounded size."""

    def __init__(self, keys: DataFrame, key: str) -> None:
        self.words, self.key = _bloom(keys, key), key

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        """For ``xxhash64`` of keys; false only for keys that are not in the table."""
        words, bits = self.words, len(self.words) * 64
        out = np.ones(len(hashes), bool)
        for place in (hashes & (bits - 1), (hashes >> 32) & (bits - 1)):
            out &= (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out

    def column(self) -> Column:
        """The same as a column of a table that has the key."""
        maybe = self.maybe

        @F.pandas_udf("boolean")
        def of(h: pd.Series) -> pd.Series:
            return pd.Series(maybe(h.to_numpy(np.int64)))

        return of(F.xxhash64(self.key))


def split(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be in the table ``keys`` of distinct keys, and rows whose key is not, those with a null key among them.

    A fuller filter only makes the first part larger.
    """
    hit = Sieve(keys, key).column()
    return rows.filter(hit), rows.filter(~hit | F.col(key).isNull())


def without_keys(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the table ``dropped`` of distinct keys; rows with a null key stay.

    Only rows that a filter can't clear, about as many as are dropped, are shuffled for the exact anti-join.
    """
    hit, clear = split(rows, dropped, key)
    exact = hit.filter(F.col(key).isNotNull()).join(dropped.select(key), key, "left_anti").select(*rows.columns)
    return clear.unionByName(exact)
