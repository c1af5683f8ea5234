"""Problem 4: a sample that is the same in every run and layout and keeps its members as data grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_hash(key: list[str], salt: str) -> Column:
    """A record key mapped to [0, 1): the first 52 bits of an MD5 over the salt and the parts of the key.

    Parts are joined with their lengths, so that no two keys read alike; a null part differs from every string.
    """
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in key]
    digest = F.md5(F.concat_ws("|", F.lit(salt), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def stable_sample(df: DataFrame, key: list[str], rate: float, salt: str = "sample-1") -> DataFrame:
    """The rows whose key hashes under rate; no shuffle, no state.

    Whether a row is in depends on its key, salt and rate alone: later rows can't push it out, all rows of a key go
    together, repeated rows stay, and a higher rate keeps every member. Rows with a null in the key are in no sample,
    for they name no record. Rate 0 gives nothing, rate 1 every row with a whole key.
    """
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    return df.where(whole & (unit_hash(key, salt) < F.lit(float(rate))))


def sample_items(df: DataFrame, item: list[str], rate: float, salt: str = "sample-1") -> DataFrame:
    """(item..., n_rows, u): the sampled items, each once, filtered before the shuffle."""
    return stable_sample(df, item, rate, salt).groupBy(*item).agg(F.count("*").alias("n_rows")).withColumn("u", unit_hash(item, salt))
