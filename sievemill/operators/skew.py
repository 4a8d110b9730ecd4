"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: A key is hot if it holds more than one row in so many. There are at most so many hot keys.
ONE_IN = 1000
SALTS = 32


def hot_hashes(rows: DataFrame, key: Column, one_in: int = ONE_IN) -> list[int]:
    """The hashes of the keys with more than 1/``one_in`` of the rows, found in one pass.

    Keys are counted map-side by their hash and only the ``one_in`` most frequent hashes, each a number,
    come to the driver. Two keys of one hash count as one, which at worst spreads a key for nothing.
    """
    total = Observation()
    counted = rows.select(F.xxhash64(key).alias("h"), key.isNotNull().alias("set")).observe(total, F.count(F.lit(1)).alias("n")).where("set").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = counted.orderBy(F.desc("n")).limit(one_in).collect()
    return [r["h"] for r in top if r["n"] * one_in > (total.get["n"] if top else 0)]


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", *, spread_by: str, salts: int = SALTS, one_in: int = ONE_IN) -> DataFrame:
    """``big`` joined to ``small`` on ``key``, hot keys of ``big`` spread over ``salts`` tasks.

    Hot keys are counted exactly: those with more than 1/``one_in`` of the rows, of which there can be
    ``one_in`` at most, so the list of their hashes is bounded. Their rows in ``small`` are repeated once a
    salt, all others stay single. ``spread_by`` names the column of ``big`` whose hash gives the salt.
    ``how`` is inner or left. Null keys match nothing.
    """
    hot = hot_hashes(big, F.col(key), one_in)
    if not hot:
        return big.join(small, key, how)
    is_hot = F.xxhash64(key).isin(*hot)
    left = big.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0))
    right = small.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "__salt"], how).drop("__salt")
