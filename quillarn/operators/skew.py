"""Joins on keys of which a few may hold a large part of all rows."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key of more than this share of the rows is hot; so there are at most 1 / HOT hot keys, which may be sent to all.
HOT = 0.001


def hot_keys(rows: DataFrame, *key: str, share: float = HOT) -> DataFrame:
    """The keys of more than ``share`` of the rows, from partial counts."""
    n = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_total"))
    return n.crossJoin(F.broadcast(total)).where(F.col("_n") > F.col("_total") * share).select(*key)


def salted_join(big: DataFrame, small: DataFrame, key: list[str], row: Column, counted: DataFrame | None = None, how: str = "inner", salts: int = 64) -> DataFrame:
    """``big`` joined with ``small``, which has each key once: rows of hot keys are spread over ``salts`` parts by a hash of
    ``row``, and the few rows of ``small`` they meet are repeated for each. Rows without a key, which meet nothing, are
    spread too. ``counted`` is what the keys are counted in, if that is cheaper to read than ``big``."""
    hot = F.broadcast(hot_keys(big if counted is None else counted, *key).withColumn("_hot", F.lit(True)))
    none = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))
    spread = F.coalesce(F.col("_hot"), F.lit(False)) | none
    b = big.join(hot, key, "left").withColumn("_salt", F.when(spread, F.pmod(F.xxhash64(row), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    all_salts = F.when(F.coalesce(F.col("_hot"), F.lit(False)), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    s = small.join(hot, key, "left").withColumn("_salt", F.explode(all_salts)).drop("_hot")
    return b.join(s, [*key, "_salt"], how).drop("_salt")
