"""Problem 4: records that differ in formatting only.

A record's canonical key is the 128-bit digest of its folded fields, those of ``metadata`` in the order of their names. Hot
keys (more than a thousandth of all rows, so at most a thousand) are found exactly: each partition reports the keys it
holds more often than its part of the bound, and only those are counted over the whole table. Hot keys are aggregated in
two levels, by key and salt and then by key; all others in one. The least ordinal represents a group.

Defined results: a null field equals only a null field; metadata that is no JSON object counts as its folded text; a row
repeated whole is a copy but is not paired with itself; an empty table gives empty results.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillarn.functions.text import bare
from quillarn.session import cut, parallelism

#: A key held by more than this share of all rows is hot.
HOT = 0.001
#: Candidates up to this number are counted by a broadcast join, more by a plain aggregation.
CANDIDATES = 100_000


def canonical(records: DataFrame) -> Column:
    """The canonical key of a qa_ref row."""
    none = F.lit("\u0001")

    def field(x: Column) -> Column:
        return F.coalesce(bare(x), none)

    entries = F.map_entries(F.from_json("metadata", "map<string,string>"))
    pairs = F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat(field(e["key"]), F.lit("\u0002"), field(e["value"])))), "\u0003")
    aliases = F.array_join(F.transform("aliases", field), "\u0003")
    parts = [field(F.col("dataset")), field(F.col("question")), field(F.col("answer")), F.coalesce(aliases, none), F.coalesce(pairs, field(F.col("metadata")))]
    return F.unhex(F.md5(F.concat_ws("\u0004", *parts)))


def hot_keys(keyed: DataFrame, share: float = HOT) -> DataFrame:
    """(key, n) of the keys of more than ``share`` of all rows, exactly."""
    total = keyed.count()
    bound = max(1.0, share * total)
    each = bound / max(1, keyed.rdd.getNumPartitions())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, "S16"), np.zeros(0, np.int64)
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(0).to_pylist()), np.dtype("V16"))
            if not len(raw):
                continue
            # two 64-bit halves sort faster than raw bytes
            halves = raw.view(np.uint64).reshape(-1, 2)
            order = np.lexsort((halves[:, 1], halves[:, 0]))
            h = halves[order]
            first = np.append(True, (h[1:] != h[:-1]).any(axis=1))
            n = np.diff(np.append(np.flatnonzero(first), len(h)))
            part = h[first]
            if not len(counts):
                keys, counts = part, n
            else:
                both, m = np.concatenate([keys, part]), np.concatenate([counts, n])
                order = np.lexsort((both[:, 1], both[:, 0]))
                both, m = both[order], m[order]
                first = np.append(True, (both[1:] != both[:-1]).any(axis=1))
                keys, counts = both[first], np.add.reduceat(m, np.flatnonzero(first))
        if len(counts):
            ok = counts >= each
            raw = np.ascontiguousarray(keys[ok]).view(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())], ["key"])

    candidates = cut(keyed.select("key").mapInArrow(partial, "key binary").distinct(), "candidates")
    if candidates.count() <= CANDIDATES:
        counted = keyed.join(F.broadcast(candidates), "key", "left_semi")
    else:
        counted = keyed
    return cut(counted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bound), "hot")


def _parts(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of hot keys, the other rows, and (key, least, n) of the hot keys."""
    keyed = cut(records.select("ordinal", canonical(records).alias("key")), "canonical")
    hot = hot_keys(keyed)
    warm = keyed.join(F.broadcast(hot.select("key")), "key", "left_semi")
    cold = keyed.join(F.broadcast(hot.select("key")), "key", "left_anti")
    salt = F.pmod(F.xxhash64("ordinal"), F.lit(4 * parallelism(records.sparkSession)))
    level = warm.groupBy("key", salt.alias("salt")).agg(F.min("ordinal").alias("least"), F.count("*").alias("n"))
    return warm, cold, level.groupBy("key").agg(F.min("least").alias("least"), F.sum("n").alias("n"))


def groups(records: DataFrame) -> DataFrame:
    """(ordinal, copies): each group's representative and how many records it stands for."""
    _, cold, hot = _parts(records)
    rest = cold.groupBy("key").agg(F.min("ordinal").alias("least"), F.count("*").alias("n"))
    return rest.union(hot).select(F.col("least").alias("ordinal"), F.col("n").alias("copies"))


def collapsed(records: DataFrame) -> DataFrame:
    """Each group's representative record with its number of copies; a row repeated whole is given once."""
    names = [c for c in records.columns if c.lower() != "copies"]
    return records.select(*names).dropDuplicates(["ordinal"]).join(groups(records), "ordinal")


def pairs(records: DataFrame) -> DataFrame:
    """(ordinal_a, ordinal_b): a group's least ordinal with each other of its ordinals."""
    from pyspark.sql import Window

    warm, cold, hot = _parts(records)
    rest = cold.withColumn("least", F.min("ordinal").over(Window.partitionBy("key")))
    both = rest.select("least", "ordinal").union(warm.join(F.broadcast(hot), "key").select("least", "ordinal"))
    return both.where("ordinal > least").select(F.col("least").alias("ordinal_a"), F.col("ordinal").alias("ordinal_b"))
