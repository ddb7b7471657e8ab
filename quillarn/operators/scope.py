"""Which source records a tokenised training set kept: batches of tokens aligned with the rows they were made from.

A batch holds the tokens of consecutive rows, cut at the end to whole blocks, so what follows a cut was dropped. Where a
batch ends among the rows depends on where it began, which makes the search a chain. Spark narrows it first: the rows are
laid end to end, and a batch can only begin where a row does whose tokens start as its proof says (a range join of hashes);
the chain then runs over these few candidates, on the driver, and reads no tokens.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillarn.functions.text import token_digest
from quillarn.operators.sequence import running

#: Tokens of a batch's beginning that name its possible starts.
PREFIX = 32


def laid(rows: DataFrame) -> DataFrame:
    """(ordinal, tokens, n, start): rows (ordinal, tokens) with where their tokens start when laid end to end."""
    return running(rows.select("ordinal", "tokens", F.size("tokens").cast("bigint").alias("n")), F.col("n"), "ordinal", "start")


def proofs(batches: DataFrame) -> DataFrame:
    """(batch, k, digest) of batches (batch, tokens)."""
    return batches.select("batch", F.size("tokens").cast("bigint").alias("k"), token_digest(F.col("tokens")).alias("digest"))


def starts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(batch, ordinal, start): for each batch the rows at which its tokens may begin: their tokens and those after them have
    the digest of the proof. Rows and lengths meet by range: a row is taken as far as the longest batch reaches."""
    r = laid(rows)
    longest = wanted.agg(F.max("k").alias("longest"))
    mine = r.crossJoin(F.broadcast(longest)).select("ordinal", "start", F.floor(F.col("start") / F.col("longest")).alias("cell"))
    pieces = r.crossJoin(F.broadcast(longest)).select(F.explode(F.sequence(F.floor(F.col("start") / F.col("longest")), F.floor((F.col("start") + F.greatest(F.col("n"), F.lit(1)) - 1) / F.col("longest")))).alias("cell"), F.col("start").alias("at"), "tokens", "n")
    text = pieces.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("rows"))
    flat = text.select("cell", F.flatten(F.transform("rows", lambda x: x["tokens"])).alias("t"), F.col("rows")[0]["at"].alias("origin"))
    both = mine.join(flat, "cell").join(flat.select((F.col("cell") - 1).alias("cell"), F.col("t").alias("t2"), F.col("origin").alias("origin2")), "cell", "left")
    # the second cell may begin with the row that the first one ends with
    seam = F.greatest(F.lit(0), F.col("origin") + F.size("t") - F.col("origin2"))
    tokens = F.concat(F.slice("t", (F.col("start") - F.col("origin") + 1).cast("int"), F.size("t")), F.coalesce(F.slice("t2", (seam + 1).cast("int"), F.size("t2")), F.array().cast("array<int>")))
    lengths = both.select("ordinal", "start", tokens.alias("tokens")).crossJoin(F.broadcast(wanted.select("k").distinct()))
    hashed = lengths.where(F.size("tokens") >= F.col("k")).select("ordinal", "start", "k", token_digest(F.slice("tokens", F.lit(1), F.col("k").cast("int"))).alias("digest"))
    return wanted.join(hashed, ["k", "digest"]).select("batch", "k", "ordinal", "start")


def align(rows: DataFrame, batches: DataFrame, block: int = 2048) -> DataFrame:
    """(ordinal, keep): how many tokens of each row the batches kept. A batch follows the one before at a row where that one
    can end: its rows' tokens, cut to whole blocks if they fill one, are as many as it holds. A token that doesn't fit, an
    end that isn't found or isn't the only one, and rows left over raise."""
    wanted = proofs(batches)
    size = {r.batch: r.k for r in wanted.collect()}
    begins: dict = {}
    for r in starts(rows, wanted).collect():
        begins.setdefault(r.batch, {})[r.start] = r.ordinal
    end = rows.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("bigint")).first()[0]
    order, at, spans = sorted(size), 0, []
    for i, b in enumerate(order):
        if at not in begins.get(b, {}):
            raise ValueError(f"batch {b}: its tokens aren't there")
        k, last = size[b], i + 1 == len(order)

        def holds(stop: int, at: int = at, k: int = k) -> bool:
            total = stop - at
            return (total // block * block if total >= block else total) == k

        after = [end] if last else sorted(begins.get(order[i + 1], {}))
        found = [s for s in after if s > at and holds(s)]
        if len(found) != 1:
            raise ValueError(f"batch {b}: {len(found)} ends fit its tokens")
        spans.append((at, at + k))
        at = found[0]
    if at != end:
        raise ValueError("rows are left over")
    spark = rows.sparkSession
    kept = spark.createDataFrame(spans, "low bigint, high bigint")
    r = laid(rows)
    part = F.greatest(F.lit(0), F.least(F.col("start") + F.col("n"), F.col("high")) - F.greatest("start", "low"))
    met = r.join(F.broadcast(kept), (F.col("start") < F.col("high")) & (F.col("start") + F.col("n") > F.col("low"))).groupBy("ordinal").agg(F.sum(part).alias("keep"))
    return r.select("ordinal").join(met, "ordinal", "left").select("ordinal", F.coalesce("keep", F.lit(0)).cast("int").alias("keep"))


def scope_statistics(rows: DataFrame) -> DataFrame:
    """Of rows (n, keep): tokens kept and dropped, records dropped whole and in part."""
    k, n = F.col("keep"), F.col("n")
    return rows.agg(F.count("*").alias("records"), F.sum(k).alias("retained"), F.sum(n - k).alias("dropped"), F.count_if(k == 0).alias("dropped_records"), F.count_if((k > 0) & (k < n)).alias("partial_records"))
