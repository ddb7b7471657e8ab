"""Problem 9: a mix of sources with target shares.

Each source's quota is its share of the whole; a source that can't fill it with ``max_repeat`` uses of its documents gives
what it has, and the others share the rest in proportion. A source's documents are put in a hashed order, another for each
use of the source, and cut into blocks of equal tokens. A low-discrepancy schedule deals the blocks: the golden-ratio
sequence, mapped through the cumulative quotas, names a source for each slot, and the n-th slot of a source takes its n-th
block. Running sums and ranks are taken in two levels (within buckets, over buckets), so no source is one task.

Defined results: null and empty texts have no tokens and come with the block they fall into; documents of a source without
a target, or of none, are not used but count for the size of the whole; a source with a target and without documents gets
no tokens, which the shares say; an empty table gives an empty mix and shares of 0.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillarn.llm import encode
from quillarn.session import cut

#: Tokens of a block.
BLOCK = 4096
#: Documents of a bucket of the hashed order, about; slots of a chunk of the schedule.
BUCKET, CHUNK = 20_000, 65_536
GOLDEN = (math.sqrt(5) - 1) / 2


def quotas(targets: list[tuple[str, float, int]], tokens: dict[str, int], whole: int) -> dict[str, float]:
    """Tokens each source is to give."""
    most = {s: float(tokens.get(s, 0) * max(r or 0, 0)) for s, _, r in targets}
    share = {s: float(w or 0) for s, w, _ in targets}
    out = {s: 0.0 for s in most}
    open_ = {s for s in most if most[s] > 0 and share[s] > 0}
    left = float(whole)
    while open_ and left > 1e-6:
        weight = sum(share[s] for s in open_)
        full = {s for s in open_ if left * share[s] / weight >= most[s]}
        if not full:
            for s in open_:
                out[s] = left * share[s] / weight
            break
        for s in full:
            out[s] = most[s]
        left = whole - sum(out[s] for s in most if s not in open_ or s in full)
        open_ -= full
    return out


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens) of all documents, as a table."""
    counted = encode.encode(documents.select("doc_id", "text", "source").withColumn("doc", F.struct("doc_id", "source")), key="doc")
    return cut(counted.select("doc.doc_id", "doc.source", F.size("ids").cast("bigint").alias("n_tokens")), "sizes")


def mix(documents: DataFrame, targets: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The mix (slot, doc_id, source, use, n_tokens), to be read in the order of slots, and the shares (source,
    target_share, max_repeat, available_tokens, tokens, actual_share, most_uses)."""
    spark = documents.sparkSession
    docs = sized(documents)
    by_source = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    wanted = [(r.source, r.target_share, r.max_repeat) for r in targets.where(F.col("source").isNotNull()).collect()]
    whole = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    have = {r.source: r for r in by_source.join(F.broadcast(targets.select("source")), "source", "left_semi").collect()}
    quota = quotas(wanted, {s: r.tokens for s, r in have.items()}, whole)
    used = {s: q for s, q in quota.items() if q > 0}
    plan, low = [], 0.0
    total = sum(used.values())
    for i, s in enumerate(sorted(used)):
        high = low + used[s] / total
        plan.append((s, used[s], have[s].tokens, math.ceil(used[s] / have[s].tokens - 1e-9), max(1, have[s].docs // BUCKET), low, high, i))
        low = high
    sources = F.broadcast(spark.createDataFrame(plan, "source string, quota double, tokens bigint, uses int, buckets bigint, low double, high double, place int"))

    order = F.xxhash64("doc_id", "use")
    rows = docs.join(sources, "source").select("doc_id", "source", "n_tokens", "quota", "tokens", "place", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("use"), "buckets")
    rows = rows.withColumn("h", order).withColumn("bucket", F.floor((F.shiftrightunsigned("h", 1) / F.lit(2.0**63)) * F.col("buckets")).cast("bigint"))
    sums = rows.groupBy("source", "use", "bucket").agg(F.sum("n_tokens").alias("n"))
    ahead = sums.select("source", "use", "bucket", (F.sum("n").over(Window.partitionBy("source", "use").orderBy("bucket")) - F.col("n")).alias("ahead"))
    inside = Window.partitionBy("source", "use", "bucket").orderBy(F.shiftrightunsigned("h", 1), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(ahead, ["source", "use", "bucket"])
    start = F.col("use") * F.col("tokens") + F.col("ahead") + F.col("within")
    chosen = placed.withColumn("start", start).where(F.col("start") + F.col("n_tokens") / 2 <= F.col("quota")).withColumn("block", F.floor(F.col("start") / F.lit(block)).cast("bigint"))

    n_slots = int(total / block * 1.02) + 32 * (len(plan) + 1)
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK).alias("chunk"), F.pmod((F.col("id") + 0.5) * F.lit(GOLDEN), F.lit(1.0)).alias("u"))
    dealt = slots.join(sources.select("source", "low", "high"), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("slot", "chunk", "source")
    counts = dealt.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("source", "chunk", (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot"))).join(before, ["source", "chunk"])
    blocks = ranked.select("source", "slot", (F.col("before") + F.col("rank") - 1).alias("block"))
    # the last blocks of a source may lie beyond its slots by the discrepancy; they follow at the end
    mixed = chosen.join(blocks, ["source", "block"], "left").select(F.coalesce("slot", F.lit(n_slots) + F.col("block") * len(plan) + F.col("place")).alias("slot"), "doc_id", "source", F.col("use").cast("int").alias("use"), "n_tokens")

    uses = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), (F.max("use") + 1).alias("most_uses"))
    size = mixed.agg(F.sum("n_tokens").alias("size"))
    shares = (
        targets.select("source", "target_share", "max_repeat")
        .join(uses, "source", "left")
        .join(by_source.select("source", F.col("tokens").alias("available_tokens")), "source", "left")
        .crossJoin(F.broadcast(size))
        .select("source", "target_share", "max_repeat", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.try_divide(F.coalesce("tokens", F.lit(0)).cast("double"), F.col("size").cast("double")), F.lit(0.0)).alias("actual_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
    )
    return mixed, shares
