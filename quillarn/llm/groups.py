"""Problem 3: splits that keep related records together.

A record's title, subject and question are keys; keys of one record are linked. Groups are the components of the graph of
keys, found by hash-to-min: every node keeps a cluster, sends it to its least member and that member to the whole cluster,
until nothing changes. Records hang on their first key, so a key shared by any number of records is one node.

Weighted rendezvous hashing then gives each group the split with the best of its weighted hashes. Groups of more than a
thousandth of all rows (at most a thousand) are placed first, largest first, each into the split that lacks most; the
others' weights are what is lacking then, so that the shares of rows come out as asked.

Nodes are 128-bit digests of their keys. Defined results: null or blank titles, subjects and questions relate nothing; a
record without any key is a group of its own; null splits tear nothing, but rows with null splits belong to torn groups;
an empty table gives empty results.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillarn.functions.text import bare, name_key
from quillarn.session import cut, drop

SHARES = {"fit": 0.60, "dev": 0.25, "audit": 0.15}
#: Groups above this share of all rows are placed one by one.
LARGE = 0.001


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of a graph given as (a, b) pairs of one type, in any order and with any repeats; a == b makes a
    node without neighbours. A component is named by its least node."""
    pair = edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
    state = pair.union(pair.select("u", "v")).union(pair.select("v", F.col("v").alias("u"))).union(pair.select("u", F.col("u").alias("u2"))).distinct()
    state = cut(state, "clusters")
    seen = None
    while True:
        least = state.groupBy("v").agg(F.min("u").alias("m"))
        told = state.join(least, "v")
        new = cut(told.select(F.explode(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.v", "x.u").distinct(), "clusters")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        drop(state)
        state = new
        if now == seen:
            break
        seen = now
    return state.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))


def grouped(records: DataFrame) -> DataFrame:
    """(stable_id, split, group_id) of each row."""

    def node(kind: str, key):
        return F.unhex(F.md5(F.concat(F.lit(kind + "\n"), key)))

    keys = F.array_compact(F.array(node("title", name_key(F.col("source_title"))), node("subject", name_key(F.col("subject"))), node("question", F.nullif(bare(F.col("question")), F.lit("")))))
    rows = cut(records.select("stable_id", "split", keys.alias("keys")), "keys")
    edges = rows.where(F.size("keys") > 0).select(F.col("keys")[0].alias("a"), F.explode("keys").alias("b")).distinct()
    comp = components(edges)
    tied = rows.select("stable_id", "split", F.coalesce(F.get("keys", F.lit(0)), node("alone", F.coalesce("stable_id", F.lit("")))).alias("node"))
    return cut(tied.join(comp, "node", "left").select("stable_id", "split", F.lower(F.hex(F.coalesce("component", "node"))).alias("group_id")), "grouped")


def torn(groups: DataFrame) -> DataFrame:
    """The rows whose group holds more than one split."""
    bad = groups.groupBy("group_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a < b")
    return groups.join(bad, "group_id", "left_semi")


def assign(groups: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """(stable_id, group_id, split, new_split) of each row."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    total = groups.count()
    large = sizes.where(F.col("n") > F.lit(LARGE * total)).orderBy(F.desc("n"), "group_id").collect()
    lacking = {s: w * total for s, w in shares.items()}
    placed = {}
    for g in large:
        best = max(lacking, key=lambda s: (lacking[s], s))
        lacking[best] -= g.n
        placed[g.group_id] = best
    weights = {s: max(x, 0.0) for s, x in lacking.items()}
    if not any(weights.values()):
        weights = dict(shares)

    def score(s: str, w: float):
        uniform = (F.shiftrightunsigned(F.xxhash64("group_id", F.lit(s)), 11).cast("double") + 0.5) / F.lit(2.0**53)
        return F.struct((F.lit(w) / -F.log(uniform)).alias("score"), F.lit(s).alias("split"))

    ranked = [score(s, w) for s, w in sorted(weights.items()) if w > 0]
    drawn = (F.greatest(*ranked) if len(ranked) > 1 else ranked[0])["split"]
    if not placed:
        return groups.select("stable_id", "group_id", "split", drawn.alias("new_split"))
    fixed = groups.sparkSession.createDataFrame(list(placed.items()), "group_id string, placed string")
    return groups.join(F.broadcast(fixed), "group_id", "left").select("stable_id", "group_id", "split", F.coalesce("placed", drawn).alias("new_split"))


def shares_of(assigned: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """(split, wanted, rows, share) of an assignment."""
    wanted = assigned.sparkSession.createDataFrame([(s, float(w)) for s, w in shares.items()], "split string, wanted double")
    n = assigned.groupBy(F.col("new_split").alias("split")).agg(F.count("*").alias("rows"))
    total = assigned.agg(F.count("*").alias("total"))
    return F.broadcast(wanted).join(n, "split", "left").join(F.broadcast(total)).select("split", "wanted", F.coalesce("rows", F.lit(0)).alias("rows"), F.try_divide(F.coalesce("rows", F.lit(0)).cast("double"), F.col("total").cast("double")).alias("share"))
