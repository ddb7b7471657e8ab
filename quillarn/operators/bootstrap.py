"""Resampling whole clusters: sums are taken in Spark, and so are the draws.

A bootstrap draw gives each of n clusters a weight, jointly multinomial. Clusters stand in blocks of at most about ``BLOCK``;
the multinomial is drawn in two levels, first how many of the n draws fall into each block (every task draws the same, from
the same seed), then which clusters of the block. That is the same distribution as one draw over all clusters, and no task
holds more than a block. Strata are drawn apart, each keeping its number of clusters. All statistics of a draw use the same
weights, so contrasts are paired.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Clusters of a block, about.
BLOCK = 20_000
#: Weights of so many clusters and draws are in memory at once.
CELLS = 1 << 22
SEED, RUN_SEED = 20260921, 20260922


def cluster_sums(rows: DataFrame, cluster: str, dataset: str, values: dict[str, Column], datasets: list[str]) -> DataFrame:
    """(stratum, cluster, sums): for each cluster the sum of each value over its rows of each dataset, dataset by dataset in
    the order given; a cluster's stratum is the set of datasets it occurs in. A cluster that is null raises."""
    kept = F.when(F.col(cluster).isNull(), F.raise_error(F.lit("a row has no cluster")).cast("string")).otherwise(F.col(cluster).cast("string"))
    wide = [F.coalesce(F.sum(F.when(F.col(dataset) == d, v)), F.lit(0.0)).cast("double") for d in datasets for v in values.values()]
    stratum = F.concat_ws("\u0001", F.array_sort(F.collect_set(dataset)))
    return rows.where(F.col(dataset).isin(datasets)).groupBy(kept.alias("cluster")).agg(stratum.alias("stratum"), F.array(*wide).alias("sums")).select("stratum", "cluster", "sums")


def resample(clusters: DataFrame, draws: int = 10_000, seed: int = SEED) -> DataFrame:
    """(draw, s): the sums of each draw over clusters (stratum, cluster, sums)."""
    sizes = clusters.groupBy("stratum").agg(F.count("*").alias("n"))
    placed = clusters.join(F.broadcast(sizes), "stratum")
    block = F.pmod(F.xxhash64("cluster", F.lit(seed)), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("bigint"))
    placed = placed.select("stratum", block.alias("block"), "cluster", "sums")
    counts = placed.groupBy("stratum", "block").agg(F.count("*").alias("k"))
    plan = counts.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("block", "k"))).alias("blocks"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        blocks = [(b["block"], b["k"]) for b in pdf["blocks"].iloc[0]]
        at, k = [b for b, _ in blocks].index(pdf["block"].iloc[0]), np.array([k for _, k in blocks])
        name = list(pdf["stratum"].iloc[0].encode())
        share = np.random.default_rng([seed, *name]).multinomial(k.sum(), k / k.sum(), size=draws)[:, at]
        rng = np.random.default_rng([seed, at + 1, *name])
        sums, n = np.stack(pdf["sums"].to_numpy()), len(pdf)
        chunk = max(1, CELLS // n)
        out = [rng.multinomial(share[i : i + chunk], np.full(n, 1 / n)) @ sums for i in range(0, draws, chunk)]
        return pd.DataFrame({"draw": np.arange(draws), "s": list(np.concatenate(out))})

    parts = placed.join(F.broadcast(plan), "stratum").groupBy("stratum", "block").applyInPandas(draw, "draw int, s array<double>")
    width = parts.select("draw", F.posexplode("s").alias("i", "v")).groupBy("draw", "i").agg(F.sum("v").alias("v"))
    return width.groupBy("draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("s"))


def whole(clusters: DataFrame) -> DataFrame:
    """(draw, s): the sums over all clusters, each once, as draw -1: the point estimates are computed from it."""
    v = clusters.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    return v.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("s")).select(F.lit(-1).alias("draw"), "s")


def ratio(a: int, b: int) -> Column:
    return F.try_divide(F.col("s")[a], F.col("s")[b])


def mean_of(parts: list[Column]) -> Column:
    """The mean of columns, null if one is."""
    return reduce(lambda a, b: a + b, parts) / len(parts)


def intervals(clusters: DataFrame, statistics: dict[str, Column], draws: int = 10_000, seed: int = SEED) -> DataFrame:
    """(name, estimate, low, high, invalid): 95 % percentile intervals of statistics over the sums ``s`` of a draw. A draw
    without a value makes the interval null and is counted."""
    both = resample(clusters, draws, seed).union(whole(clusters))
    long = both.select("draw", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.cast("double").alias("v")) for k, c in statistics.items()])).alias("x")).select("draw", "x.*")
    bad = F.col("v").isNull() | F.isnan("v")
    drawn = F.when(F.col("draw") >= 0, F.col("v"))
    out = long.groupBy("name").agg(F.max(F.when(F.col("draw") < 0, F.col("v"))).alias("estimate"), F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count_if(bad & (F.col("draw") >= 0)).alias("invalid"))
    kept = lambda i: F.when(F.col("invalid") == 0, F.col("q")[i])
    return out.select("name", "estimate", kept(0).alias("low"), kept(1).alias("high"), "invalid")


def contrasts(rows: DataFrame, cluster: str, arms: dict[str, dict[str, Column]], pairs: list[tuple[str, str]], datasets: list[str], draws: int = 10_000, seed: int = SEED, scale: float = 1.0) -> DataFrame:
    """Intervals of differences between arms: EM and F1 by row, NLL by token, for each dataset and as the mean over datasets.
    An arm has columns em, f1, nll and tokens of the same row; averages over runs are as good as single runs."""
    values: dict[str, Column] = {"rows": F.lit(1.0)}
    for a, cols in arms.items():
        values |= {f"{a}:{k}": cols[k] for k in ("em", "f1", "nll", "tokens")}
    at = {k: i for i, k in enumerate(values)}
    clusters = cluster_sums(rows, cluster, "dataset", values, datasets)

    def one(arm: str, metric: str, d: int) -> Column:
        base = d * len(values)
        return ratio(base + at[f"{arm}:{metric}"], base + at[f"{arm}:tokens" if metric == "nll" else "rows"]) * (1.0 if metric == "nll" else scale)

    stats = {}
    for a, b in pairs:
        for m in ("em", "f1", "nll"):
            each = [one(a, m, d) - one(b, m, d) for d in range(len(datasets))]
            stats |= {f"{a}-{b}:{m}:{name}": c for name, c in zip(datasets, each)} | {f"{a}-{b}:{m}:macro": mean_of(each)}
    return intervals(clusters, stats, draws, seed)


def interaction(a11: dict[str, Column], a00: dict[str, Column], a10: dict[str, Column], a01: dict[str, Column]) -> tuple[dict[str, Column], dict[str, Column]]:
    """The two sides of an interaction contrast, to be given to ``contrasts`` as arms: sums of metrics, counts as they are."""
    add = lambda x, y: {k: x[k] if k == "tokens" else x[k] + y[k] for k in x}
    return add(a11, a00), add(a10, a01)


def curve_intervals(rows: DataFrame, cluster: str, points: dict[str, Column], base: Column, draws: int = 2000, seed: int = SEED) -> DataFrame:
    """Intervals of correction and harm (contributions, rates and net) at each point of a curve, pooled over datasets: a
    point is a column with the outcome, 0 or 1, beside ``base``."""
    values = {"n": F.lit(1.0), "right": base.cast("double")}
    for p, c in points.items():
        values |= {f"{p}:correction": ((base == 0) & (c == 1)).cast("double"), f"{p}:harm": ((base == 1) & (c == 0)).cast("double")}
    clusters = rows.groupBy(F.col(cluster).cast("string").alias("cluster")).agg(F.concat_ws("\u0001", F.array_sort(F.collect_set("dataset"))).alias("stratum"), F.array(*[F.sum(v) for v in values.values()]).alias("sums")).select("stratum", "cluster", "sums")
    stats = {}
    for i, p in enumerate(points):
        c, h = 2 + 2 * i, 3 + 2 * i
        s = F.col("s")
        stats |= {f"{p}:correction_contribution": ratio(c, 0), f"{p}:harm_contribution": ratio(h, 0), f"{p}:net_em": F.try_divide(s[c] - s[h], s[0]), f"{p}:correction_rate": F.try_divide(s[c], s[0] - s[1]), f"{p}:harm_rate": ratio(h, 1)}
    return intervals(clusters, stats, draws, seed)


def repair_intervals(rows: DataFrame, cluster: str, datasets: list[str], draws: int = 10_000, seed: int = SEED) -> DataFrame:
    """Intervals of repair, harm and preservation rates and of the differences in EM and F1 between an arm (em, f1, perhaps
    averaged over runs) and the base (base_em, base_f1). A rate whose denominator is empty in a draw has no interval."""
    b, e = F.col("base_em"), F.col("em")
    values = {"wrong": 1 - b, "right": b, "rows": F.lit(1.0), "repaired": (1 - b) * e, "harmed": b * (1 - e), "kept": b * e, "d_em": e - b, "d_f1": F.col("f1") - F.col("base_f1")}
    at = {k: i for i, k in enumerate(values)}
    clusters = cluster_sums(rows, cluster, "dataset", values, datasets)
    rates = {"repair_rate": ("repaired", "wrong"), "harm_rate": ("harmed", "right"), "preservation_rate": ("kept", "right"), "delta_em": ("d_em", "rows"), "delta_f1": ("d_f1", "rows")}
    stats = {}
    for k, (x, y) in rates.items():
        each = [ratio(d * len(values) + at[x], d * len(values) + at[y]) for d in range(len(datasets))]
        stats |= {f"{k}:{n}": c for n, c in zip(datasets, each)} | {f"{k}:macro": mean_of(each)}
    return intervals(clusters, stats, draws, seed)


def crossed_intervals(rows: DataFrame, cluster: str, runs: list[Column], datasets: list[str], draws: int = 10_000, seed: int = SEED, run_seed: int = RUN_SEED) -> DataFrame:
    """Intervals of the mean over datasets of a difference that several runs measure, one column each: over questions, over
    paired runs, and over both, whose weights are drawn apart and multiplied."""
    values = {"rows": F.lit(1.0)} | {str(i): c for i, c in enumerate(runs)}
    clusters = cluster_sums(rows, cluster, "dataset", values, datasets)
    n = len(runs)
    weights = np.random.default_rng(run_seed).multinomial(n, np.full(n, 1 / n), size=draws) / n
    spark = rows.sparkSession
    chosen = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(weights)], "draw int, w array<double>")
    each = [mean_of([ratio(d * len(values) + 1 + r, d * len(values)) for d in range(len(datasets))]) for r in range(n)]
    per = resample(clusters, draws, seed).select("draw", F.array(*each).alias("r")).join(chosen, "draw")
    point = whole(clusters).select(F.array(*each).alias("p"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda u, v: u + v)
    both = per.crossJoin(F.broadcast(point))
    equal = F.array(*[F.lit(1.0 / n)] * n)
    long = both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.alias("v")) for k, c in {"question": dot(F.col("r"), equal), "paired_run": dot(F.col("p"), F.col("w")), "joint": dot(F.col("r"), F.col("w"))}.items()])).alias("x"), dot(F.col("p"), equal).alias("estimate")).select("x.*", "estimate")
    out = long.groupBy("name").agg(F.first("estimate").alias("estimate"), F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count_if(F.col("v").isNull()).alias("invalid"))
    kept = lambda i: F.when(F.col("invalid") == 0, F.col("q")[i])
    return out.select("name", "estimate", kept(0).alias("low"), kept(1).alias("high"), "invalid")


def ternary_intervals(rows: DataFrame, draws: int = 10_000, seed: int = 20260920) -> DataFrame:
    """Intervals of the mean difference of paired 0/1 outcomes (dataset, delta), in points: three counts a dataset are all a
    draw needs. One row for each dataset and one for the mean over them."""
    counts = rows.groupBy("dataset").agg(*[F.count_if(F.col("delta") == v).alias(k) for k, v in (("down", -1), ("same", 0), ("up", 1))])

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, macro, out = np.random.default_rng(seed), np.zeros(draws), []
        pdf = pdf.sort_values("dataset")
        for r in pdf.itertuples():
            k = np.array([r.down, r.same, r.up])
            n = k.sum()
            got = rng.multinomial(n, k / n, size=draws)
            d = (got[:, 2] - got[:, 0]) / n * 100
            macro += d / len(pdf)
            out.append((r.dataset, (k[2] - k[0]) / n * 100, *np.quantile(d, [0.025, 0.975])))
        out.append(("macro", np.mean([x[1] for x in out]), *np.quantile(macro, [0.025, 0.975])))
        return pd.DataFrame(out, columns=["dataset", "delta", "low", "high"])

    return counts.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(draw, "dataset string, delta double, low double, high double")


def binned_intervals(clusters: DataFrame, statistics: dict[str, Column], draws: int = 10_000, seed: int = 20260920) -> DataFrame:
    """As ``intervals`` without strata, where many clusters have equal sums (counts of outcomes): equal ones are one bin, and
    one multinomial over the bins has the same distribution. The bins follow from the values, not from the clusters."""
    bins = clusters.groupBy("sums").agg(F.count("*").alias("k"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        v, k = np.array(sorted(zip(map(tuple, pdf["sums"]), pdf["k"]))[:], dtype=object).T
        v, k = np.array(list(v), float), k.astype(int)
        rng, chunk = np.random.default_rng(seed), max(1, CELLS // len(k))
        out = [rng.multinomial(k.sum(), k / k.sum(), size=min(chunk, draws - i)) @ v for i in range(0, draws, chunk)]
        return pd.DataFrame({"draw": np.arange(-1, draws), "s": [k @ v, *np.concatenate(out)]})

    both = bins.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(draw, "draw int, s array<double>")
    long = both.select("draw", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.cast("double").alias("v")) for k, c in statistics.items()])).alias("x")).select("draw", "x.*")
    drawn = F.when(F.col("draw") >= 0, F.col("v"))
    out = long.groupBy("name").agg(F.max(F.when(F.col("draw") < 0, F.col("v"))).alias("estimate"), F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count_if(F.col("v").isNull() & (F.col("draw") >= 0)).alias("invalid"))
    return out.select("name", "estimate", F.when(F.col("invalid") == 0, F.col("q")[0]).alias("low"), F.when(F.col("invalid") == 0, F.col("q")[1]).alias("high"), "invalid")


def mean_intervals(rows: DataFrame, by: str, value: str, draws: int = 1000, seed: int = 20260903, confidence: float = 0.95) -> DataFrame:
    """(by, mean, low, high): percentile interval of the mean of each group's values, over rows drawn one by one. Equal
    values are one bin, so a group's draw is over its distinct values. The limits are draws of the sorted list: the one at
    the lower share, and the one before that at the upper share."""
    bins = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("k"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(value)
        v, k = pdf[value].to_numpy(float), pdf["k"].to_numpy()
        n, rng, chunk = int(k.sum()), np.random.default_rng(seed), max(1, CELLS // len(k))
        means = np.sort(np.concatenate([rng.multinomial(n, k / n, size=min(chunk, draws - i)) @ v / n for i in range(0, draws, chunk)]))
        low, high = max(0, int((1 - confidence) / 2 * draws)), min(draws - 1, int((1 + confidence) / 2 * draws) - 1)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "mean": [float(k @ v / n)], "low": [means[low]], "high": [means[high]]})

    return bins.groupBy(by).applyInPandas(draw, f"{by} {rows.schema[by].dataType.simpleString()}, mean double, low double, high double")


def cluster_bootstrap(rows: DataFrame, by: str, cluster: str, value: str, draws: int = 10_000, seed: int = SEED) -> DataFrame:
    """(by, mean, low, high) of each group: the mean of ``value`` and its 95 % interval over multinomial draws of whole
    clusters. Clusters are summed first, and those with equal sums and sizes are drawn as one bin. A group's draw is one
    task over its bins, whose number follows from the distinct values and sizes, not from the clusters. Rows without a
    cluster are one cluster."""
    sums = rows.groupBy(by, cluster).agg(F.round(F.sum(value), 9).alias("s"), F.count(value).alias("n"))
    bins = sums.groupBy(by, "s", "n").agg(F.count("*").alias("k"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "n"])
        s, n, k = (pdf[c].to_numpy(float) for c in ("s", "n", "k"))
        rng, out, size = np.random.default_rng(seed), [], int(k.sum())
        chunk = max(1, min(32, CELLS // len(k)))
        for at in range(0, draws, chunk):
            w = rng.multinomial(size, k / k.sum(), size=min(chunk, draws - at))
            out.append((w @ s) / np.maximum(w @ n, 1))
        low, high = np.quantile(np.concatenate(out), [0.025, 0.975])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "mean": [float((k @ s) / (k @ n))], "low": [low], "high": [high]})

    kind = rows.schema[by].dataType.simpleString()
    return bins.groupBy(by).applyInPandas(draw, f"{by} {kind}, mean double, low double, high double")


def point_differences(curves: DataFrame, value: str, *by: str) -> DataFrame:
    """Of draws (method, draw, ``value``) at each method's selected point: (method_a, method_b, low, high), intervals of the
    paired differences b - a of all pairs of methods."""
    a = curves.select(*by, "draw", F.col("method").alias("method_a"), F.col(value).alias("x"))
    b = curves.select(*by, "draw", F.col("method").alias("method_b"), F.col(value).alias("y"))
    both = a.join(b, [*by, "draw"]).where("method_a < method_b")
    return both.groupBy(*by, "method_a", "method_b").agg(F.percentile(F.col("y") - F.col("x"), F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(*by, "method_a", "method_b", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def reproduced(mine: DataFrame, published: DataFrame, key: list[str], columns: list[str], tolerance: float = 2e-11) -> DataFrame:
    """The rows of a published table that a recomputed one doesn't have within the tolerance, which grows with the value."""
    p = published.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    off = [~F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col(f"_{c}"))), F.col(c).isNull() & F.col(f"_{c}").isNull()) for c in columns]
    return p.join(mine.select(*key, *columns), key, "left").where(reduce(lambda a, b: a | b, off)).select(*key)
