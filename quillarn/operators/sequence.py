"""Operators over the order of rows: passages, batches, prefixes, schedules, step plans."""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillarn.functions.text import stripped, words
from quillarn.session import cut

#: Rows of a range of an order, about: running values are taken within ranges and over the ranges' totals.
RANGE = 65_536


Cells = Callable[[Column], Column]


def dense_ranges(order: Column) -> Column:
    """The range of an order without gaps that begins near 0."""
    return F.floor(order / RANGE).cast("bigint")


def ranges(df: DataFrame, order: str) -> Cells:
    """What gives an order its range. Where the orders of ``df`` are dense, ranges are of equal width; else they are cut at
    quantiles, so that sparse and hashed orders too make ranges of about ``RANGE`` rows. Reads the column once or twice."""
    n, low, high = df.agg(F.count(order), F.min(order), F.max(order)).first()
    parts = -(-n // RANGE) if n else 1
    if parts == 1:
        return lambda x: F.lit(0).cast("bigint")
    if high - low < 2 * n:
        return lambda x: F.floor((x - low) / RANGE).cast("bigint")
    at = df.agg(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10 * parts)).first()[0]
    bounds = sorted(set(at))

    def cell(x: Column) -> Column:
        # binary search: the number of bounds that aren't above
        cuts, found = F.array(*map(F.lit, bounds)), F.lit(0)
        for k in range(len(bounds).bit_length() - 1, -1, -1):
            found = F.when((found + (1 << k) <= len(bounds)) & (F.get(cuts, found + ((1 << k) - 1)) <= x), found + (1 << k)).otherwise(found)
        return found.cast("bigint")

    return cell


def running(df: DataFrame, value: Column, order: str, to: str, by: list[str] | None = None, biggest: bool = False, cells: Cells | None = None) -> DataFrame:
    """``df`` with ``to``: the sum of ``value`` over all rows of less ``order`` (or the greatest value up to the row itself
    with ``biggest``), in each group of ``by``. ``order`` is numeric and unique in its group. Two levels: a window in each
    range of the order and one over the ranges, whose number is that of the rows by ``RANGE``. ``cells`` gives the ranges if
    they are known; else ``ranges`` looks for them."""
    by = by or []
    r = df.withColumn("_v", value).withColumn("_r", (cells or ranges(df, order))(F.col(order)))
    agg = F.max if biggest else F.sum
    totals = r.groupBy(*by, "_r").agg(agg("_v").alias("_t"))
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(*by, "_r", agg("_t").over(earlier).alias("_a"))
    inside = Window.partitionBy(*by, "_r").orderBy(order)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if biggest else -1)
    r = r.withColumn("_w", agg("_v").over(inside)).join(ahead, [*by, "_r"])
    both = F.greatest("_w", "_a") if biggest else F.coalesce("_w", F.lit(0)) + F.coalesce("_a", F.lit(0))
    return r.withColumn(to, both).drop("_v", "_r", "_w", "_a")


def ranked(df: DataFrame, order: str, by: list[str] | None = None, to: str = "rank") -> DataFrame:
    """``df`` with dense ranks from 0 in each group of ``by``."""
    return running(df, F.lit(1).cast("bigint"), order, to, by)


def unordered(records: DataFrame, order: str = "id") -> DataFrame:
    """The orders that come twice: a strict order has none."""
    return records.groupBy(order).count().where("count > 1")


def passages(records: DataFrame, size: int = 100) -> DataFrame:
    """(id, article, title, passage, text): records (id, title, text, keep and perhaps gap_after) in the order of their ids,
    cut into passages of ``size`` words that never pass from one article to another; ids number the passages, and the text
    is the title's line and the passage. An article goes on while ids follow each other, records are kept, the title is that
    of the record before (stripped), and that one has no gap after it. Ids that come twice and kept records without a title
    raise.

    Articles and word offsets are found on a thin table, which is written once. Each record is then cut at the borders of its article's passages:
    a passage within a record is done at once, only the parts of others are brought together."""
    if unordered(records).limit(1).count():
        raise ValueError("ids must be in strict order")
    gap = F.coalesce(F.col("gap_after"), F.lit(False)) if "gap_after" in records.columns else F.lit(False)
    kept = records.where("keep")
    w = words(F.coalesce("text", F.lit("")))
    title = F.coalesce(stripped(F.col("title")), F.raise_error(F.concat(F.lit("no title: record "), F.col("id").cast("string"))).cast("string"))
    thin = cut(kept.select("id", F.col("title").alias("raw"), title.alias("title"), gap.alias("gap"), F.size(w).cast("bigint").alias("n")), "records")
    cells = ranges(thin, "id")
    before = thin.select((F.col("id") + 1).alias("id"), F.col("title").alias("_before"), (~F.col("gap")).alias("_goes_on"))
    marked = thin.join(before, "id", "left").withColumn("start", F.when(F.coalesce(F.col("_goes_on"), F.lit(False)) & (F.col("raw") == F.col("_before")), None).otherwise(F.col("id")))
    marked = running(marked.select("id", "title", "n", "start"), F.col("start"), "id", "article", biggest=True, cells=cells)
    marked = running(marked, F.col("n"), "id", "ahead", cells=cells)
    bases = marked.where("start is not null").select("article", F.col("ahead").alias("base"))
    sizes = marked.groupBy("article").agg(F.sum("n").alias("words"))
    first = running(sizes.where("words > 0").withColumn("k", F.ceil(F.col("words") / size)), F.col("k"), "article", "first_id", cells=cells).select("article", F.col("words"), "first_id")
    placed = marked.join(bases, "article").join(first, "article").select("id", "article", "title", "words", "first_id", (F.col("ahead") - F.col("base")).alias("at"), "n")
    whole_records = kept.select("id", w.alias("w")).join(placed.where("n > 0"), "id")
    parts = whole_records.select("*", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))).alias("passage"))
    low = F.greatest(F.col("at"), F.col("passage") * size)
    high = F.least(F.col("at") + F.col("n"), (F.col("passage") + 1) * size)
    whole = (high - low) == F.least(F.lit(size).cast("bigint"), F.col("words") - F.col("passage") * size)
    parts = parts.select((F.col("first_id") + F.col("passage")).alias("number"), "article", "title", low.alias("low"), whole.alias("whole"), F.array_join(F.slice("w", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")), " ").alias("text"))
    joined = parts.where("not whole").groupBy("number", "article", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "text"))), lambda p: p["text"]), " ").alias("text"))
    out = parts.where("whole").select("number", "article", "title", "text").unionByName(joined)
    return out.select(F.col("number").cast("string").alias("id"), "article", "title", F.col("text").alias("passage"), F.concat_ws("\n", "title", "text").alias("text"))


def runs(df: DataFrame, order: str, same: str, to: str = "run") -> DataFrame:
    """``df``, whose ``order`` is dense, with the order at which the run of equal ``same`` around a row began."""
    before = df.select((F.col(order) + 1).alias(order), F.col(same).alias("_before"), F.lit(True).alias("_any"))
    start = F.when(F.col("_any") & F.col(same).eqNullSafe(F.col("_before")), None).otherwise(F.col(order))
    return running(df.join(before, order, "left").withColumn("_start", start), F.col("_start"), order, to, biggest=True, cells=dense_ranges).drop("_before", "_any", "_start")


def consecutive_batches(df: DataFrame, order: str, same: str, size: int, to: str = "batch") -> DataFrame:
    """``df``, whose ``order`` is dense, with dense numbers of batches: a new one begins after ``size`` rows of a run of
    equal ``same``, and with each run."""
    r = runs(df, order, same, "_run").withColumn("_first", ((F.col(order) - F.col("_run")) % size == 0).cast("bigint"))
    numbered = running(r, F.col("_first"), order, "_before", cells=dense_ranges)
    return numbered.withColumn(to, F.col("_before") + F.col("_first") - 1).drop("_run", "_first", "_before")


def batch_geometry(batches: DataFrame, workers: int, lengths: dict[str, str], key: str = "stable_id", order: str = "ordinal") -> DataFrame:
    """(batch, rank, dataset, rows, longest of each length, keys, digest): what a batch is made of, its keys in order, and a
    digest of all of that. A batch is as small as the batches' size."""
    keys = F.transform(F.array_sort(F.collect_list(F.struct(order, key))), lambda x: x[key])
    out = batches.groupBy("batch").agg(F.first("dataset").alias("dataset"), F.count("*").alias("rows"), *[F.max(c).alias(k) for k, c in lengths.items()], keys.alias("keys"))
    out = out.withColumn("rank", F.pmod("batch", F.lit(workers)))
    return out.withColumn("digest", F.sha2(F.to_json(F.struct(*sorted(out.columns))), 256))


def block_cyclic(rows: int, size: int, workers: int) -> Column:
    """The worker of an ordinal when blocks of ``size`` are dealt in turn; ``rows`` must be whole blocks."""
    if min(rows, size, workers) <= 0 or rows % size:
        raise ValueError("rows must be whole blocks")
    return F.pmod(F.floor(F.col("ordinal") / size), F.lit(workers))


def jobs(rows: DataFrame, by: str, size: int) -> DataFrame:
    """(by, job, start, rows): blocks of ``size`` of each group in the order of ordinals, named by group and padded start."""
    r = ranked(rows.select(by, "ordinal"), "ordinal", [by], "_k").withColumn("start", F.floor(F.col("_k") / size) * size)
    return r.groupBy(by, "start").agg(F.count("*").alias("rows")).select(by, F.format_string("%s-%06d", by, "start").alias("job"), "start", "rows")


def grid(**axes: list) -> list[dict]:
    """All combinations of a plan's axes, in order."""
    out: list[dict] = [{}]
    for k, values in axes.items():
        out = [c | {k: v} for c in out for v in values]
    return out


def boundaries(resets: DataFrame, start: str, total: int) -> DataFrame:
    """``resets`` with the end of each stretch: the next start, or the total."""
    return resets.withColumn("end", F.lead(start, 1, total).over(Window.partitionBy(F.lit(0)).orderBy(start)))


def not_following(df: DataFrame, order: str) -> DataFrame:
    """The rows whose order isn't the one before plus 1, the least excepted."""
    least = df.agg(F.min(order).alias("_least"))
    return df.join(df.select((F.col(order) + 1).alias(order)), order, "left_anti").crossJoin(F.broadcast(least)).where(F.col(order) != F.col("_least")).drop("_least")


def step_plan(segments: DataFrame, size: int) -> DataFrame:
    """(step, rank, segment, start, end): the segments (rank, segment, n) of each rank laid end to end and cut into steps of
    ``size`` tokens, as many as every rank can fill: each step's part of each segment it meets."""
    s = running(segments, F.col("n"), "segment", "before", ["rank"])
    most = s.groupBy("rank").agg(F.floor(F.sum("n") / size).alias("k")).agg(F.min("k").alias("steps"))
    met = s.where("n > 0").crossJoin(F.broadcast(most)).where("steps > 0")
    last = F.least(F.floor((F.col("before") + F.col("n") - 1) / size), F.col("steps") - 1)
    first = F.floor(F.col("before") / size)
    parts = met.where(first <= last).select("rank", "segment", "before", "n", F.explode(F.sequence(first, last)).alias("step"))
    low, high = F.greatest(F.col("before"), F.col("step") * size), F.least(F.col("before") + F.col("n"), (F.col("step") + 1) * size)
    return parts.select("step", "rank", "segment", (low - F.col("before")).alias("start"), (high - F.col("before")).alias("end"))


def cursor(segments: DataFrame, seen: int) -> DataFrame:
    """(rank, segment, offset) where each rank goes on after ``seen`` tokens: the segment that holds the next one; a rank that
    has none left stands at the end of its last segment."""
    s = running(segments, F.col("n"), "segment", "before", ["rank"])
    here = F.struct(F.col("segment"), (F.lit(seen) - F.col("before")).alias("offset"))
    next_ = F.min(F.when((F.col("before") <= seen) & (F.col("before") + F.col("n") > seen), here))
    last = F.max(F.struct(F.col("segment"), F.col("n").alias("offset")))
    return s.groupBy("rank").agg(F.coalesce(next_, last).alias("c")).select("rank", "c.*")


def resume(rows: DataFrame, base: int, offset: int, order: str = "row_ix") -> DataFrame:
    """The rows of a batch after an offset; the batch must begin at ``base``."""
    first = rows.agg(F.min(order).alias("_first"))
    ok = F.when(F.col("_first") == base, F.lit(True)).otherwise(F.raise_error(F.lit("the pointer isn't where the batch begins")).cast("boolean"))
    return rows.crossJoin(F.broadcast(first)).where(ok & (F.col(order) >= base + offset)).drop("_first")


def normal_position(epoch: int, epoch_step: int, complete: bool, at: dict[str, int]) -> dict:
    """Where a run goes on: in the next epoch from its beginning if one is complete, else at its cursor."""
    kept = {k: (v if k == "rank_seen_tokens" else 0) for k, v in at.items()} if complete else dict(at)
    return {"start_epoch": epoch + bool(complete), "epoch_step": 0 if complete else epoch_step, "cursor": kept}


def fill(candidates: DataFrame, train: int, validation: int, rank: str = "rank", title: str = "title") -> DataFrame:
    """``candidates`` (rank, title, eligible) that were looked at, with ``role``: the first ``train`` eligible ones are for
    training, the next ``validation`` of other titles for validation, the others rejected as ``short`` or by ``title``. What
    ranks behind the last one taken isn't looked at; too few of either raise."""
    e = ranked(candidates.where("eligible"), rank, to="_k").withColumn("_train", F.col("_k") < train)
    end = e.where("_train").agg(F.max(rank).alias("_end"), F.count("*").alias("_n"))
    taken = e.where("_train").select(title).distinct()
    later = candidates.crossJoin(F.broadcast(end)).where(F.col(rank) > F.col("_end")).drop("_n")
    same = later.join(taken, title, "left_semi").withColumn("role", F.lit("title"))
    fresh = later.join(taken, title, "left_anti")
    v = ranked(fresh.where("eligible").drop("_end"), rank, to="_v").where(F.col("_v") < validation)
    stop = v.agg(F.max(rank).alias("_stop"), F.count("*").alias("_m")).crossJoin(end)
    ok = F.when((F.col("_n") == train) & (F.col("_m") == validation), F.lit(True)).otherwise(F.raise_error(F.lit("there are too few candidates")).cast("boolean"))
    cols = candidates.columns
    seen = candidates.where("not eligible").withColumn("role", F.lit("short")).join(same.select(rank), rank, "left_anti")
    out = e.where("_train").withColumn("role", F.lit("training")).select(*cols, "role").union(v.withColumn("role", F.lit("validation")).select(*cols, "role")).union(same.select(*cols, "role")).union(seen.select(*cols, "role"))
    return out.crossJoin(F.broadcast(stop)).where(ok & (F.col(rank) <= F.col("_stop"))).select(*cols, "role")


def permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(position, ordinal): numpy's permutation of ``n`` from a seed. It is made on the driver, 8 bytes an ordinal, as its
    draws can't be made apart."""
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"position": np.arange(n), "ordinal": np.random.default_rng(seed).permutation(n)}))


def held_out(n: int, share: float = 0.002, seed: int = 42) -> np.ndarray:
    """The ordinals kept from training: the first of the permutation, rounded up."""
    return np.random.default_rng(seed).permutation(n)[: math.ceil(n * share)]


def parse_fractions(text: str) -> list[float]:
    """The distinct numbers of a list with commas, in order; each above 0 and at most 1."""
    values = sorted({float(x) for x in text.split(",") if x.strip()})
    if values and not 0 < values[0] <= values[-1] <= 1:
        raise ValueError("fractions lie above 0 and up to 1")
    return values


def parse_seeds(text: str, known: list[int]) -> list[int]:
    """The seeds of a list with commas in the order they are known in, all of them if it is empty; others raise."""
    seeds = [int(x) for x in text.split(",") if x.strip()] or known
    if len(set(seeds)) < len(seeds) or not set(seeds) <= set(known):
        raise ValueError("seeds are distinct known ones")
    return [s for s in known if s in seeds]


def checkpoint_label(epoch: int, fraction: float, complete: bool) -> str:
    """The name of a checkpoint: by the epochs that are complete, or by the part of a pass."""
    if epoch < 0 or not (complete or 0 <= fraction < 1):
        raise ValueError("no place in a run")
    if complete or math.isclose(fraction, 0.0, abs_tol=1e-12):
        done = epoch + bool(complete)
        return f"ep{done}" if done else "pass0"
    return "pass" + f"{fraction:.7f}".rstrip("0").rstrip(".").replace(".", "p")


#: Fractions of a pass a run is kept at.
FRACTIONS = [2.0**-k for k in range(7, -1, -1)]


def short_first(df: DataFrame, tokens: str) -> DataFrame:
    """Rows by their length within each partition, so that batches need little filling."""
    return df.sortWithinPartitions(F.size(tokens))


def spans(rows: DataFrame, tokens: str, size: int = 64) -> DataFrame:
    """``rows`` as one row for each ``size`` tokens, the last may be shorter: (.., span, start, span_ids)."""
    at = F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(size))
    return rows.where(F.size(tokens) > 0).select("*", F.posexplode(at).alias("span", "start")).withColumn("span_ids", F.slice(tokens, F.col("start") + 1, size))


def learning_rate(step: Column, steps: int, warmup: int = 32, peak: float = 5e-4, last: float = 5e-5) -> Column:
    """Linear warm-up to ``peak``, then linear decay that ends at ``last``."""
    return F.when(step <= warmup, peak * step / warmup).when(step >= steps, F.lit(last)).otherwise(peak + (last - peak) * (step - warmup) / (steps - warmup))


def milestones(fractions: list[float], steps: int) -> list[tuple[int, float]]:
    """(step, fraction) of each milestone; of those that fall on one step the largest stays."""
    best: dict[int, float] = {}
    for f in fractions:
        s = max(1, math.ceil(steps * f))
        best[s] = max(f, best.get(s, 0.0))
    return sorted(best.items())
