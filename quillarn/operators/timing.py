"""Tables of measured requests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.5, 0.25, 0.75)


def request_problems() -> Column:
    """What is wrong with a request (ttft_seconds, decode_seconds, generated_lengths, decode_steps), or null."""
    t, d, n = F.col("ttft_seconds"), F.col("decode_seconds"), F.col("generated_lengths")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return (
        F.when(~finite(t) | ~finite(d) | (t <= 0) | (d < 0), "time")
        .when(n.isNull() | (F.size(n) == 0) | F.exists(n, lambda x: x < 1), "lengths")
        .when((F.col("decode_steps") != F.array_max(n) - 1) | ((F.col("decode_steps") == 0) != (d == 0)), "steps")
    )


def request_metrics(rows: DataFrame) -> DataFrame:
    """``rows`` with what follows from their times and lengths; rates without a denominator are null."""
    n = F.aggregate("generated_lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    d = F.col("decode_seconds")
    r = rows.withColumns({"generated_tokens": n, "elapsed_seconds": F.col("ttft_seconds") + d}).withColumn("decode_generated_tokens", F.col("generated_tokens") - F.size("generated_lengths"))
    return r.withColumns({
        "e2e_tokens_per_second": F.try_divide(F.col("generated_tokens").cast("double"), F.col("elapsed_seconds")),
        "decode_tokens_per_second": F.try_divide(F.col("decode_generated_tokens").cast("double"), d),
        "decode_ms_per_step": F.try_divide(1000 * d, F.col("decode_steps").cast("double")),
        "decode_ms_per_output_token": F.try_divide(1000 * d, F.col("decode_generated_tokens").cast("double")),
    })


def exact_quantiles(values: DataFrame, by: list[str], column: str, at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(by, n, low, high, q): exact, interpolated quantiles of each group without holding a group in memory: values are
    counted, the counts summed in order by two levels, and the two values beside each quantile picked."""
    from pyspark.sql import Window

    k = values.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("k"))
    bounds = k.groupBy(*by).agg(F.min(column).alias("low"), F.max(column).alias("high"), F.sum("k").alias("n"))
    cells = 512
    width = F.greatest((F.col("high") - F.col("low")) / cells, F.lit(1e-300))
    keys = [F.col(f"k.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    joined = k.alias("k").join(F.broadcast(bounds).alias("b"), keys).select(*[F.col(f"k.{c}") for c in by], F.col(f"k.{column}").alias("v"), "k", "low", "high", "n") if by else k.crossJoin(F.broadcast(bounds)).select(F.col(column).alias("v"), "k", "low", "high", "n")
    celled = joined.withColumn("cell", F.least(F.lit(cells - 1), F.floor((F.col("v") - F.col("low")) / width)))
    one = [F.lit(0)] if not by else []
    ahead = celled.groupBy(*by, "cell").agg(F.sum("k").alias("c")).withColumn("ahead", F.sum("c").over(Window.partitionBy(*by, *one).orderBy("cell")) - F.col("c"))
    marks = celled.alias("x").join(F.broadcast(ahead).alias("a"), [F.col(f"x.{c}").eqNullSafe(F.col(f"a.{c}")) for c in [*by, "cell"]])
    inside = Window.partitionBy(*[f"x.{c}" for c in by], "x.cell").orderBy("x.v")
    placed = marks.select(*[F.col(f"x.{c}") for c in by], "x.v", "x.k", "x.low", "x.high", "x.n", (F.col("a.ahead") + F.sum("x.k").over(inside)).alias("last")).withColumn("first", F.col("last") - F.col("k"))
    pick = lambda i: F.max(F.when((F.col("first") <= i) & (i < F.col("last")), F.col("v")))
    aggs = []
    for j, q in enumerate(at):
        p = (F.col("n") - 1) * F.lit(q)
        aggs += [pick(F.floor(p)).alias(f"a{j}"), pick(F.ceil(p)).alias(f"b{j}"), F.max(p - F.floor(p)).alias(f"f{j}")]
    out = placed.groupBy(*by).agg(F.max("n").alias("n"), F.max("low").alias("low"), F.max("high").alias("high"), *aggs).where("n > 0")
    return out.select(*by, "n", "low", "high", F.array(*[F.col(f"a{j}") + (F.col(f"b{j}") - F.col(f"a{j}")) * F.col(f"f{j}") for j in range(len(at))]).alias("q"))


def described(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """(by, n, median, q25, q75, iqr, mad, low, high) of a measure, over its non-null values."""
    keys = list(by)
    q = exact_quantiles(rows, keys, column)
    med = q.select(*keys, F.col("q")[0].alias("_m"))
    values = rows.select(*keys, F.col(column).alias("_v")).where("_v is not null")
    on = [F.col(f"v.{c}").eqNullSafe(F.col(f"m.{c}")) for c in keys]
    both = values.alias("v").join(F.broadcast(med).alias("m"), on).select(*[F.col(f"v.{c}") for c in keys], F.abs(F.col("_v") - F.col("_m")).alias("_d")) if keys else values.crossJoin(F.broadcast(med)).select(F.abs(F.col("_v") - F.col("_m")).alias("_d"))
    d = exact_quantiles(both, keys, "_d", (0.5,)).select(*keys, F.col("q")[0].alias("mad"))
    on = [F.col(f"q.{c}").eqNullSafe(F.col(f"d.{c}")) for c in keys]
    joined = q.alias("q").join(F.broadcast(d).alias("d"), on) if keys else q.alias("q").crossJoin(F.broadcast(d).alias("d"))
    v = lambda i: F.col("q.q")[i]
    return joined.select(*[F.col(f"q.{c}") for c in keys], "q.n", v(0).alias("median"), v(1).alias("q25"), v(2).alias("q75"), (v(2) - v(1)).alias("iqr"), "d.mad", "q.low", "q.high")


def pooled(rows: DataFrame, *by: str) -> DataFrame:
    """Rates over all requests of a group: sums by sums."""
    rate = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b))
    return rows.groupBy(*by).agg(F.count("*").alias("requests"), rate("generated_tokens", "elapsed_seconds").alias("pooled_e2e_tokens_per_second"), rate("decode_generated_tokens", "decode_seconds").alias("pooled_decode_tokens_per_second"))


def overhead(table: DataFrame, base: str, arm: str = "arm", condition: str = "condition") -> DataFrame:
    """A table (arm, condition, total_ms, peak_gib) with what each arm takes beyond the base of the same condition; null where
    the base has none."""
    b = table.where(F.col(arm) == base).select(condition, F.col("total_ms").alias("_t"), F.col("peak_gib").alias("_p"))
    return table.join(b, condition, "left").select(*table.columns, (100 * (F.try_divide(F.col("total_ms"), F.col("_t")) - 1)).alias("overhead_pct"), (F.col("peak_gib") - F.col("_p")).alias("peak_over_base_gib"))
