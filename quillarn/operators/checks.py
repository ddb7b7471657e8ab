"""Checks of tables. Each gives the rows that break a rule, so that none means all is well; ``insist`` raises if there are
any. Nothing is collected but the first offenders that an error names."""
from __future__ import annotations

import posixpath
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillarn.operators.sequence import learning_rate, running


def insist(offenders: DataFrame, what: str) -> None:
    """Raise with a few of the offenders."""
    some = offenders.limit(3).collect()
    if some:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in some))


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """(key, n) of keys that come more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def outside(df: DataFrame, column: str, known: list) -> DataFrame:
    """(value, n) of values that aren't known."""
    bad = ~F.coalesce(F.col(column).isin(known), F.lit(False))
    return df.where(bad).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def key_difference(mine: DataFrame, expected: DataFrame, *key: str) -> DataFrame:
    """(key, problem): expected keys that are missing, keys nobody expects, and keys that are there more than once. Nulls in
    keys are equal."""
    m = mine.groupBy(*key).agg(F.count("*").alias("_n"))
    e = expected.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct().withColumn("_e", F.lit(True))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key))
    both = m.join(e, on, "full").select(*[F.coalesce(k, f"_{k}").alias(k) for k in key], "_n", "_e")
    why = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_n") > 1, "repeated")
    return both.withColumn("problem", why).where("problem is not null").select(*key, "problem")


def prediction_grid(ids: DataFrame, methods: list[str], coefficients: list[float], base: str = "base") -> DataFrame:
    """(stable_id, method, coefficient) of all answers an experiment needs: the base at 0, each method at every other
    coefficient. The settings are exploded beside each id."""
    cells = [(base, 0.0)] + [(m, float(c)) for m in methods for c in coefficients if c != 0]
    return ids.select("stable_id", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(c).alias("coefficient")) for m, c in cells])).alias("c")).select("stable_id", "c.*")


def filled_grid(rows: DataFrame, methods: list[str], value: str, base: str = "base") -> DataFrame:
    """``rows`` (stable_id, method, coefficient, value) with the base's value at coefficient 0 of every method."""
    shared = rows.where(F.col("method") == base).select("stable_id", F.explode(F.array(*map(F.lit, methods))).alias("method"), F.lit(0.0).alias("coefficient"), value)
    return rows.where((F.col("method") != base) & (F.col("coefficient") != 0)).select("stable_id", "method", "coefficient", value).union(shared)


def counts_off(df: DataFrame, by: str, expected: dict[str, int]) -> DataFrame:
    """(value, n, expected) of groups that haven't as many rows as they should."""
    want = df.sparkSession.createDataFrame(list(expected.items()), f"{by} string, expected bigint")
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    both = n.join(want, by, "full").select(F.col(by).alias("value"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.where("n <> expected")


def positional(a: DataFrame, b: DataFrame, same: list[str], order: str = "ordinal") -> DataFrame:
    """(ordinal, problem): places that only one of two tables has, and places at which columns differ."""
    y = b.select(order, F.struct(*same).alias("_b"))
    both = a.select(order, F.struct(*same).alias("_a")).join(y, order, "full")
    why = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "length").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return both.withColumn("problem", why).where("problem is not null").select(order, "problem")


def differing(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column) of values in which two tables with the same keys differ; keys one of them hasn't, under ``key``."""
    x, y = a.select(key, F.struct(*columns).alias("_a")), b.select(key, F.struct(*columns).alias("_b"))
    both = x.join(y, key, "full")
    alone = F.col("_a").isNull() | F.col("_b").isNull()
    names = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]))
    return both.select(key, F.explode(F.when(alone, F.array(F.lit(key))).otherwise(names)).alias("column"))


def not_subset(part: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of a table that another hasn't as often."""
    return part.exceptAll(of.select(*part.columns))


def unlike_types(a: DataFrame, b: DataFrame) -> list[str]:
    """The columns that two tables haven't both with the same type."""
    x, y = ({f.name: f.dataType for f in d.schema.fields} for d in (a, b))
    return sorted(k for k in x.keys() | y.keys() if x.get(k) != y.get(k))


def exactly_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows in which two tables differ, as often as they do, with the side; types that differ raise."""
    if off := unlike_types(a, b):
        raise ValueError(f"columns differ: {off}")
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def prefix_differs(earlier: DataFrame, rows: DataFrame, order: str = "ordinal") -> DataFrame:
    """The ordinals at which earlier rows aren't those of a later selection, by a digest of all columns."""
    digest = lambda d: d.select(order, F.sha2(F.to_json(F.struct(*sorted(c for c in earlier.columns if c != order)), {"ignoreNullFields": "false"}), 256).alias("_d"))
    both = digest(earlier).join(digest(rows).withColumnRenamed("_d", "_e"), order, "left")
    return both.where(~F.col("_d").eqNullSafe(F.col("_e"))).select(order)


def dense(df: DataFrame, order: str = "ordinal") -> DataFrame:
    """(rows, least, greatest, distinct) of a table whose ordinals aren't 0, 1, ..."""
    s = df.agg(F.count("*").alias("rows"), F.min(order).alias("least"), F.max(order).alias("greatest"), F.countDistinct(order).alias("distinct"))
    return s.where("rows > 0 and not (least = 0 and greatest = rows - 1 and distinct = rows)")


def merged_shards(shards: list[DataFrame], order: str = "ordinal") -> DataFrame:
    """Shards as one table; together their ordinals must be 0, 1, ... without gaps or repeats."""
    rows = reduce(DataFrame.unionByName, shards)
    insist(dense(rows, order), "the shards don't make a whole")
    return rows


def off_plan(rows: DataFrame, plan: DataFrame, rank: int, columns: list[str], order: str = "place") -> DataFrame:
    """(place, problem): where a worker's rows aren't the plan's rows for its rank, in order."""
    mine = running(plan.where(F.col("rank") == rank), F.lit(1).cast("bigint"), "ordinal", order)
    return positional(rows, mine, columns, order)


def distribution_problems(rows: DataFrame, ids: str, probs: str, vocabulary: int, tolerance: float = 2e-6) -> Column:
    """What is wrong with a sparse distribution, or null: ids outside the vocabulary or there twice, probabilities that
    aren't finite or are negative, a sum that isn't 1."""
    i, p = F.col(ids), F.col(probs)
    total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    return (
        F.when(F.exists(i, lambda x: (x < 0) | (x >= vocabulary)) | (F.size(F.array_distinct(i)) < F.size(i)), "support")
        .when(F.exists(p, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0)), "probability")
        .when(F.abs(total - 1) > tolerance, "sum")
    )


def encoded_problems(prompt: Column, gold: Column, vocabulary: int, longest_prompt: int = 384, longest_gold: int = 71) -> Column:
    """What is wrong with encoded prompts and answers, or null: lengths and ids."""
    off = lambda x: F.exists(x, lambda t: (t < 0) | (t >= vocabulary))
    return F.when((F.size(prompt) <= 0) | (F.size(prompt) > longest_prompt), "prompt length").when((F.size(gold) <= 0) | (F.size(gold) > longest_gold), "answer length").when(off(prompt) | off(gold), "ids")


def trace_problems(trace: DataFrame, steps: int, batch: int = 256, sample_every: int = 64) -> DataFrame:
    """(step, problem) of a training trace: steps that are missing, extra or repeated, positions and rates off the schedule,
    figures that aren't finite, samples that are or aren't there."""
    expected = trace.sparkSession.range(1, steps + 1).select(F.col("id").alias("step"))
    keys = key_difference(trace, expected, "step")
    finite = reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("loss", "kl", "ce")))
    why = (
        F.when(F.col("positions_seen") != F.col("step") * batch, "positions")
        .when(F.abs(F.col("lr") - learning_rate(F.col("step"), steps)) > 1e-15, "rate")
        .when(~finite, "figures")
        .when((F.col("step") % sample_every == 0) != F.col("sampled"), "sample")
    )
    return keys.union(trace.select("step", why.alias("problem")).where("problem is not null"))


def bundle_problems(rows: DataFrame) -> DataFrame:
    """(stable_id, problem) of stored answers (em, f1, token_nll, gold_count) beside scores computed afresh (fresh_em,
    fresh_f1): scores that differ, and losses that aren't finite, are negative or not one for each token."""
    nll = F.col("token_nll")
    why = (
        F.when((F.abs(F.col("em") - F.col("fresh_em")) > 1e-12) | (F.abs(F.col("f1") - F.col("fresh_f1")) > 1e-12), "score")
        .when(nll.isNull() | (F.size(nll) != F.col("gold_count")), "length")
        .when(F.exists(nll, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf"))), "loss")
    )
    return rows.select("stable_id", why.alias("problem")).where("problem is not null")


def first_difference_problems(rows: DataFrame, end: int) -> DataFrame:
    """(stable_id, problem) of pairs of outputs (base_ids, res_ids, first_difference with position, base_token, res_token and
    prefix_ids): without a difference the outputs must be equal; with one they agree before it and have its tokens there,
    an output's end being the token ``end``."""
    close = lambda c: F.concat(F.col(c), F.array(F.lit(end)))
    d = F.col("first_difference")
    k = d["position"] - 1
    begins = lambda c: F.slice(close(c), F.lit(1), k.cast("int")) == d["prefix_ids"]
    there = lambda c, t: F.get(close(c), k.cast("int")) == d[t]
    good = begins("base_ids") & begins("res_ids") & there("base_ids", "base_token") & there("res_ids", "res_token")
    why = F.when(d.isNull(), F.when(F.col("base_ids") != F.col("res_ids"), "unmarked")).when(~F.coalesce(good, F.lit(False)), "mismatch")
    return rows.select("stable_id", why.alias("problem")).where("problem is not null")


def one_shot_mismatches(rows: DataFrame, second: Column) -> DataFrame:
    """The ids whose output isn't the one the policy's decision picks."""
    expected = F.when(second, F.col("res_ids")).otherwise(F.col("base_ids"))
    return rows.where(~F.col("output_ids").eqNullSafe(expected)).select("stable_id")


def assembled(parts: DataFrame, expected: DataFrame, *key: str) -> DataFrame:
    """``parts``, whose keys must be exactly the expected ones, each once."""
    insist(key_difference(parts, expected, *key), "the parts aren't the expected ones")
    return parts


def slot_problems(rows: DataFrame, expected: DataFrame, slots: int, key: str = "index") -> DataFrame:
    """(key, problem) of rows that several slots wrote: keys missing, extra or there twice, and rows of a slot that isn't the
    key's."""
    foreign = rows.where(F.col("slot") != F.pmod(key, F.lit(slots))).select(key, F.lit("foreign").alias("problem"))
    return key_difference(rows, expected, key).union(foreign)


def binding_problems(freeze: dict, run: dict, pinned: list[str]) -> list[str]:
    """What keeps a run from counting as one of a frozen candidate: another digest or setting, or a start before the freeze
    or after its own end."""
    off = [k for k in ("candidate", "freeze_sha256", *pinned) if freeze.get(k) != run.get(k)]
    if not freeze["frozen_at"] <= run["started_at"] < run["completed_at"]:
        off.append("order")
    return off


def unsafe(path: str) -> bool:
    """Whether a relative path could leave its folder."""
    return path.startswith("/") or ".." in path.split("/") or posixpath.normpath(path) != path or path in {"", "."}
