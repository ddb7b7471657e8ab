"""Scoring answers against references, and the tables made of the scores."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillarn.functions.arrays import token_f1
from quillarn.functions.text import answer_text, before_question, first_line_answer, regex_search, yes_no, yes_no_prefix
from quillarn.operators.skew import salted_join

METRICS = ("em", "f1", "containment")
CELL = ("dataset", "method", "coefficient")


def exactly_once(df: DataFrame, *key: str) -> DataFrame:
    """``df``, whose key must not come twice: a repeated one raises when it is met."""
    row = df.groupBy(*key).agg(F.first(F.struct(*[c for c in df.columns if c not in key])).alias("_row"), F.count("*").alias("_n"))
    once = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("comes twice:"), *[F.col(k).cast("string") for k in key])))
    return row.select(*key, once.alias("_row")).select(*key, "_row.*").select(*df.columns)


def answers(predictions: DataFrame) -> DataFrame:
    """Each prediction with its answer in the form that is compared."""
    return predictions.select("ordinal", "stable_id", *CELL, answer_text(first_line_answer(F.coalesce("prediction", F.lit("")))).alias("answer"))


def judged(pairs: DataFrame, references: DataFrame) -> DataFrame:
    """``pairs``, which have a ``stable_id`` and an ``answer``, with em, f1 and containment: the best over the aliases of the
    reference; aliases that normalise to nothing count for none. A reference that comes twice raises."""
    refs = exactly_once(references.select("stable_id", "aliases"), "stable_id").select("stable_id", F.filter(F.transform("aliases", answer_text), lambda a: a != "").alias("golds"))
    both = pairs.join(refs, "stable_id").withColumn("tokens", F.filter(F.split("answer", " "), lambda w: w != ""))
    f1 = F.array_max(F.transform("golds", lambda g: token_f1(F.col("tokens"), F.split(g, " "))))
    held = lambda f: F.coalesce(F.exists("golds", f), F.lit(False)).cast("double")
    return both.select(*pairs.columns, held(lambda g: g == F.col("answer")).alias("em"), F.coalesce(f1, F.lit(0.0)).alias("f1"), held(lambda g: F.contains(F.col("answer"), g)).alias("containment"))


def scored(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """The scores of each prediction that has a reference. An answer given again and again is scored once; the rows meet
    their scores on (stable_id, answer), where those of hot keys are salted."""
    rows = answers(predictions)
    distinct = judged(rows.select("stable_id", "answer").distinct(), references)
    return salted_join(rows, distinct, ["stable_id", "answer"], F.col("ordinal")).select("ordinal", "stable_id", *CELL, *METRICS)


def tallied(predictions: DataFrame, references: DataFrame, *more: str) -> DataFrame:
    """(stable_id, dataset, method, coefficient, n, scores): equal answers of a cell to a question as one row that counts
    ``n`` times, so no key is hot when it meets its reference."""
    rows = answers(predictions).groupBy("stable_id", *CELL, "answer").agg(F.count("*").alias("n"))
    return judged(rows, references.select("stable_id", "aliases"))


def weighted(column: str, n: str = "n") -> Column:
    return F.coalesce(F.try_divide(F.sum(F.col(column) * F.col(n)), F.sum(n).cast("double")), F.lit(0.0))


def means(tally: DataFrame, *by: str) -> DataFrame:
    """The number of answers and the means of their scores; 0 where there are none."""
    return tally.groupBy(*by).agg(F.sum("n").alias("n"), *[F.round(weighted(c), 6).alias(c) for c in METRICS])


def missing_and_extra(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """(stable_id, what) of references without a prediction and of predictions without a reference."""
    p, r = predictions.select("stable_id").distinct(), references.select("stable_id").distinct()
    return r.join(p, "stable_id", "left_anti").withColumn("what", F.lit("missing")).union(p.join(r, "stable_id", "left_anti").withColumn("what", F.lit("extra")))


def coverage(tally: DataFrame, references: DataFrame) -> DataFrame:
    """(method, coefficient, scored, total, fraction): how many of the references a setting answers; 0 of none."""
    total = references.agg(F.count("*").alias("total"))
    got = tally.groupBy("method", "coefficient").agg(F.countDistinct("stable_id").alias("scored"))
    return got.crossJoin(F.broadcast(total)).select("method", "coefficient", "scored", "total", F.round(F.coalesce(F.try_divide(F.col("scored").cast("double"), F.col("total").cast("double")), F.lit(0.0)), 6).alias("fraction"))


def pattern_slices(predictions: DataFrame, references: DataFrame, by: str) -> DataFrame:
    """Scores of questions whose answer is a pattern, by a column of the references: how many match the pattern, and the
    scores of those that also have aliases spelled out (null where a slice has none)."""
    refs = references.select("stable_id", "aliases", "answer_regex", by)
    literal = F.coalesce(F.size("aliases"), F.lit(0)) > 0
    told = predictions.select("stable_id", F.coalesce(first_line_answer(F.col("prediction")), F.lit("")).alias("line"), F.lit("").alias("_"), answer_text(first_line_answer(F.coalesce("prediction", F.lit("")))).alias("answer"))
    both = judged(told, refs.select("stable_id", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))).join(refs.withColumn("literal", literal).drop("aliases"), "stable_id")
    hit = regex_search(F.col("line"), F.col("answer_regex")).cast("double")
    rows = both.select(by, "literal", hit.alias("regex_em"), *METRICS)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("regex_em"), 6).alias("regex_em"), F.count_if("literal").alias("literal_count"), *[F.round(F.avg(F.when(F.col("literal"), F.col(m))), 6).alias(f"literal_{m}") for m in METRICS])


def binary_slices(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Scores of the questions answered by yes or no, by method: accuracy of the first word, how many answers begin with yes
    or no, and how many begin rightly and go on."""
    gold = references.select("stable_id", "aliases", yes_no(F.col("answer")).alias("gold")).where("gold is not null")
    rows = answers(predictions).join(gold.select("stable_id", "gold"), "stable_id")
    counted = rows.groupBy("stable_id", "gold", "method", "answer").agg(F.count("*").alias("n"))
    first = yes_no_prefix(F.col("answer"))
    right = F.coalesce(first == F.col("gold"), F.lit(False))
    both = judged(counted, gold).withColumns({"accuracy": right.cast("double"), "covered": first.isNotNull().cast("double"), "overgenerated": (right & (F.col("em") == 0)).cast("double")})
    count = lambda g: F.sum(F.when(F.col("gold") == g, F.col("n")).otherwise(0))
    return both.groupBy("method").agg(F.sum("n").alias("n"), count("yes").alias("yes"), count("no").alias("no"), *[F.round(weighted(c), 6).alias(c) for c in (*METRICS, "accuracy", "covered", "overgenerated")])


def retrieval_means(rows: DataFrame, column: str = "retrieval", *by: str) -> DataFrame:
    """The mean of each metric in a map of metrics."""
    return rows.select(*by, F.explode(column).alias("metric", "value")).groupBy(*by, "metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def undefined_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def transitions(paired: DataFrame, *by: str) -> DataFrame:
    """Counts of (base, final) outcomes, rates over the cases that could change (null where there are none) and
    contributions over all."""
    n = {"correction": (0, 1), "harm": (1, 0), "preserved": (1, 1), "still_wrong": (0, 0)}
    counts = paired.groupBy(*by).agg(*[F.count_if((F.col("base") == b) & (F.col("final") == f)).alias(k) for k, (b, f) in n.items()])
    size = reduce(lambda a, b: a + b, (F.col(k) for k in n))
    ratios = {
        "correction_rate": (F.col("correction"), F.col("correction") + F.col("still_wrong")),
        "harm_rate": (F.col("harm"), F.col("harm") + F.col("preserved")),
        "preservation_rate": (F.col("preserved"), F.col("harm") + F.col("preserved")),
        "correction_contribution": (F.col("correction"), size),
        "harm_contribution": (F.col("harm"), size),
        "net_em": (F.col("correction") - F.col("harm"), size),
        "base_em": (F.col("harm") + F.col("preserved"), size),
        "final_em": (F.col("correction") + F.col("preserved"), size),
    }
    return counts.select(*by, *n, *[F.round(undefined_ratio(*r), 6).alias(k) for k, r in ratios.items()])


def equal_means(cells: DataFrame, columns: list[str], *by: str, members: int | None = None) -> DataFrame:
    """Means over datasets of a table by dataset, each of equal weight; null where one is null, or where there are not as
    many datasets as there must be."""
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.round(F.avg(c), 6))
    out = cells.groupBy(*by).agg(F.count("*").alias("datasets"), *[whole(c).alias(c) for c in columns])
    if members is not None:
        out = out.select(*by, "datasets", *[F.when(F.col("datasets") == members, F.col(c)).alias(c) for c in columns])
    return out


def categories(cells: DataFrame, groups: dict[str, list[str]], columns: list[str], *by: str) -> DataFrame:
    """Means over the datasets of named groups; a mean needs every member."""
    member = F.explode(F.array_compact(F.array(*[F.when(F.col("dataset").isin(m), F.lit(g)) for g, m in groups.items()])))
    size = F.create_map(*[F.lit(x) for g, m in groups.items() for x in (g, len(m))])
    got = cells.select(*by, member.alias("category"), *columns).groupBy(*by, "category")
    return got.agg(*[F.when(F.count(c) == F.element_at(size, F.col("category")), F.round(F.avg(c), 6)).alias(c) for c in columns])


def best_coefficient(cells: DataFrame, *by: str) -> DataFrame:
    """The coefficient of greatest EM, then F1, then least coefficient, in each group of ``by``."""
    order = F.struct(F.round("em", 12), F.round("f1", 12), -F.col("coefficient"))
    return cells.groupBy(*by).agg(F.max_by("coefficient", order).alias("coefficient"))


def midpoints(cells: DataFrame, *by: str) -> DataFrame:
    """The points half-way between the best coefficient and its neighbours in the grid, unless they are in it."""
    from pyspark.sql import Window

    best = best_coefficient(cells, *by).withColumnRenamed("coefficient", "best")
    grid = cells.select(*by, "coefficient").distinct()
    w = Window.partitionBy(*by).orderBy("coefficient")
    beside = grid.select(*by, "coefficient", F.array(F.lag("coefficient").over(w), F.lead("coefficient").over(w)).alias("near")).join(best, list(by)).where("coefficient = best")
    mid = beside.select(*by, F.explode(F.array_compact("near")).alias("near"), "best").select(*by, F.round((F.col("near") + F.col("best")) / 2, 10).alias("coefficient"))
    return mid.join(grid, [*by, "coefficient"], "left_anti")


def scoreboard(rows: DataFrame, choices: dict[str, Column]) -> DataFrame:
    """(name, dataset, n, em, f1, avoided_harm, lost_help, gate_off) of policies over rows with base and res scores:
    ``choices`` says for each policy whether a row takes the second answer. All policies are columns of one pass."""
    picked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(c, F.lit(True)).alias("second")) for k, c in choices.items()]))
    r = rows.withColumn("_p", picked).select("*", "_p.*")
    take = lambda a, b: F.avg(F.when(F.col("second"), F.col(b)).otherwise(F.col(a))) * 100
    off = ~F.col("second")
    return r.groupBy("name", "dataset").agg(
        F.count("*").alias("n"), F.round(take("base_em", "res_em"), 6).alias("em"), F.round(take("base_f1", "res_f1"), 6).alias("f1"),
        F.count_if(off & (F.col("base_em") > F.col("res_em"))).alias("avoided_harm"), F.count_if(off & (F.col("base_em") < F.col("res_em"))).alias("lost_help"), F.count_if(off & F.col("differs")).alias("gate_off"),
    )


def leaderboard(board: DataFrame, meta: DataFrame) -> DataFrame:
    """(rank, name, family, macro_em, macro_f1, complexity): equal-dataset means in the order of EM, F1, simplicity and
    name. ``meta`` is (name, family, complexity); there are fewer policies than rows of a task."""
    from pyspark.sql import Window

    macro = board.groupBy("name").agg(F.round(F.avg("em"), 6).alias("macro_em"), F.round(F.avg("f1"), 6).alias("macro_f1"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("macro_em"), F.desc("macro_f1"), "complexity", "name")
    return macro.join(F.broadcast(meta), "name").select(F.row_number().over(order).alias("rank"), "name", "family", "macro_em", "macro_f1", "complexity")


def family_best(board: DataFrame) -> DataFrame:
    """The first policy of each family in the order of a leaderboard."""
    return board.groupBy("family").agg(F.min_by("name", "rank").alias("name"), F.min("rank").alias("rank"))


def rollout(rows: DataFrame) -> DataFrame:
    """By dataset, of rows (dataset, em, f1, base_em, res_em, gate_events): scores, gains and losses, and what the events
    say. Rows and events are summed apart, as a row has many events."""
    c = F.count_if
    by_row = rows.groupBy("dataset").agg(
        F.count("*").alias("n"), F.round(F.avg("em") * 100, 6).alias("em"), F.round(F.avg("f1") * 100, 6).alias("f1"),
        c(F.col("em") > F.col("res_em")).alias("gains"), c(F.col("em") < F.col("res_em")).alias("losses"),
        c((F.col("base_em") == 1) & (F.col("em") == 0)).alias("base_correct_now_wrong"), c((F.col("base_em") == 0) & (F.col("em") == 1)).alias("base_wrong_now_correct"),
    )
    e = rows.select("dataset", F.explode("gate_events").alias("e")).groupBy("dataset").agg(
        F.count("*").alias("active_steps"), c("e.disagreement").alias("disagreements"), c("e.intervened").alias("interventions"),
        c("e.third_token").alias("third_token_steps"), c(F.col("e.intervened") & F.col("e.stop")).alias("stop_interventions"),
    )
    names = ("active_steps", "disagreements", "interventions", "third_token_steps", "stop_interventions")
    both = by_row.join(e, "dataset", "left").select(*by_row.columns, *[F.coalesce(k, F.lit(0)).alias(k) for k in names])
    return both.withColumn("acceptance_rate", F.round(F.coalesce(undefined_ratio(F.col("interventions"), F.col("disagreements")), F.lit(0.0)), 6))


def mechanisms(rows: DataFrame) -> DataFrame:
    """How the outcomes of base, second and gated answer combine, in counts; the sums agree with a rollout's gains and
    losses."""
    case = lambda b, r, g: F.count_if((F.col("base_em") == b) & (F.col("res_em") == r) & (F.col("em") == g))
    return rows.agg(case(1, 0, 1).alias("prevented_harm"), case(0, 1, 0).alias("lost_corrections"), case(0, 0, 1).alias("both_wrong_gate_correct"), case(1, 1, 0).alias("both_correct_gate_wrong"))


def interventions(rows: DataFrame) -> DataFrame:
    """When events intervene: at the first or a later token, how many disagreements were blocked, and quantiles of entropy
    and weight (null without interventions)."""
    e = rows.select(F.posexplode("gate_events").alias("i", "e")).select("i", "e.*")
    on = F.col("intervened")
    q = lambda c: F.transform(F.percentile(F.when(on, F.col(c)), F.array(*map(F.lit, (0.1, 0.5, 0.9)))), lambda v: F.round(v, 6))
    return e.agg(F.count_if(on & (F.col("i") == 0)).alias("first_token"), F.count_if(on & (F.col("i") > 0)).alias("later_token"), F.count_if(F.col("disagreement") & ~on).alias("blocked"), q("entropy").alias("entropy_quantiles"), q("weight").alias("weight_quantiles"))


def changed(rows: DataFrame) -> DataFrame:
    """The rows whose gated answer scores otherwise than the second one, with the effect."""
    return rows.where(F.col("em") != F.col("res_em")).withColumn("effect", F.when(F.col("em") > F.col("res_em"), "gain").otherwise("loss"))


def improved_everywhere(board: DataFrame, gate: str, fixed: str) -> DataFrame:
    """(macro_better, all_datasets_better) of one policy against another in a scoreboard."""
    g = board.where(F.col("name") == gate).select("dataset", F.col("em").alias("g"))
    f = board.where(F.col("name") == fixed).select("dataset", F.col("em").alias("f"))
    return g.join(f, "dataset").agg((F.avg("g") > F.avg("f")).alias("macro_better"), F.coalesce(F.bool_and(F.col("g") > F.col("f")), F.lit(False)).alias("all_datasets_better"))


def reextracted(predictions: DataFrame, decoded: str, method: str = "memory_decoder") -> DataFrame:
    """``predictions`` in which the answers of one method with a coefficient other than 0 are taken from its decoded output
    again; other answers stay as they are stored."""
    again = (F.col("method") == method) & (F.coalesce("coefficient", F.lit(0.0)) != 0)
    return predictions.withColumn("prediction", F.when(again, before_question(F.col(decoded))).otherwise(F.col("prediction")))


def at_selected(curves: DataFrame, selected: DataFrame) -> DataFrame:
    """The points of curves at each method's selected coefficient (method, coefficient)."""
    return curves.join(F.broadcast(selected.select("method", "coefficient")), ["method", "coefficient"], "left_semi")


def over_runs(cells: DataFrame, columns: list[str], run: str, *by: str) -> DataFrame:
    """Means and sample deviations of metrics over runs, and the number of runs."""
    return cells.groupBy(*by).agg(F.countDistinct(run).alias("runs"), *[F.round(f(c), 6).alias(f"{c}_{k}") for c in columns for k, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def wins(cells: DataFrame, column: str, arm: str, run: str, a: str, b: str) -> DataFrame:
    """How many runs of arm ``a`` beat those of arm ``b``."""
    x = cells.where(F.col(arm) == a).select(run, F.col(column).alias("x"))
    y = cells.where(F.col(arm) == b).select(run, F.col(column).alias("y"))
    return x.join(y, run).agg(F.count("*").alias("runs"), F.count_if(F.col("x") > F.col("y")).alias("wins"))
