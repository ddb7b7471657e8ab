"""Selection policies: validated trees compiled to one column, candidates for a search, and fitted logistic models."""
from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillarn.functions.arrays import sigmoid

# The features of policies and their sets.
FEATURES = ["entropy", "pmax", "margin", "fused_entropy", "fused_pmax", "fused_margin", "candidate_base_gap", "residual_advantage", "overshoot", "candidate_logrank", "residual_std", "entropy_change", "lambda", "position", "first_entropy", "base_stop", "res_stop", "prefix_nonempty", "prefix_words", "prefix_chars", "prefix_numeric", "question_words"]
BASIC = ["entropy", "pmax", "margin", "position", "first_entropy", "base_stop", "prefix_nonempty", "prefix_words", "prefix_numeric"]
EXTRA = ["year_dash"]
ENTROPIES = [0, 0.5, 1, 1.5, 2, 2.5, 3, 4]
SINGLE = ["pmax", "margin", "fused_pmax", "fused_margin", "candidate_base_gap", "residual_advantage", "overshoot", "candidate_logrank", "entropy_change"]
CUTS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
PENALTIES, THRESHOLDS = [0.001, 0.01, 0.1, 1, 10], [0.25, 0.35, 0.45, 0.5, 0.55, 0.65, 0.75]


def feature_columns(feature_set: str, of=F.col) -> list[Column]:
    """The vector of a feature set, as columns; nothing but its own features enters it."""
    f = {k: of(k).cast("double") for k in FEATURES}
    plain = [f[k] for k in (BASIC if feature_set == "basic" else FEATURES)]
    if feature_set != "interactions":
        return plain
    stop, first = f["base_stop"] * f["prefix_nonempty"], (f["position"] == 1).cast("double")
    return [*plain, stop, stop * f["entropy"], stop * f["fused_margin"], stop * f["prefix_words"], f["entropy"] * f["fused_margin"], first, first * f["entropy"], f["pmax"] * f["overshoot"]]


SIZES = {"basic": len(BASIC), "rich": len(FEATURES), "interactions": len(FEATURES) + 8}


def threshold(field: str, value: float, op: str = "ge") -> dict:
    return {"kind": "threshold", "field": field, "threshold": float(value), "op": op}


def _number(x, low: float = -math.inf, high: float = math.inf) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and low <= x <= high


def _fits_model(s: dict) -> bool:
    n = SIZES.get(s.get("feature_set"))
    lists = [s.get(k, ()) for k in ("coef", "mean", "scale")]
    return n is not None and all(len(x) == n and all(map(_number, x)) for x in lists) and all(v > 0 for v in s["scale"]) and _number(s.get("intercept")) and _number(s.get("threshold"), 0, 1)


# What a kind of policy must have, and which of its fields are policies themselves.
RULES = {
    "constant": (lambda s: _number(s.get("value"), 0, 1), ()),
    "threshold": (lambda s: s.get("field") in FEATURES + EXTRA and s.get("op") in {"ge", "le"} and _number(s.get("threshold")), ()),
    "all": (lambda s: bool(s.get("rules")), ("rules",)),
    "any": (lambda s: bool(s.get("rules")), ("rules",)),
    "stop_guard": (lambda s: _number(s.get("threshold")), ("otherwise",)),
    "position": (lambda s: True, ("first", "later")),
    "hybrid": (lambda s: True, ("route", "guard")),
    "soft_entropy": (lambda s: _number(s.get("threshold")) and _number(s.get("temperature")) and s["temperature"] > 0 and _number(s.get("floor", 0), 0, 1), ()),
    "logistic": (_fits_model, ()),
}


def validate(spec: dict) -> None:
    """Raise for anything that is no policy."""
    ok, inside = RULES.get(spec.get("kind"), (lambda s: False, ()))
    if not ok(spec):
        raise ValueError(f"not a policy: {spec}")
    for field in inside:
        for part in spec.get(field) if field == "rules" else [spec.get(field) or {}]:
            validate(part)


def compile_policy(spec: dict, of=F.col) -> Column:
    """The weight of a policy, between 0 and 1; every feature it reads must be non-null. A hybrid policy has a state (its
    route is frozen at the first disagreement): ``hybrid_weights`` runs it over the events of a text."""
    validate(spec)
    kind = spec["kind"]
    if kind == "constant":
        return F.lit(float(spec["value"]))
    if kind == "threshold":
        x = of(spec["field"])
        return (x >= spec["threshold"] if spec["op"] == "ge" else x <= spec["threshold"]).cast("double")
    if kind in {"all", "any"}:
        parts = [compile_policy(r, of) for r in spec["rules"]]
        return parts[0] if len(parts) == 1 else (F.least if kind == "all" else F.greatest)(*parts)
    if kind == "stop_guard":
        stops = (of("base_stop") != 0) & (of("prefix_nonempty") != 0)
        return F.when(stops, (of("entropy") >= spec["threshold"]).cast("double")).otherwise(compile_policy(spec["otherwise"], of))
    if kind == "position":
        return F.when(of("position") == 1, compile_policy(spec["first"], of)).otherwise(compile_policy(spec["later"], of))
    if kind == "soft_entropy":
        floor = spec.get("floor", 0.0)
        return floor + (1 - floor) * sigmoid((of("entropy") - spec["threshold"]) / spec["temperature"])
    if kind == "logistic":
        score = F.lit(float(spec["intercept"]))
        for x, c, m, s in zip(feature_columns(spec["feature_set"], of), spec["coef"], spec["mean"], spec["scale"]):
            score = score + (x - m) / s * c
        return (sigmoid(score) >= spec["threshold"]).cast("double")
    raise ValueError("a hybrid policy needs the events of a text")


def one_shot(spec: dict, differs: Column, of=F.col) -> Column:
    """Whether a row takes the second answer: yes if the two don't differ, else by the policy at the first difference."""
    return F.when(differs, compile_policy(spec, of) >= 0.5).otherwise(F.lit(True))


def hybrid_weights(spec: dict, events: Column) -> Column:
    """The weights of a hybrid or one-shot policy along the events of a text, each with the features, ``active`` and
    ``disagreement``: the route is taken at the first active disagreement and kept; before it the weight is 1."""
    validate(spec)
    route = spec["route"] if spec["kind"] == "hybrid" else spec

    def step(state: Column, e: Column) -> Column:
        of = lambda k: e[k]
        decide = F.when(state["route"].isNull() & e["disagreement"] & e["active"], (compile_policy(route, of) >= 0.5).cast("double")).otherwise(state["route"])
        w = F.coalesce(decide, F.lit(1.0))
        if spec["kind"] == "hybrid":
            w = w * compile_policy(spec["guard"], of)
        return F.struct(decide.alias("route"), F.concat(state["weights"], F.array(w)).alias("weights"))

    start = F.struct(F.lit(None).cast("double").alias("route"), F.array().cast("array<double>").alias("weights"))
    return F.aggregate(events, start, step, lambda s: s["weights"])


def cuts(rows: DataFrame, fields: list[str], at: list[float] = CUTS) -> dict[str, list[float]]:
    """Distinct quantiles of features, in order."""
    row = rows.agg(*[F.array_sort(F.array_distinct(F.percentile(f, F.array(*map(F.lit, at))))).alias(f) for f in fields]).first()
    return {f: list(row[f] or []) for f in fields}


def candidates(fit: DataFrame, fields: list[str] = SINGLE) -> dict[str, dict]:
    """name -> {spec, family, mode} of the rule policies of a search. ``fit`` has the features at first differences; what is
    read from it are quantiles."""
    out: dict[str, dict] = {}

    def add(name: str, spec: dict, family: str) -> None:
        if name in out:
            raise ValueError(f"two policies are named {name}")
        out[name] = {"spec": spec, "mode": "oneshot", "family": family}

    add("fixed_res", {"kind": "constant", "value": 1}, "control")
    add("base", {"kind": "constant", "value": 0}, "control")
    for h in ENTROPIES:
        high = threshold("entropy", h)
        add(f"entropy-{h}", high, "entropy")
        add(f"first-entropy-{h}", threshold("first_entropy", h), "first_entropy")
        for gap in (0.1, 0.25, 0.5, 1, 2):
            for kind in ("all", "any"):
                add(f"H-{h}-fusedmargin-{gap}-{kind}", {"kind": kind, "rules": [high, threshold("fused_margin", gap)]}, "entropy_fused_margin")
        for margin in (0.25, 0.5, 1, 2, 4):
            add(f"H-{h}-margin-{margin}", {"kind": "all", "rules": [high, threshold("margin", margin, "le")]}, "entropy_base_margin")
        for stop in [*ENTROPIES, 99]:
            add(f"H-{h}-stop-{stop}", {"kind": "stop_guard", "threshold": stop, "otherwise": high}, "stop_guard")
        for later in ENTROPIES:
            add(f"first-H-{h}-later-H-{later}", {"kind": "position", "first": high, "later": threshold("entropy", later)}, "position_entropy")
    for field, values in cuts(fit, fields).items():
        for i, v in enumerate(values):
            for op in ("ge", "le"):
                add(f"{field}-{op}-{i}", threshold(field, v, op), "single_confidence")
    return out


def fit_logistic(rows: DataFrame, feature_set: str, penalty: float, label: str = "res_em", weight: str = "weight") -> dict:
    """A logistic policy (but for its threshold) fitted on rows whose outcomes differ: features by their mean and population
    deviation (1 where that is next to nothing), weights summing to 1, the penalty's half on the squared coefficients."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = [f"x{i}" for i in range(SIZES[feature_set])]
    x = rows.select(F.col(label).cast("double").alias("label"), F.col(weight).alias("w"), *[c.alias(n) for c, n in zip(feature_columns(feature_set), names)])
    s = x.agg(F.sum("w").alias("w"), *[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)], *[F.stddev_pop(n).alias(f"d{i}") for i, n in enumerate(names)]).first()
    mean = [s[f"m{i}"] for i in range(len(names))]
    scale = [d if (d := s[f"d{i}"]) >= 1e-8 else 1.0 for i in range(len(names))]
    ready = x.select("label", (F.col("w") / s.w).alias("w"), *[((F.col(n) - m) / d).alias(n) for n, m, d in zip(names, mean, scale)])
    model = LogisticRegression(weightCol="w", regParam=float(penalty), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-12).fit(VectorAssembler(inputCols=names, outputCol="features").transform(ready))
    return {"kind": "logistic", "feature_set": feature_set, "mean": mean, "scale": scale, "coef": [float(c) for c in model.coefficients], "intercept": float(model.intercept), "penalty": penalty}


def fitted(rows: DataFrame, sets: tuple[str, ...] = ("basic", "rich", "interactions"), penalties: list[float] = PENALTIES) -> dict[str, dict]:
    """Logistic candidates of all feature sets, penalties and thresholds; ``rows`` are those whose outcomes differ, with the
    reciprocal size of their dataset as weight."""
    out = {}
    for s in sets:
        for p in penalties:
            model = fit_logistic(rows, s, p)
            out |= {f"logistic-{s}-{p}-{t}": {"spec": model | {"threshold": t}, "mode": "oneshot", "family": "logistic"} for t in THRESHOLDS}
    return out


def complexity(spec: dict) -> int:
    """The length of a policy as JSON."""
    return len(json.dumps(spec))


def sealed(policies: DataFrame, expected: DataFrame, key: list[str], grid: list[float]) -> DataFrame:
    """(key, problem) of what keeps a set of chosen coefficients from being sealed: keys that are missing, extra or there
    twice, and coefficients outside the grid."""
    p = policies.groupBy(*key).agg(F.count("*").alias("_n"), F.min("coefficient").alias("_c"))
    both = p.join(expected.select(*key, F.lit(True).alias("_e")), key, "full")
    why = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_n") > 1, "twice").when(~F.coalesce(F.col("_c").isin(grid), F.lit(False)), "outside the grid")
    return both.withColumn("problem", why).where("problem is not null").select(*key, "problem")
