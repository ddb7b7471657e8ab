"""Arithmetic over array columns."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, also where ``f`` uses it for each element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def log_softmax(x: Column) -> Column:
    def shifted(v: Column) -> Column:
        return let(F.array_max(v), lambda top: let(F.log(total(F.transform(v, lambda e: F.exp(e - top)))) + top, lambda norm: F.transform(v, lambda e: e - norm)))

    return let(x, shifted)


def entropy(logp: Column) -> Column:
    return -total(F.transform(logp, lambda v: F.exp(v) * v))


def mixture(a: Column, b: Column, weight: float) -> Column:
    """log((1 - weight) exp a + weight exp b), element by element."""
    if weight <= 0:
        return a
    if weight >= 1:
        return b
    u, v = math.log1p(-weight), math.log(weight)
    return F.zip_with(a, b, lambda x, y: F.greatest(x + u, y + v) + F.log1p(F.exp(-F.abs((x + u) - (y + v)))))


def multiset_overlap(p: Column, g: Column) -> Column:
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_intersect(p, g), F.lit(0), lambda a, x: a + F.least(count(p, x), count(g, x)))


def token_f1(p: Column, g: Column) -> Column:
    """F1 of two bags of words; 1 for two empty ones, 0 for one."""
    n = multiset_overlap(p, g).cast("double")
    f1 = F.try_divide(2 * n, (F.size(p) + F.size(g)).cast("double"))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(f1)


def first_difference(a: Column, b: Column) -> Column:
    """The first place, from 0, where two sequences differ; null if they don't. A sequence's end differs from any element."""
    n = F.least(F.size(a), F.size(b))
    at = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x != y), True)
    return F.when(at > 0, at - 1).when(F.size(a) != F.size(b), n.cast("bigint"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))


def softmax(x: Column) -> Column:
    return F.transform(log_softmax(x), F.exp)


def logsumexp(x: Column) -> Column:
    return let(F.array_max(x), lambda top: F.log(total(F.transform(x, lambda e: F.exp(e - top)))) + top)


def sparse_objective(logits: Column, ids: Column, probs: Column, gold: Column, alpha: float) -> tuple[Column, Column, Column]:
    """(loss, KL, CE) of logits against a distribution over some ids and a gold id: alpha KL + (1 - alpha) CE."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    logp = log_softmax(logits)
    at = lambda i: F.element_at(logp, (i + 1).cast("int"))
    kl = total(F.zip_with(ids, probs, lambda i, q: q * (F.log(F.greatest(q, F.lit(1e-30))) - at(i))))
    ce = -at(gold)
    return alpha * kl + (1 - alpha) * ce, kl, ce


def logit_drift(a: Column, b: Column) -> dict[str, Column]:
    """How far logits ``b`` are from ``a``: the greatest difference, squares for the relative length of the difference, the
    divergence, and whether the same id is first."""
    p, q = log_softmax(a), log_softmax(b)
    square = lambda x: total(F.transform(x, lambda v: v * v))
    return {
        "max_abs": F.array_max(F.zip_with(a, b, lambda x, y: F.abs(y - x))),
        "d2": square(F.zip_with(a, b, lambda x, y: y - x)),
        "a2": square(a),
        "kl": total(F.zip_with(p, q, lambda x, y: F.exp(x) * (x - y))),
        "top1_equal": F.array_position(a, F.array_max(a)) == F.array_position(b, F.array_max(b)),
    }


def sequence_drift(a: Column, b: Column) -> dict[str, Column]:
    """How two sequences agree: the common beginning, where they first differ (null if nowhere), places that agree, the
    longer length, and the difference of lengths."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    off = F.array_position(same, False)
    prefix = F.when(off > 0, off - 1).otherwise(n.cast("bigint"))
    return {
        "identical": a == b,
        "common_prefix": prefix,
        "first_difference": F.when(a != b, prefix),
        "agreed": F.size(F.filter(same, lambda x: x)),
        "longest": F.greatest(F.size(a), F.size(b)),
        "length_delta": F.size(b) - F.size(a),
    }


def variance(x: Column) -> Column:
    """The unbiased variance."""
    mean = total(x) / F.size(x)
    return F.try_divide(let(mean, lambda m: total(F.transform(x, lambda v: (v - m) * (v - m)))), (F.size(x) - 1).cast("double"))


def decision_features(base: Column, memory: Column, weight: float) -> dict[str, Column]:
    """What a policy sees of two sets of logits: entropies, greatest probabilities and margins of the base and of the fused
    logits, the candidate's gap, its advantage by the memory, by how much that overshoots, its rank and the spread."""
    fused = F.zip_with(base, memory, lambda b, m: b + weight * m)
    first = lambda x: F.array_position(x, F.array_max(x)).cast("int")
    margin = lambda x: let(F.sort_array(x, asc=False), lambda s: s[0] - s[1])
    b, c = first(base), first(fused)
    gap = F.element_at(base, b) - F.element_at(base, c)
    advantage = weight * (F.element_at(memory, c) - F.element_at(memory, b))
    lp, fp = log_softmax(base), log_softmax(fused)
    h, fh = entropy(lp), entropy(fp)
    return {
        "entropy": h, "pmax": F.exp(F.array_max(lp)), "margin": margin(base),
        "fused_entropy": fh, "fused_pmax": F.exp(F.array_max(fp)), "fused_margin": margin(fused),
        "candidate_base_gap": gap, "residual_advantage": advantage, "overshoot": (advantage - gap) / (gap + 0.25),
        "candidate_logrank": F.log((F.size(F.filter(base, lambda v: v > F.element_at(base, c))) + 1).cast("double")),
        "residual_std": F.sqrt(variance(memory)) * weight, "entropy_change": fh - h,
        "base_token": b - 1, "res_token": c - 1, "disagreement": b != c,
    }


def top_distribution(logits: Column, k: int = 64) -> Column:
    """The ``k`` most likely ids with their probabilities, which sum to 1; ties by id."""
    ranked = F.array_sort(F.transform(softmax(logits), lambda p, i: F.struct((-p).alias("m"), i.alias("id"))))
    top = F.slice(ranked, 1, k)
    return let(top, lambda t: let(-total(F.transform(t, lambda e: e["m"])), lambda mass: F.transform(t, lambda e: F.struct(e["id"].alias("id"), (-e["m"] / mass).alias("p")))))


def bf16_finite(bits: Column) -> Column:
    """Whether no number of 16-bit patterns (the upper halves of floats) is infinite or NaN."""
    return F.forall(bits, lambda b: b.cast("int").bitwiseAND(F.lit(0x7F80)) != 0x7F80)


def bf16_values(bits: Column) -> Column:
    """The numbers 16-bit patterns stand for."""
    def value(b: Column) -> Column:
        i = b.cast("int").bitwiseAND(F.lit(0xFFFF))
        sign = F.when(i.bitwiseAND(F.lit(0x8000)) != 0, -1.0).otherwise(1.0)
        e, m = F.shiftright(i.bitwiseAND(F.lit(0x7F80)), 7), i.bitwiseAND(F.lit(0x7F)).cast("double")
        normal = F.pow(F.lit(2.0), (e - 127).cast("double")) * (1 + m / 128)
        special = F.when(m == 0, F.lit(math.inf)).otherwise(F.lit(math.nan))
        return sign * F.when(e == 255, special).when(e == 0, F.pow(F.lit(2.0), F.lit(-133.0)) * m).otherwise(normal)

    return F.transform(bits, value)


def even_indices(n: int, size: Column) -> Column:
    """``n`` indices (or ``size``, if that is less) spread evenly from the first to the last of ``size``."""
    k = F.least(F.lit(n), size)
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * (size - 1) / F.greatest(F.lit(1), k - 1)).cast("int"))


def cyclic(ids: Column, length: int, first: int) -> Column:
    """``first``, then a sequence again and again, ``length`` in all."""
    rounds = F.ceil(F.lit(length) / F.size(ids)).cast("int")
    return F.concat(F.array(F.lit(first)), F.slice(F.flatten(F.array_repeat(ids, rounds)), 1, length - 1))


def prompt_and_answer(prompt: Column, answer: Column, most: int, bos: int) -> dict[str, Column]:
    """A prompt cut at its beginning, but for a first ``bos``, so that it and the answer have at most ``most`` tokens; with
    the positions that predict the answer. Empty prompts and answers without room raise."""
    room = F.lit(most) - F.size(answer)
    bad = (F.size(prompt) == 0) | (F.size(answer) == 0) | (room <= 0)
    last = lambda x, n: F.slice(x, F.size(x) - n + 1, n)
    keeps = prompt[0] == bos
    cut = F.when(F.size(prompt) <= room, prompt).when(keeps, F.concat(F.array(prompt[0]), last(prompt, room - 1))).otherwise(last(prompt, room))
    kept = F.when(bad, F.raise_error(F.lit("there is no prompt, no answer or no room")).cast("array<int>")).otherwise(cut)
    n = F.size(kept)
    return {"input_ids": F.concat(kept, answer), "prompt_length": n, "positions": F.sequence(n - 1, n + F.size(answer) - 2)}


def padded(ids: Column, length: Column, fill: int = 0) -> tuple[Column, Column]:
    """(ids, mask) filled at the left."""
    more = length - F.size(ids)
    return F.concat(F.array_repeat(F.lit(fill), more), ids), F.concat(F.array_repeat(F.lit(0), more), F.array_repeat(F.lit(1), F.size(ids)))


def parameter_count(depth: int, hidden: int, inner: int, vocabulary: int) -> int:
    """Parameters of a stack of gated layers with norms, and a head."""
    return depth * (3 * hidden * inner + hidden) + hidden + vocabulary * hidden
