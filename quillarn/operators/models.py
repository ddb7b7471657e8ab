"""Where models meet tables: their inputs and outputs are columns, and the model itself is made on each worker by a factory.

The engine trains and serves no large model. What it has is the seam: rows go to a model in batches of ordered rows, and
come back with its output; and one small model, the gated feed-forward stack that reads hidden states, in numpy.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[pd.DataFrame], pd.DataFrame]


def applied(rows: DataFrame, factory: Callable[[], Model], columns: list[str], out: str, batch: int = 16, order: str | None = None) -> DataFrame:
    """``rows`` with the columns ``out`` (DDL) a model makes of ``columns``, in batches of ``batch`` rows; rows of a partition
    are first put in an order (a length, say) if one is named. A model that gives another number of rows raises."""
    names = [f.strip().split(" ")[0] for f in _split(out)]
    if clash := set(names) & set(rows.columns):
        raise ValueError(f"there are columns already: {sorted(clash)}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                made = model(part[columns])
                if len(made) != len(part):
                    raise ValueError("a model gave another number of rows")
                yield pd.concat([part.reset_index(drop=True), made[names].reset_index(drop=True)], axis=1)

    src = rows.sortWithinPartitions(order) if order else rows
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return src.mapInPandas(run, f"{schema}, {out}")


def _split(ddl: str) -> list[str]:
    out, depth = [""], 0
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def generated(prompts: DataFrame, factory: Callable[[], Model], batch: int = 16) -> DataFrame:
    """Prompts with the ``prediction`` and ``output_ids`` of a model."""
    return applied(prompts, factory, ["prompt"], "prediction string, output_ids array<int>", batch, "prompt")


def answer_losses(rows: DataFrame, factory: Callable[[], Model], batch: int = 16) -> DataFrame:
    """Prompts and answers with the loss of each token of the answer; ``token_count`` counts them."""
    scored = applied(rows, factory, ["prompt", "answer"], "token_nll array<double>", batch)
    return scored.withColumn("token_count", F.size("token_nll"))


def tokens(rows: DataFrame, column: str, factory: Callable[[], Callable[[list[str]], list[list[int]]]], to: str = "ids") -> DataFrame:
    """``rows`` with the ids a tokenizer gives a text; a null text has none."""

    def make() -> Model:
        encode = factory()
        return lambda b: pd.DataFrame({to: encode([x or "" for x in b[column]])})

    return applied(rows, make, [column], f"{to} array<int>", 1024)


def memory_forward(hidden: np.ndarray, weights: dict[str, np.ndarray], layers: int, eps: float = 1e-5) -> np.ndarray:
    """The logits of the gated stack for hidden states: each layer adds down(silu(gate(x)) * up(x)) of its normed input."""
    norm = lambda x, w: x / np.sqrt((x.astype(np.float32) ** 2).mean(-1, keepdims=True) + eps) * w
    x = hidden.astype(np.float32)
    for i in range(layers):
        w = {k: weights[f"layers.{i}.{k}.weight"] for k in ("input_layernorm", "mlp.gate_proj", "mlp.up_proj", "mlp.down_proj")}
        h = norm(x, w["input_layernorm"])
        gate = h @ w["mlp.gate_proj"].T
        x = x + (gate / (1 + np.exp(-gate)) * (h @ w["mlp.up_proj"].T)) @ w["mlp.down_proj"].T
    return norm(x, weights["norm.weight"]) @ weights["lm_head.weight"].T


def memory_logits(rows: DataFrame, weights: Callable[[], dict[str, np.ndarray]], layers: int, to: str = "memory") -> DataFrame:
    """``rows`` (.., hidden as an array) with the memory's logits."""

    def make() -> Model:
        w = weights()
        return lambda b: pd.DataFrame({to: list(memory_forward(np.stack(b["hidden"].to_numpy()), w, layers).astype("float32"))})

    return applied(rows, make, ["hidden"], f"{to} array<float>", 256)


def initial_tensor(name: str, shape: tuple[int, ...], seed: int, salt: str, spread: float = 0.02) -> np.ndarray:
    """A tensor's first values: ones for norms, else normal ones from a generator of its own, named by salt, seed and name."""
    import hashlib

    if name.endswith("norm.weight"):
        return np.ones(shape, np.float32)
    number = int.from_bytes(hashlib.sha256(f"{salt}|{seed}|{name}".encode()).digest()[:16], "little")
    return np.random.Generator(np.random.PCG64(number)).normal(0, spread, shape).astype(np.float32)


def inventory(parameters: DataFrame) -> DataFrame:
    """(dtype, parameters, bytes) of a table of parameters (name, dtype, numel, bytes), and of all under a null type."""
    return parameters.rollup("dtype").agg(F.sum("numel").alias("parameters"), F.sum("bytes").alias("bytes"))
