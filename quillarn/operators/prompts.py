"""Prompts packed from ranked documents under a budget of tokens, and training records made of passages.

Tokens are counted by a function of a list of texts, made on each worker by a factory, so any tokenizer can be plugged in;
``count_words`` counts words between white space. A question's documents are one row, at most the few a prompt shows.
"""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillarn.functions.text import answer_text, stripped, token_digest, weak_key
from quillarn.operators.checks import encoded_problems
from quillarn.operators.models import tokens
from quillarn.operators.normalise import PROMPTS, prompt

Counter = Callable[[list[str]], list[int]]
# The parts of a prompt with evidence.
PREAMBLE = "Use the retrieved evidence to answer the question."
INSTRUCTIONS = PROMPTS["concise-format-v1"].split("\n\nQuestion:", 1)[0]
NO_EVIDENCE = "[1] No retrieved evidence."
PACKED = "prompt string, prompt_tokens int, visible_documents array<struct<doc_id:string,text:string>>, prompt_truncated boolean"


def count_words() -> Counter:
    return lambda texts: [len(t.split()) for t in texts]


def library_tokens(path: str) -> Callable[[], Counter]:
    """Counts by a tokenizer file of the ``tokenizers`` library."""

    def make() -> Counter:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts)]

    return make


def rendered(question: str, lines: list[str]) -> str:
    return "\n".join([PREAMBLE, INSTRUCTIONS, "", "Context:", "\n".join(lines), "", f"Question: {question}", "Answer:"])


def longest_prefix(words: list[str], most: int, budget: int, cost: Callable[[str], int]) -> str:
    """The longest beginning of at most ``most`` words whose cost is within the budget; costs grow with the words."""
    k = bisect_right(range(1, min(most, len(words)) + 1), budget, key=lambda n: cost(" ".join(words[:n])))
    return " ".join(words[:k])


class Packer:
    def __init__(self, count: Counter, budget: int, top: int, each: int):
        if min(budget, top, each) <= 0:
            raise ValueError("budgets must be positive")
        self.budget, self.top, self.each = budget, top, each
        self.cost = lambda text: count([text])[0]

    def pack(self, question: str | None, docs: list[tuple[str, str]]) -> dict:
        """Documents in order, each cut to ``each`` tokens and then to what the prompt has room for; one that had to be cut
        for the prompt is the last, and so is an empty one, which isn't shown."""
        question = (question or "").strip()
        if not question:
            raise ValueError("the question is blank")
        lines: list[str] = []
        shown: list[dict] = []
        cut = len(docs) > self.top
        for rank, (doc_id, text) in enumerate(docs[: self.top], 1):
            words = (text or "").split()
            whole = " ".join(words)
            own = whole if self.cost(whole) <= self.each else longest_prefix(words, len(words) - 1, self.each, self.cost)
            room = lambda t, rank=rank: self.cost(rendered(question, [*lines, f"[{rank}] {t}"]))
            kept = own if not own or room(own) <= self.budget else longest_prefix(own.split(), len(own.split()) - 1, self.budget, room)
            cut |= kept != whole or not kept
            if kept:
                lines.append(f"[{rank}] {kept}")
                shown.append({"doc_id": doc_id, "text": kept})
            if not kept or kept != own:
                break
        prompt = rendered(question, lines or [NO_EVIDENCE])
        if not lines and self.cost(prompt) > self.budget:
            prompt = rendered(question, [])
        n = self.cost(prompt)
        if n > self.budget:
            raise ValueError("the question alone exceeds the budget")
        return {"prompt": prompt, "prompt_tokens": n, "visible_documents": shown, "prompt_truncated": cut}


def pack(rows: DataFrame, budget: int, counter: Callable[[], Counter] = count_words, top: int = 5, each: int = 64) -> DataFrame:
    """``rows`` (.., question, documents as an array of (doc_id, text) in order) with the packed prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(counter(), budget, top, each)
        for b in batches:
            made = [packer.pack(q, [(d["doc_id"], d["text"]) for d in ([] if docs is None else docs)]) for q, docs in zip(b["question"], b["documents"])]
            yield pd.concat([b, pd.DataFrame(made, columns=["prompt", "prompt_tokens", "visible_documents", "prompt_truncated"], index=b.index)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, {PACKED}")


def gathered(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query columns, documents) of hits (query_id, rank, doc_id, text), in the order of rank; none for a query without."""
    doc = F.struct("rank", F.col("doc_id").cast("string").alias("doc_id"), "text")
    lists = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(doc)), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["text"].alias("text"))).alias("documents"))
    return queries.join(lists, "query_id", "left").withColumn("documents", F.coalesce("documents", F.array().cast("array<struct<doc_id:string,text:string>>")))


def visible_hit(aliases: Column, documents: Column) -> Column:
    """1 if an alias stands in the shown texts, once both are normalised; 0 without aliases."""
    shown = answer_text(F.array_join(F.transform(F.slice(documents, 1, 5), lambda d: d["text"]), "\n"))
    golds = F.filter(F.transform(aliases, answer_text), lambda a: a != "")
    return F.coalesce(F.exists(golds, lambda g: F.contains(shown, g)), F.lit(False)).cast("double")


def complete(source: Column, visible: Column, n: int = 5) -> Column:
    """Whether all ``n`` source documents, distinct ones, are shown whole but for white space."""
    flat = lambda x: F.coalesce(stripped(F.regexp_replace(x, r"[\s\p{Z}]+", " ")), F.lit(""))
    same = F.forall(F.zip_with(source, visible, lambda a, b: (a["doc_id"] == b["doc_id"]) & (flat(a["text"]) == flat(b["text"]))), lambda x: F.coalesce(x, F.lit(False)))
    ids = F.transform(source, lambda d: d["doc_id"])
    return (F.size(source) == n) & (F.size(visible) == n) & (F.size(F.array_distinct(ids)) == n) & same


def prompt_stats(prepared: DataFrame, *by: str) -> DataFrame:
    """Rows, least, greatest, upper median and mean of prompt tokens, the share that shows an answer, how many show all
    documents and the ids of those that don't. The median is found in the histogram of lengths, which are few."""
    n = prepared.groupBy(*by, "prompt_tokens").agg(F.count("*").alias("k"))
    hist = n.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("prompt_tokens", "k"))).alias("h"), F.sum("k").alias("_n"))
    walk = F.aggregate("h", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("at")), lambda s, e: F.struct((s["seen"] + e["k"]).alias("seen"), F.coalesce(s["at"], F.when(s["seen"] + e["k"] > F.floor(F.col("_n") / 2), e["prompt_tokens"])).alias("at")), lambda s: s["at"])
    rest = prepared.groupBy(*by).agg(
        F.count("*").alias("rows"), F.min("prompt_tokens").alias("least"), F.max("prompt_tokens").alias("most"), F.round(F.avg("prompt_tokens"), 6).alias("mean"),
        F.round(F.avg("visible_answer"), 6).alias("visible_answer_fraction"), F.count_if("complete_top5").alias("complete"), F.count_if(~F.col("complete_top5")).alias("truncated"),
    )
    return rest.join(hist.select(*by, walk.alias("median")), list(by)) if by else rest.crossJoin(hist.select(walk.alias("median")))


def population(rows: DataFrame, tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]], vocabulary: int) -> DataFrame:
    """Questions (dataset, stable_id, question, answer) encoded once for all runs: the ids of prompt and answer, the hash of
    the question's key, digests of the ids and of the whole row, and what is wrong with it, if anything."""
    texts = rows.withColumns({"_prompt": prompt(F.col("question"), "concise-format-v1"), "_gold": F.concat(F.lit(" "), stripped(F.col("answer")))})
    ids = tokens(tokens(texts, "_prompt", tokenizer, "prompt_ids"), "_gold", tokenizer, "gold_ids").drop("_prompt", "_gold")
    r = ids.withColumns({"question_group": F.sha2(weak_key(F.col("question")), 256), "prompt_sha256": token_digest(F.col("prompt_ids")), "problem": encoded_problems(F.col("prompt_ids"), F.col("gold_ids"), vocabulary)})
    return r.withColumn("input_sha256", F.sha2(F.to_json(F.struct(*sorted(r.columns))), 256))


def teacher_records(rows: DataFrame, bos: int, before: list[int], after: list[int], prefix: int = 64, target: int = 32, evidence: int = 512) -> DataFrame:
    """Training records of passages (doc_id, title, tokens, evidence tokens, documents): a prefix and a target of tokens as
    the student sees them, and as the teacher does, behind the evidence; with the positions that predict the target.
    Passages with fewer tokens are left out."""
    lit = lambda x: F.array(*[F.lit(int(i)) for i in x]).cast("array<int>")
    r = rows.where(F.size("tokens") >= prefix + target)
    head, tail = F.slice("tokens", 1, prefix), F.slice("tokens", prefix + 1, target)
    shown = F.concat(lit(before), F.slice("evidence", 1, evidence), lit(after), head)
    r = r.select("doc_id", F.col("title").alias("source_title"), F.concat(lit([bos]), head, tail).alias("student_ids"), F.concat(lit([bos]), shown, tail).alias("teacher_ids"), tail.alias("target_ids"), F.size(shown).alias("_n"), "documents")
    at = lambda n: F.sequence(n, n + target - 1)
    return r.select("doc_id", "source_title", "student_ids", "teacher_ids", at(F.lit(prefix)).alias("student_positions"), at(F.col("_n")).alias("teacher_positions"), "target_ids", "documents")


def causal(ids: Column, positions: Column, target: Column) -> Column:
    """Whether positions follow each other and each predicts its target: the token after it."""
    n = F.size(target)
    steps = positions == F.sequence(positions[0], positions[0] + n - 1)
    inside = (positions[0] >= 0) & (positions[0] + n < F.size(ids))
    return F.coalesce((F.size(positions) == n) & steps & inside & (F.transform(positions, lambda p: F.get(ids, p + 1)) == target), F.lit(False))


def detokenised(rows: DataFrame, decode: Callable[[], Callable[[list[list[int]]], list[str]]], least: int = 16, chars: int = 2000, short: int = 200) -> DataFrame:
    """(doc_id, text) of rows (doc_id, input_ids, labels): labelled tokens as text on one line, at most ``chars`` characters;
    rows with few tokens and short texts are left out."""
    pairs = F.filter(F.arrays_zip("input_ids", "labels"), lambda p: p["labels"] != -100)
    kept = rows.select("doc_id", F.transform(pairs, lambda p: p["input_ids"]).alias("ids")).where(F.size("ids") >= least)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = decode()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": f([list(map(int, x)) for x in b["ids"]])})

    text = F.substring(F.translate(F.coalesce(stripped(F.col("text")), F.lit("")), "\n\t", "  "), 1, chars)
    return kept.mapInPandas(run, f"doc_id {kind}, text string").select("doc_id", text.alias("text")).where(F.length("text") >= short)


def label_layout(rows: DataFrame, width: int = 2048) -> DataFrame:
    """(row, tokens, reset, problem) of rows (row, input_ids, labels): the labelled tokens; whether they begin the row; and
    what is wrong: labels that differ from their tokens, none or too many labelled, or a layout that is neither a beginning
    nor a stretch from the middle on."""
    zipped = F.arrays_zip("input_ids", "labels")
    on = F.transform("labels", lambda v: v != -100)
    kept = F.filter(zipped, lambda p: p["labels"] != -100)
    n, reset = F.size(kept), F.get(on, F.lit(0))
    half = width // 2
    expect = F.when(reset, F.transform("labels", lambda v, i: i < n)).otherwise(F.transform("labels", lambda v, i: (i >= half) & (i < half + n)))
    why = F.when(F.exists(kept, lambda p: p["input_ids"] != p["labels"]), "labels differ").when((n <= 0) | (n > half), "length").when(on != expect, "layout")
    return rows.select("row", F.transform(kept, lambda p: p["input_ids"]).alias("tokens"), reset.alias("reset"), why.alias("problem"))


def clip(texts: list[str], kept: list[int], encode: Callable[[str], list[int]]) -> list[str]:
    """The longest beginning of each text whose tokens begin its ``kept`` first ones."""
    out = []
    for text, k in zip(texts, kept):
        ids = encode(text)
        lengths = range(len(text), -1, -1)
        out.append(next(text[:n] for n in lengths if len(t := encode(text[:n])) <= k and t == ids[: len(t)]))
    return out
