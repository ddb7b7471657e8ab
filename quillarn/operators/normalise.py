"""Question sets of several publishers brought to one record: (stable_id, dataset, question, answer, aliases, metadata).

Sources are DataFrames of raw fields with an ``ordinal``. What a record must have is checked where it is computed, so a
broken row raises when its partition runs, with its ordinal. ``metadata`` is a JSON object with its fields in the order of
their names; fields without a value are left out.
"""
from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillarn.functions.text import clean_list, stripped

STRINGS = T.ArrayType(T.StringType())
# Kinds of questions over two pages, prompts by protocol, and the form of an alias that is no pattern.
QUESTION_TYPES = ["comparison", "inference", "compositional", "bridge_comparison"]
PROMPTS = {
    "question-only-v1": "Answer these questions:\nQuestion: {question}\nAnswer:",
    "concise-format-v1": 'Answer with only the shortest possible answer span.\nDo not explain or write a complete sentence.\nIf the answer is yes or no, output exactly "yes" or "no".\n\nQuestion: {question}\nAnswer:',
}
LITERAL = re.compile(r"[A-Za-z0-9]([A-Za-z0-9 .,'&()/-]*[A-Za-z0-9.)])?")


def failing(message: str, kind: str = "string") -> Column:
    """An expression that raises with the row's ordinal."""
    return F.raise_error(F.concat(F.lit("row "), F.coalesce(F.col("ordinal").cast("string"), F.lit("?")), F.lit(f": {message}"))).cast(kind)


def required(name: str, x: Column | None = None) -> Column:
    """A stripped text that must be there."""
    return F.coalesce(stripped(F.col(name) if x is None else x), failing(f"{name} is missing"))


def whole_number(df: DataFrame, name: str) -> Column:
    """A whole number given as such or as text; truth values, blanks and other texts raise."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        raise ValueError(f"{name} holds truth values")
    if isinstance(kind, T.IntegralType):
        return F.coalesce(F.col(name).cast("bigint"), failing(f"{name} is no whole number", "bigint"))
    digits = F.when(stripped(F.col(name)).rlike(r"^[+-]?\d+(?:_\d+)*$"), F.replace(stripped(F.col(name)), F.lit("_"), F.lit("")))
    return F.coalesce(digits.try_cast("bigint"), failing(f"{name} is no whole number", "bigint"))


def answer_first(answer: Column, aliases: Column) -> Column:
    """Clean aliases, with the answer before them if it isn't among them."""
    known = F.coalesce(clean_list(aliases), F.array().cast(STRINGS))
    return F.when(F.array_contains(known, answer), known).otherwise(F.array_distinct(F.concat(F.array(answer), known)))


def record(rows: DataFrame, stable_id: Column, dataset: str | Column, question: Column, answer: Column, aliases: Column, metadata: dict[str, Column]) -> DataFrame:
    fields = [metadata[k].alias(k) for k in sorted(metadata)]
    dataset = F.lit(dataset) if isinstance(dataset, str) else dataset
    return rows.select("ordinal", stable_id.alias("stable_id"), dataset.alias("dataset"), question.alias("question"), answer.alias("answer"), aliases.alias("aliases"), F.to_json(F.struct(*fields)).alias("metadata"))


def strict_aliases(x: Column) -> Column:
    """Aliases of which none may be blank and at least one must be there."""
    bad = x.isNull() | (F.size(x) == 0) | F.exists(x, lambda a: stripped(a).isNull())
    return F.when(F.coalesce(bad, F.lit(True)), failing("answers must be texts that aren't blank", "array<string>")).otherwise(clean_list(x))


def popqa(rows: DataFrame) -> DataFrame:
    """Raw (id, question, prop, obj, subj, s_wiki_title, possible_answers, s_pop, o_pop): the subject is the first of its
    name, its page and the id that isn't blank."""
    answer, source = required("obj"), required("id")
    listed = F.from_json(required("possible_answers"), "array<string>", {"mode": "FAILFAST"})
    aliases = F.when(F.size(clean_list(listed)) > 0, answer_first(answer, listed)).otherwise(failing("there is no possible answer", "array<string>"))
    meta = {"source_id": source, "subject": F.coalesce(stripped(F.col("subj")), stripped(F.col("s_wiki_title")), source), "property": required("prop"), "object": answer, "subject_popularity": whole_number(rows, "s_pop"), "object_popularity": whole_number(rows, "o_pop")}
    return record(rows, F.concat(F.lit("popqa:"), source), "popqa", required("question"), answer, aliases, meta)


def _parts(pattern: str) -> list[str] | None:
    """The alternatives at the outermost level of a pattern, or None if its groups aren't closed."""
    out, depth = [""], 0
    for m in re.finditer(r"\\.|[()|]|[^\\()|]+|\\", pattern, re.S):
        t = m.group()
        depth += (t == "(") - (t == ")")
        if depth < 0:
            return None
        if t == "|" and not depth:
            out.append("")
        else:
            out[-1] += t
    return None if depth else [p.strip() for p in out]


def _one_group(pattern: str) -> bool:
    """Whether a pattern is one group from its first to its last character."""
    if not (pattern.startswith("(") and pattern.endswith(")")):
        return False
    depth = 0
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return i == len(pattern) - 1
    return True


def literals(pattern: str | None) -> list[str]:
    """The aliases a pattern spells out: its outermost alternatives, if all are plain; otherwise none."""
    p = re.sub(r"^(?:\(\?i\)\s*)+", "", (pattern or "").strip()).strip()
    while len(p) > 1 and p.startswith("^") and p.endswith("$"):
        p = p[1:-1].strip()
    if _one_group(p):
        p = p[1:-1].strip()
    plain = [x.removeprefix("?:").strip() for x in _parts(p) or []]
    return list(dict.fromkeys(plain)) if plain and all(LITERAL.fullmatch(x) for x in plain) else []


def literal_aliases(x: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(literals), STRINGS)(x)


def curated_trec(rows: DataFrame) -> DataFrame:
    """Raw (source_id, question_type, question, answer_regex): the answer is the first alias the pattern spells out, or the
    pattern."""
    source, kind, question, pattern = (required(c) for c in ("source_id", "question_type", "question", "answer_regex"))
    named = rows.withColumn("_aliases", literal_aliases(stripped(F.col("answer_regex"))))
    meta = {"source_id": source, "question_type": kind, "answer_regex": pattern, "has_literal_aliases": F.size("_aliases") > 0}
    return record(named, F.concat(F.lit("curatedtrec:"), source), "curatedtrec", question, F.coalesce(F.get("_aliases", F.lit(0)), pattern), F.col("_aliases"), meta)


def _listed(x: Column, *names: str) -> Column:
    """The texts in the named fields of a JSON object, each a list or a text, one list after the other."""
    parts = []
    for n in names:
        raw = F.get_json_object(x, f"$.{n}")
        parts.append(F.when(raw.startswith("["), F.from_json(raw, STRINGS)).when(raw.isNotNull(), F.array(raw)).otherwise(F.array().cast(STRINGS)))
    return clean_list(F.flatten(F.array(*parts)))


def alias_map(payload: DataFrame) -> DataFrame:
    """(qid, aliases) of JSON values (ordinal, value): objects with an id each, or one object that maps ids to a list, to a
    text or to an object of lists. Of an id that comes again the last counts."""
    qid = F.coalesce(stripped(F.get_json_object("value", "$.Q_id")), stripped(F.get_json_object("value", "$.id")))
    of_items = payload.where(qid.isNotNull()).select("ordinal", qid.alias("qid"), _listed(F.col("value"), "aliases", "demonyms", "alias", "name").alias("aliases"))
    pairs = payload.where(qid.isNull()).select("ordinal", F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("i", "e")).select("ordinal", "i", F.col("e.key").alias("qid"), F.col("e.value").alias("v"))
    listed = F.when(F.col("v").startswith("["), clean_list(F.from_json("v", STRINGS))).when(F.col("v").startswith("{"), _listed(F.col("v"), "aliases", "demonyms", "values")).otherwise(clean_list(F.array("v")))
    both = of_items.select("ordinal", F.lit(0).alias("i"), "qid", "aliases").union(pairs.select("ordinal", "i", "qid", listed.alias("aliases")))
    return both.groupBy("qid").agg(F.max_by("aliases", F.struct("ordinal", "i")).alias("aliases"))


def two_wiki(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Raw (_id, question, answer, type, answer_id and optional fields) with the aliases (qid, aliases) of ``answer_id``."""
    answer, source = required("answer"), required("_id")
    kind = F.replace(required("type"), F.lit("-"), F.lit("_"))
    kind = F.when(kind.isin(QUESTION_TYPES), kind).otherwise(failing("unknown type of question"))
    known = aliases.select(F.col("qid").alias("_qid"), F.col("aliases").alias("_known"))
    both = rows.join(known, stripped(F.col("answer_id")) == F.col("_qid"), "left")
    meta = {"source_id": source, "question_type": kind} | {c: F.col(c) for c in ("answer_id", "supporting_facts", "evidences", "evidences_id", "entity_ids", "context") if c in rows.columns}
    return record(both, F.concat(F.lit("2wiki:"), source), "2wiki", required("question"), answer, answer_first(answer, F.col("_known")), meta)


def _python_list(text: str | None) -> list[str | None] | None:
    try:
        value = ast.literal_eval((text or "").strip())
    except (SyntaxError, ValueError):
        return None
    return [x if isinstance(x, str) else None for x in value] if isinstance(value, (list, tuple)) else None


def python_list(x: Column) -> Column:
    """The texts of a list or tuple written as a Python literal; elements that are no texts are null, anything else is."""
    return F.pandas_udf(lambda s: pd.Series([_python_list(t) for t in s], dtype=object), STRINGS)(x)


def numbered(dataset: str, split: str) -> Column:
    return F.format_string(f"{dataset}:{split}:%06d", "ordinal")


def dpr(rows: DataFrame, dataset: str, split: str) -> DataFrame:
    """Raw (question, answers as a Python list) with dense ordinals."""
    listed = rows.withColumn("_answers", python_list(F.col("answers")))
    aliases = strict_aliases(F.col("_answers"))
    return record(listed, numbered(dataset, split), dataset, required("question"), F.get(aliases, F.lit(0)), aliases, {"source_ordinal": F.col("ordinal"), "source_split": F.lit(split)})


def hotpotqa(rows: DataFrame, split: str, rekey: bool = False) -> DataFrame:
    """Raw (id or _id, question, answer, type, level); ids with the split in them if ``rekey``."""
    ids = [stripped(F.col(c)) for c in ("id", "_id") if c in rows.columns]
    source, answer = F.coalesce(*ids, failing("id is missing")), required("answer")
    meta = {"source_id": source, "source_split": F.lit(split)} | {k: stripped(F.col(c)) for k, c in (("question_type", "type"), ("level", "level")) if c in rows.columns}
    return record(rows, F.concat(F.lit(f"hotpotqa:{split}:" if rekey else "hotpotqa:"), source), "hotpotqa", required("question"), answer, F.array(answer), meta)


def webq_dev(rows: DataFrame) -> DataFrame:
    """Raw (question, answers); rows without an answer are left out but counted by the ordinals."""
    some = rows.withColumn("_aliases", clean_list(F.col("answers"))).where(F.size("_aliases") > 0)
    return record(some, numbered("webq", "dev"), "webq", required("question"), F.get("_aliases", F.lit(0)), F.col("_aliases"), {"source_ordinal": F.col("ordinal"), "source_split": F.lit("dev")})


def entity_questions(rows: DataFrame) -> DataFrame:
    """Raw (relation, question, answers) with ordinals within each relation."""
    some = rows.withColumn("_aliases", clean_list(F.col("answers"))).where(F.size("_aliases") > 0)
    meta = {"source": F.lit("entityquestions"), "source_split": F.lit("dev"), "relation": F.col("relation"), "source_ordinal": F.col("ordinal")}
    return record(some, F.format_string("entityquestions:dev:%s:%06d", "relation", "ordinal"), "popqa", required("question"), F.get("_aliases", F.lit(0)), F.col("_aliases"), meta)


def aliases_of(x: Column) -> Column:
    """A row's aliases, none where there is no list."""
    return F.coalesce(x, F.array().cast(STRINGS))


def violations(rows: DataFrame) -> DataFrame:
    """(stable_id, reason) of each record that breaks the contract: fields that are missing, an id that comes again, no
    metadata object, or neither an alias nor a pattern as answer."""
    checks = {c: stripped(F.col(c)).isNull() for c in ("stable_id", "dataset", "question", "answer")}
    checks["aliases"] = F.col("aliases").isNull()
    checks["metadata"] = ~F.coalesce(F.startswith(F.ltrim("metadata"), F.lit("{")), F.lit(False))
    checks["answer contract"] = (F.coalesce(F.size(clean_list(F.col("aliases"))), F.lit(0)) <= 0) & stripped(F.get_json_object("metadata", "$.answer_regex")).isNull()
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(k)) for k, bad in checks.items()]))
    alone = rows.select("stable_id", F.explode(reasons).alias("reason"))
    again = rows.where("stable_id is not null").groupBy("stable_id").count().where("count > 1").select("stable_id", F.lit("again").alias("reason"))
    return alone.union(again)


def prompt(question: Column, protocol: str = "question-only-v1") -> Column:
    """A question in the prompt of a protocol; a blank one raises."""
    before, after = PROMPTS[protocol].split("{question}")
    return F.concat(F.lit(before), F.coalesce(stripped(question), F.raise_error(F.lit("the question is blank")).cast("string")), F.lit(after))
