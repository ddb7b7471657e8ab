"""Problem 5: one form for texts that read the same.

Characters nobody sees form the class of the empty string and are dropped first. What is left is taken as graphemes (a
character and its combining marks). Graphemes and strings that look alike are joined by union-find: a grapheme with its
canonical decomposition, with its compatibility decomposition where only width, font or spacing differ, with the Latin
letter its glyph equals, and with the string of its parts' classes; so the classes are transitive. The most frequent member
of a class over all texts represents it (of equally frequent ones the least), and one automaton of all other members
rewrites the texts greedily, longest match first. Blanks at the ends are dropped and runs of blanks become one.

Case and accents stay. The tables sent to the workers hold distinct graphemes of at most three code points, whose number is
bounded by Unicode, not by the data; longer ones are rewritten part by part. Defined results: null stays null; a text of
unseen characters alone becomes empty; empty arrays stay empty and null elements null.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillarn.operators.skew import salted_join

# Letters of other scripts whose glyphs equal Latin ones, and hyphens.
LOOKS = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "іıι", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "սυ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "-": "‐‑−⁃﹣", "'": "’ʼ＇", "·": "‧・",
}
KINDS = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>"}
MARKED = regex.compile(r"\P{M}\p{M}{1,2}|\p{M}{1,3}")
UNSEEN = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵ㅤﾠ︀-️\U000e0100-\U000e01ef]")
BLANKS = regex.compile(r"[\s\p{Z}]+")


def _open(c: str) -> str:
    """The compatibility decomposition of a character where nothing but width, font or spacing changes."""
    kind, _, rest = unicodedata.decomposition(c).partition(" ")
    return "".join(chr(int(x, 16)) for x in rest.split()) if kind in KINDS else c


class Classes:
    """Union-find over strings."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        path = []
        while self.parent.setdefault(x, x) != x:
            path.append(x)
            x = self.parent[x]
        for p in path:
            self.parent[p] = x
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def rewriting(counts: dict[str, int], looks: dict[str, str] = LOOKS) -> dict[str, str]:
    """pattern -> representative, for every pattern that isn't its own, given how often graphemes occur. ``looks`` joins
    characters to those whose glyphs they share; by default letters of other scripts to Latin ones."""
    classes = Classes()
    for latin, others in looks.items():
        for c in others:
            classes.join(c, latin)
    seen = {UNSEEN.sub("", g) for g in counts} - {""}
    todo = seen | {c for g in seen for c in g} | set(looks) | {c for x in looks.values() for c in x}
    while todo:
        fresh = set()
        for g in todo:
            parts = unicodedata.normalize("NFD", "".join(_open(c) for c in unicodedata.normalize("NFD", g)))
            if parts != g:
                classes.join(g, parts)
                if parts not in classes.parent or len(parts) > 1:
                    fresh |= {c for c in parts if c not in classes.parent}
        todo = fresh
    # a string joins the string of its parts' least members, until nothing changes
    changed = True
    while changed:
        changed = False
        for g in [x for x in classes.parent if len(x) > 1]:
            plain = unicodedata.normalize("NFD", "".join(classes.find(c) for c in g))
            if classes.find(g) != classes.find(plain):
                classes.join(g, plain)
                changed = True
    members: dict[str, list[str]] = {}
    for x in list(classes.parent):
        members.setdefault(classes.find(x), []).append(x)
    out = {}
    for m in members.values():
        best = min(m, key=lambda x: (-counts.get(x, 0), len(x), x))
        if BLANKS.fullmatch(best):
            best = " "
        out |= {x: best for x in m if x != best}
    return out


def _strings(frames: list[tuple[DataFrame, str]]) -> DataFrame:
    """All texts of the given columns (strings or arrays of strings) as one column."""
    parts = []
    for df, c in frames:
        x = F.explode(c) if df.schema[c].dataType.typeName() == "array" else F.col(c)
        parts.append(df.select(x.alias("t")).where(F.col("t").isNotNull()))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def learn(frames: list[tuple[DataFrame, str]], looks: dict[str, str] = LOOKS) -> dict[str, str]:
    """The rewriting of all texts of the given columns. What comes to the driver are the distinct characters and marked
    graphemes with their numbers: 254 of 20,000 references with their predictions, 262 of ten times as many, for they are the alphabets
    in use."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.zeros(0x110000, np.int64)
        marked: dict[str, int] = {}
        for b in batches:
            text = UNSEEN.sub("", "\n".join(b.column(0).to_pylist()))
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            c, n = np.unique(codes, return_counts=True)
            points[c] += n
            if not text.isascii():
                for g in MARKED.findall(text):
                    marked[g] = marked.get(g, 0) + 1
        at = np.flatnonzero(points)
        yield pa.RecordBatch.from_arrays([pa.array([*map(chr, at.tolist()), *marked], pa.string()), pa.array([*points[at].tolist(), *marked.values()], pa.int64())], ["g", "n"])

    rows = _strings(frames).mapInArrow(count, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    return rewriting(dict(zip(rows.column("g").to_pylist(), rows.column("n").to_pylist())), looks)


class Rewriter:
    """A rewriting as an automaton."""

    def __init__(self, table: dict[str, str]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for x, y in table.items():
            self.auto.add_word(x, (len(x), y))
        self.auto.make_automaton()
        self.plain = not any(x.isascii() for x in table)

    def rewrite(self, text: str | None) -> str | None:
        if text is None:
            return None
        if not (self.plain and text.isascii()):
            text = UNSEEN.sub("", text)
            out, a = [], 0
            for end, (n, new) in self.auto.iter_long(text):
                out += [text[a : end - n + 1], new]
                a = end + 1
            text = unicodedata.normalize("NFC", "".join([*out, text[a:]]))
        return BLANKS.sub(" ", text).strip(" ")

    def all(self, texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        return pa.array([self.rewrite(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def rewritten(df: DataFrame, column: str, table: dict[str, str], to: str) -> DataFrame:
    """``df`` with the one form of ``column`` (a string or an array of strings) as ``to``."""
    if to in df.columns:
        raise ValueError(f"there is a column {to} already")
    schema = T.StructType([*df.schema.fields, T.StructField(to, df.schema[column].dataType)])
    at = df.columns.index(column)
    held = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Rewriter(held.value)
        for b in batches:
            x = b.column(at)
            if pa.types.is_list(x.type):
                flat = r.all(x.flatten())
                n = np.append(0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(x), 0).to_numpy(zero_copy_only=False)))
                new = pa.ListArray.from_arrays(pa.array(n, pa.int32()), flat, mask=x.is_null()) if x.null_count else pa.ListArray.from_arrays(pa.array(n, pa.int32()), flat)
            else:
                new = r.all(x)
            yield pa.RecordBatch.from_arrays([*b.columns, new], [*b.schema.names, to])

    return df.mapInArrow(run, schema)


def found(predictions: DataFrame, references: list[DataFrame], looks: dict[str, str] = LOOKS) -> tuple[DataFrame, DataFrame]:
    """(predictions with their form, references with theirs): the rewriting is learnt from both."""
    refs = references[0].select("stable_id", "aliases")
    for r in references[1:]:
        refs = refs.union(r.select("stable_id", "aliases"))
    preds = predictions.select("ordinal", "stable_id", "prediction")
    table = learn([(preds, "prediction"), (refs, "aliases")], looks)
    return rewritten(preds, "prediction", table, "form"), rewritten(refs, "aliases", table, "forms")


def same_reading(predictions: DataFrame, references: list[DataFrame], looks: dict[str, str] = LOOKS) -> DataFrame:
    """The ordinals of predictions that read like an alias of their question without being equal to one."""
    preds, refs = found(predictions, references, looks)
    known = refs.groupBy("stable_id").agg(F.flatten(F.collect_list("aliases")).alias("aliases"), F.flatten(F.collect_list("forms")).alias("forms"))
    both = salted_join(preds.where("form <> ''"), known, ["stable_id"], F.col("ordinal"), predictions.select("stable_id"))
    hit = F.exists("forms", lambda f: f == F.col("form")) & ~F.coalesce(F.exists("aliases", lambda a: a == F.col("prediction")), F.lit(False))
    return both.where(hit).select("ordinal")
