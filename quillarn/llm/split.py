"""Problem 2: long texts as overlapping pieces cut at natural boundaries.

A text is read as a tree: sections nest by the levels of their headings, a section's own body has blocks between blank
lines or closing tags, a block has list items, which nest by indentation, or lines, and these have sentences, words and
characters. The tree is packed from the bottom: a node that fits stays whole, neighbouring siblings that fit are merged
from the left as long as they fit together, and only an oversized node is opened; its runs are not merged with what stands
beside it, but a heading alone goes with what it heads. A piece is such a run, preceded by about the last ``overlap``
characters of the piece before, from a word's start where there is one near.

The runs without the overlaps are the text itself, in order. Defined results: null, empty and short texts (at most
``limit`` code points) have no pieces; a text with no boundary at all is cut between characters, never before a combining
mark; repeated rows are cut each.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What begins a section and an item, and where other nodes end.
HEADING = regex.compile(r"(?m)^(?:(#{1,6})[ \t]|(={2,6})[^=\n]+={2,6}[ \t]*$|<h([1-6])\b)", regex.I)
ITEM = regex.compile(r"(?m)^([ \t]*)(?:[-*+•]|\d{1,4}[.)])[ \t]+|(<li\b)", regex.I)
ENDS = {
    "body": regex.compile(r"\n[ \t\r]*\n\s*|</(?:p|div|ul|ol|table|section|article|blockquote|h[1-6])>\s*", regex.I),
    "lines": regex.compile(r"\n\s*|<br\s*/?>\s*|</(?:li|tr)>\s*", regex.I),
    "line": regex.compile(r"(?:(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])[」』）]*\s*)"),
    "sentence": regex.compile(r"\s+"),
}
INSIDE = {"body": "block", "lines": "line", "line": "sentence", "sentence": "word"}
#: Lists that nest deeper are read as lines.
DEEPEST = 64
ABBREVIATION = regex.compile(r"(?:^|[\s(])(?:Dr|Mr|Mrs|Ms|Prof|St|No|vol|vgl|bzw|etc|cf|ca|z\.B|e\.g|i\.e|\p{L})\.$")


class Node(NamedTuple):
    """A part of a text; ``depth`` is a heading's level, or an item's indentation and nesting."""

    start: int
    end: int
    kind: str
    depth: tuple[int, ...] = (0,)


def _nested(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (position, level) the outermost: those no other before them, since the last outermost, is above."""
    out: list[tuple[int, int]] = []
    for at, level in starts:
        if not out or level <= out[-1][1]:
            out.append((at, level))
    return out


def children(text: str, node: Node) -> list[Node]:
    """The parts of a node, in order and without gaps; none for a word."""
    a, b, kind, depth = node
    if kind == "section":
        heads = _nested([(m.start(), next(len(g) if not g.isdigit() else int(g) for g in m.groups() if g)) for m in HEADING.finditer(text, a, b) if m.start() > a or not depth[0]])
        first = heads[0][0] if heads else b
        parts = [Node(a, first, "body")] if first > a else []
        return parts + [Node(at, end, "section", (level,)) for (at, level), (end, _) in zip(heads, [*heads[1:], (b, 0)])]
    if kind in {"block", "item"}:
        own = kind == "item"
        found = [(m.start(), 0 if m.group(2) else len(m.group(1).expandtabs(4))) for m in ITEM.finditer(text, a, b) if not own or m.start() > a]
        items = _nested(found) if depth[-1] < DEEPEST else []
        first = items[0][0] if items else b
        if not items:
            return children(text, Node(a, b, "lines"))
        parts = [Node(a, first, "lines")] if first > a else []
        return parts + [Node(at, end, "item", (level, depth[-1] + 1)) for (at, level), (end, _) in zip(items, [*items[1:], (b, 0)])]
    if kind == "word":
        return []
    ends = [m.end() for m in ENDS[kind].finditer(text, a, b) if not (kind == "line" and ABBREVIATION.search(text, max(a, m.start() - 8), m.start()))]
    ends = [e for e in ends if a < e < b]
    return [Node(i, j, INSIDE[kind]) for i, j in zip([a, *ends], [*ends, b])]


def _joined(c: str) -> bool:
    """Whether a character belongs to the one before."""
    return unicodedata.combining(c) > 0 or c in "\u200d\ufe0e\ufe0f" or "\U0001f3fb" <= c <= "\U0001f3ff"


def _split(text: str, a: int, b: int, size: int) -> list[tuple[int, int]]:
    """A part without boundaries as runs."""
    runs = []
    while b - a > size:
        end = a + size
        while end > a + size // 2 and (_joined(text[end]) or text[end - 1] == "\u200d"):
            end -= 1
        runs.append((a, end))
        a = end
    return [*runs, (a, b)]


def _pack(text: str, node: Node, size: int, start: int | None = None) -> list[tuple[int, int]]:
    """A node, with what stands before it from ``start`` on, as runs of at most ``size`` characters."""
    start = node.start if start is None else start
    if node.end - start <= size:
        return [(start, node.end)]
    if node.kind == "word":
        return _split(text, start, node.end, size)
    runs: list[tuple[int, int]] = []
    growing = False  # whether the last run is of whole siblings
    for child in children(text, node):
        first = child.start if runs else start
        if growing and child.end - first > size and HEADING.match(text, runs[-1][0]) and "\n" not in text[slice(*runs[-1])].strip():
            first = runs.pop()[0]  # a heading alone goes with what it heads
        fits = child.end - first <= size
        if growing and fits and runs and child.end - runs[-1][0] <= size:
            runs[-1] = (runs[-1][0], child.end)
        else:
            runs += [(first, child.end)] if fits else _pack(text, child, size, first)
        growing = fits
    return runs


def pieces_of(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int, int]]:
    """(start, start of what is new, end) of each piece."""
    out = []
    for a, b in _pack(text, Node(0, len(text), "section"), limit - overlap):
        start = a
        if out and overlap:
            start = a - overlap
            m = regex.search(r"\s\S", text, pos=max(0, start - 1), endpos=min(a, start + overlap // 3))
            if m:
                start = m.end() - 1
            else:
                while start < a and _joined(text[start]):
                    start += 1
        out.append((max(0, start), a, b))
    return out


def pieces(documents: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """(doc_id, piece, start, fresh, end, text) of each document longer than ``limit``; offsets count code points and
    ``fresh`` is where the overlap ends."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than a piece")
    kind = documents.schema["doc_id"].dataType.simpleString()
    long = documents.where(F.length("text") > limit).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 256):
                rows = [(i, k, s, f, e, t[s:e]) for i, t in zip(ids[at : at + 256], texts[at : at + 256]) for k, (s, f, e) in enumerate(pieces_of(t, limit, overlap))]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *(pa.array(c, pa.int32()) for c in cols[1:5]), pa.array(cols[5], pa.string())], ["doc_id", "piece", "start", "fresh", "end", "text"])

    return long.mapInArrow(run, f"doc_id {kind}, piece int, start int, fresh int, end int, text string")
