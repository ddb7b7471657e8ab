"""Problem 1: evaluation passages inside training text.

Texts become sequences of words (runs of letters and digits, case and markup dropped), each word one symbol (its 64-bit
hash). Every window of ``words`` symbols is embedded by the CGK random walk: at step j the symbol under the cursor is
written and the cursor moves on by a random bit of (j, symbol), so that windows a few edits apart write strings that agree
in most places. A table of the LSH samples some places of the embedding; windows of a document whose samples equal those
of an item's window are its candidates, and these are verified by edit distance over words. Equal windows agree in every
place, so one table finds them all. For ``edits`` > 0 the items have windows of every length from ``words - edits`` to
``words + edits``, for a word more or less changes the length, and the number of tables follows from the target recall,
which each kind of edit (another word, a word more, a word less) must reach by itself.

Samples are compared one place after the other, and a window that no item's window agrees with so far is dropped at once:
nearly all windows end at their first or second place. The items are a stated query set: their windows go to the workers in
blocks of at most ``ITEM_WORDS`` words, whatever their number; with several blocks the documents' symbols are written once.

Defined results: null, blank and too short texts or items match nothing; repeated rows and items give one pair each.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillarn.session import cut

#: Words of items that one pass sends to the workers (8 bytes each).
ITEM_WORDS = 2_000_000
#: Candidates that are verified at once.
CANDIDATES = 500_000
#: Places of the embedding that a table samples.
PLACES = 6
MOST_TABLES = 64

# Tags, special tokens, entities and link targets are markup.
MARKUP = r"</?[A-Za-z][^<>]*>|<!--.*?-->|<\|[^<>|]*\|>|&#?\w{1,8};|\]\([^()\s]*\)"


def symbols(text: Column) -> Column:
    """The words of a text as 64-bit hashes; null for a null text."""
    low = F.replace(F.lower(F.regexp_replace(text, MARKUP, " ")), F.lit("ß"), F.lit("ss"))
    return F.transform(F.filter(F.split(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != ""), lambda w: F.xxhash64(w))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Table:
    """One table of the LSH: a random walk and the places it samples."""

    def __init__(self, words: int, seed: int):
        rng = np.random.default_rng([20240, seed])
        self.words = words
        self.salts = rng.integers(1, 2**63, 3 * words)
        # the walk passes about a symbol in two steps; past 3/2 of the window most places tell little. The first table
        # begins at once, so that it drops most windows at once; the others begin anywhere, or an edit there hid from all
        self.places = np.sort(rng.choice(max(1, words * 3 // 2), min(PLACES, max(1, words * 3 // 2)), replace=False))
        if seed == 0:
            self.places[0] = 0

    def samples(self, flat: np.ndarray, starts: np.ndarray, keep=None, words: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of the windows of ``words`` symbols at ``starts``; ``keep(level, signatures)`` may drop windows after
        each place."""
        words = words or self.words
        at = np.zeros(len(starts), np.int64)
        sig = np.zeros(len(starts), np.uint64)
        level = 0
        for j in range(int(self.places[-1]) + 1):
            inside = at < words
            sym = flat[starts + np.minimum(at, words - 1)]
            if not inside.all():
                sym = np.where(inside, sym, 0)
            if j == self.places[level]:
                sig = _mix(sig ^ sym.view(np.uint64), level + 1)
                if keep is not None:
                    ok = keep(level, sig)
                    starts, at, sig, sym = starts[ok], at[ok], sig[ok], sym[ok]
                level += 1
            at += (_mix(sym, int(self.salts[j])) & np.uint64(1)).astype(np.int64)
        return starts, sig


def tables_for(words: int, edits: int, recall: float) -> int:
    """How many tables together find a window ``edits`` edits away with probability ``recall``, whether words are exchanged,
    added or left out, measured on random windows."""
    if edits == 0:
        return 1
    rng = np.random.default_rng(7)
    n = 4000
    a = rng.integers(1, 2**62, (n, words))
    others = []
    for more in (0, edits, -edits):
        b = rng.integers(1, 2**62, (n, words + more))
        for k in range(n):
            if more < 0:
                b[k] = np.delete(a[k], rng.choice(words, -more, replace=False))
            elif more:
                b[k, np.delete(np.arange(words + more), rng.choice(words + more, more, replace=False))] = a[k]
            else:
                kept = np.delete(np.arange(words), rng.choice(words, edits, replace=False))
                b[k, kept] = a[k, kept]
        others.append(b)
    starts = np.arange(n)
    hits = np.zeros((3, n), bool)
    for s in range(MOST_TABLES):
        t = Table(words, s)
        mine = t.samples(a.ravel(), starts * words)[1]
        for hit, b in zip(hits, others):
            hit |= mine == t.samples(b.ravel(), starts * b.shape[1], words=b.shape[1])[1]
        if hits.mean(axis=1).min() >= recall:
            return s + 1
    raise ValueError(f"{MOST_TABLES} tables don't reach a recall of {recall}")


def _windows(offsets: np.ndarray, words: int) -> np.ndarray:
    """The starts of all whole windows of consecutive sequences."""
    n = np.maximum(np.diff(offsets) - words + 1, 0)
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)


def _within(x: np.ndarray, at: np.ndarray, words: int, y: np.ndarray, start: np.ndarray, length: np.ndarray, edits: int) -> np.ndarray:
    """Whether each window x[at : at + words] is at most ``edits`` word edits from y[start : start + length]: the band of
    the dynamic programme, for all windows at once."""
    far = edits + 1
    band = [np.full(len(at), k if k >= 0 else far) for k in range(-edits, edits + 1)]
    for i in range(1, words + 1):
        new: list[np.ndarray] = []
        for k in range(-edits, edits + 1):
            j = i + k
            cost = np.full(len(at), far)
            if j == 0:
                cost = np.full(len(at), min(i, far))
            elif j > 0:
                ok = j <= length
                here = y[start + np.minimum(j, length) - 1]
                cost = np.where(ok, band[k + edits] + (x[at + i - 1] != here), far)
                if k < edits:
                    cost = np.minimum(cost, band[k + edits + 1] + 1)
                if new:
                    cost = np.where(ok, np.minimum(cost, new[-1] + 1), far)
            new.append(np.minimum(cost, far))
        band = new
    return np.stack(band)[length - words + edits, np.arange(len(at))] <= edits


class Index:
    """The windows of a block of items under every table."""

    def __init__(self, ids: list, flat: np.ndarray, offsets: np.ndarray, words: int, edits: int, recall: float):
        self.words, self.edits, self.flat = words, edits, flat
        self.owner_of = np.repeat(np.array(ids, dtype=np.int64), np.diff(offsets)) if len(ids) else np.zeros(0, np.int64)
        spans = [(n, _windows(offsets, n)) for n in range(max(1, words - edits), words + edits + 1)]
        starts = np.concatenate([s for _, s in spans])
        lengths = np.concatenate([np.full(len(s), n) for n, s in spans])
        self.tables = []
        for s in range(tables_for(words, edits, recall)):
            t, maps = Table(words, s), [np.zeros(1 << 22, bool) for _ in range(len(Table(words, s).places))]

            def note(level, sig, maps=maps):
                maps[level][(sig & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
                return np.ones(len(sig), bool)

            sig = np.concatenate([t.samples(flat, at, note, n)[1] for n, at in spans])
            order = np.argsort(sig, kind="stable")
            self.tables.append((t, [np.packbits(m) for m in maps], sig[order], starts[order], lengths[order]))

    def search(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item id) of every verified pair, each once."""
        starts = _windows(offsets, self.words)
        pairs = np.zeros((2, 0), np.int64)
        for t, maps, sigs, at, lengths in self.tables:

            def keep(level, sig, maps=maps):
                bit = (sig & np.uint64((1 << 22) - 1)).astype(np.int64)
                return (maps[level][bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1

            mine, sig = t.samples(flat, starts, keep)
            low, high = np.searchsorted(sigs, sig, "left"), np.searchsorted(sigs, sig, "right")
            mine, low, n = mine[high > low], low[high > low], (high - low)[high > low]
            # text that many items share makes many candidates: a bounded number is expanded at a time
            bounds = np.searchsorted(np.cumsum(n), np.arange(CANDIDATES, int(n.sum()) + CANDIDATES, CANDIDATES), "left")
            for i, j in zip([0, *bounds[:-1]], bounds):
                j = min(j + 1, len(n)) if j == bounds[-1] else j
                part = n[i:j]
                if not len(part):
                    continue
                k = np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part) + np.repeat(low[i:j], part)
                doc = np.repeat(mine[i:j], part)
                ok = _within(flat, doc, self.words, self.flat, at[k], lengths[k], self.edits)
                rows = np.searchsorted(offsets, doc[ok], side="right") - 1
                pairs = np.unique(np.concatenate([pairs, np.stack([rows, self.owner_of[at[k][ok]]])], axis=1), axis=1)
        return pairs[0], pairs[1]


def leaks(documents: DataFrame, items: DataFrame, fields: tuple[str, ...] = ("question", "context"), words: int = 12, edits: int = 0, recall: float = 0.95) -> DataFrame:
    """(doc_id, item_id) of each document with a window of ``words`` consecutive words at most ``edits`` word edits from
    one of the item's fields."""
    parts = items.where(F.col("item_id").isNotNull()).select("item_id", F.explode(F.array(*[symbols(F.col(f)) for f in fields])).alias("w")).where(F.size("w") >= words - edits)
    total = parts.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // ITEM_WORDS))
    docs = documents.where(F.col("doc_id").isNotNull()).select("doc_id", symbols(F.col("text")).alias("w")).where(F.size("w") >= words)
    if blocks > 1:
        docs = cut(docs, "symbols")
    kind = documents.schema["doc_id"].dataType.simpleString()
    found = []
    for block in range(blocks):
        rows = parts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        index = Index([r.item_id for r in rows], np.array([x for r in rows for x in r.w], np.int64), np.append(0, np.cumsum([len(r.w) for r in rows])).astype(np.int64), words, edits, recall)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                rows, ids = index.search(flat, offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(ids, pa.int64())], ["doc_id", "item_id"])

        part = docs.mapInArrow(run, f"doc_id {kind}, item_id bigint")
        found.append(cut(part, "leaks") if blocks > 1 else part)
    return reduce(DataFrame.union, found).distinct()
