"""Problem 10: text decoded with the wrong character encoding.

A character trigram model with interpolated smoothing is counted over all clean records (no text that reads as UTF-8 under
another encoding, no replacement character, no stray control character). Every run of non-ASCII characters that the model
finds unlikely is put through every candidate chain: encode by the wrong encoding, decode by the right one, once or twice,
where the second wrong encoding may be another than the first. The likeliest result is accepted if its log-likelihood, with
two characters of context on either side, exceeds that of the text as it stands by a margin.

The margin is the one that best separates the runs of all clean records from the same runs garbled on purpose, by
histograms of what they gain. It is cross-fitted: records are halved by a hash of their text, and the runs of either half
are scored by the model counted over the other, so no run is judged by its own record or by a copy of it. A run counts with
its window (itself and two characters on either side), and equal windows are summed in Spark and scored once. Counts,
margins and search cover all records.

The model is a table of fixed size (hashed counts), so it may be sent to every worker. Defined results: null, empty and
ASCII texts are clean; a text with replacement or stray control characters is garbled even if nothing can be restored;
repeated rows are handled each; an empty table gives empty results.
"""
from __future__ import annotations

import codecs
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillarn.session import cut, drop

#: Sizes of the hashed count tables.
TRI, BI, UNI = 1 << 22, 1 << 21, 1 << 17
SLOTS = TRI + BI + UNI
#: So many windows are scored at once for the margins; a worker sends on what it has summed from so many on.
RUNS, SUMMED = 2000, 200_000
SMOOTHING = 2.0
#: Runs with a character less likely than this (natural logarithm) are put through the chains.
GATE = -5.0
MARGINS = [0.5 * i for i in range(41)]

# Encodings text is wrongly read by, those that read UTF-8 and those that read another 8-bit encoding.
OVER_UTF8 = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp866", "koi8-r", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-15"]
OVER_8BIT = [(x, y) for y in ("cp1252", "cp1250", "mac_roman", "cp1251", "cp437", "cp850") for x in ("cp1251", "mac_roman", "cp437", "cp850", "cp1252", "cp1250", "koi8-r", "cp866") if x != y]
MULTI_BYTE = [(x, y) for x in ("cp1252", "latin-1") for y in ("shift_jis", "euc_jp", "gbk")]
# What clean text in Latin letters or kana is made of; other results of reading a run as UTF-8 prove nothing.
PLAIN = re.compile("[\u00a0-\u017f\u0192\u02c6\u02dc\u2010-\u203a\u20ac\u2122\u3000-\u30ff]")
#: Logarithm of the odds that each byte of a sequence which reads as plain UTF-8 does so by chance.
CHANCE = 2.0
RUN = re.compile(r"[^\x00-\x7f]+")
LOST = re.compile("[�\x80-\x84\x86-\x9f]")


#: What stands for a byte without a character in the tables of ``codecs``.
NONE = "\ufffe"


def _table(encoding: str) -> str:
    """The character of each byte; bytes an encoding leaves out stand for themselves, as lenient decoders have it."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b) if 0x80 <= b < 0xA0 else NONE)
    return "".join(chars)


class Chain:
    """Undo reading ``right`` bytes by the encoding ``wrong``."""

    def __init__(self, wrong: str, right: str):
        self.wrong, self.right = wrong, right
        self.char = _table(wrong)
        self.byte = codecs.charmap_build(self.char)
        if right == "utf-8":

            def of(a: int, b: int) -> str:
                return "[" + "".join(re.escape(c) for c in self.char[a:b] if c != NONE) + "]"

            tail = of(0x80, 0xC0)
            self.pattern = re.compile(f"{of(0xC2, 0xE0)}{tail}|{of(0xE0, 0xF0)}{tail}{{2}}|{of(0xF0, 0xF5)}{tail}{{3}}")
        else:
            self.to = _table(right) if right not in {"shift_jis", "euc_jp", "gbk"} else None

    def _raw(self, text: str) -> bytes:
        return codecs.charmap_encode(text, "strict", self.byte)[0]

    def _whole(self, m: re.Match) -> str:
        try:
            return self._raw(m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    def undo(self, run: str) -> str:
        try:
            raw = self._raw(run)
            if self.right != "utf-8" and self.to is not None:
                return codecs.charmap_decode(raw, "strict", self.to)[0]
            return raw.decode(self.right)
        except UnicodeError:
            return self.pattern.sub(self._whole, run) if self.right == "utf-8" else run

    def garble(self, text: str) -> str:
        """Read ``text`` wrongly, or give it back where that can't be."""
        try:
            return codecs.charmap_decode(text.encode(self.right), "strict", self.char)[0]
        except UnicodeError:
            return text


_CHAINS: list[Chain] = []


def chains() -> list[Chain]:
    if not _CHAINS:
        _CHAINS.extend([Chain(x, "utf-8") for x in OVER_UTF8] + [Chain(*p) for p in OVER_8BIT + MULTI_BYTE])
    return _CHAINS


@lru_cache(1 << 16)
def _repairs(run: str) -> tuple[tuple[str, bool], ...]:
    """What the chains make of a run, and whether that changes one 8-bit encoding for another."""
    if run.isspace():
        return ()
    made = {c.undo(run): c.right != "utf-8" for c in reversed(chains())}
    # what reads as UTF-8 may have been read wrongly before, by this encoding or another
    for once in [x for x, narrow in made.items() if x != run and not narrow]:
        for c in chains():
            if c.right == "utf-8":
                twice = c.undo(once)
                if twice != once:
                    made[twice] = False
    # words of letters alone don't hide other letters: read as UTF-8 they give plain text or mean what they say
    return tuple((x, narrow) for x, narrow in made.items() if x != run and (narrow or not run.isalpha() or all(PLAIN.match(c) for c in x if c not in run)))


@lru_cache(1 << 16)
def _reads(run: str) -> bool:
    """Whether a run holds what reads as plain UTF-8 under another encoding."""
    return any(PLAIN.fullmatch(c._whole(m)) for c in chains() if c.right == "utf-8" for m in c.pattern.finditer(run))


def _suspect(text: str) -> bool:
    """Whether a text has characters that read as plain UTF-8 under another encoding, or lost ones."""
    return LOST.search(text) is not None or any(len(r) > 1 and _reads(r) for r in set(RUN.findall(text)))


def _latin(c: str) -> bool:
    return c.isalpha() and (c < "\u0250" or "\u1e00" <= c < "\u1f00")


@lru_cache(1 << 16)
def _unnatural(window: str) -> bool:
    """Whether a run, given with one character on either side, stands where its characters hardly can: a symbol or a letter
    of another script inside a Latin word, or a capital after a small letter."""
    for a, c, b in zip(window, window[1:], window[2:]):
        if c.isspace() or c in "’‘·-‐‑":
            continue
        if c.isalpha():
            if (c.isupper() and a.islower() and _latin(a)) or (not _latin(c) and (_latin(a) or _latin(b))):
                return True
        elif a.isalpha() and b.isalpha() and (_latin(a) or _latin(b)):
            return True
    return False


def _window(text: str, a: int, b: int, n: int = 2) -> str:
    """A run of a text with ``n`` characters on either side, blanks beyond the text's ends."""
    return text[max(0, a - n) : a].rjust(n) + text[a:b] + text[b : b + n].ljust(n)


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.where((c >= 49) & (c <= 57), np.uint64(48), c)


def _hash(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def _slots(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the trigram, bigram and character that end at each position from the third on."""
    return (
        (_hash(c[:-2], c[1:-1], c[2:]) % np.uint64(TRI)).astype(np.int64),
        (_hash(c[1:-1], c[2:]) % np.uint64(BI)).astype(np.int64),
        (_hash(c[2:]) % np.uint64(UNI)).astype(np.int64),
    )


class Model:
    """The smoothed trigram model."""

    def __init__(self, counts: np.ndarray):
        self.tri, self.bi, self.uni = np.split(counts.astype(np.float32), [TRI, TRI + BI])
        self.total = float(self.uni.sum(dtype=np.float64))
        #: By whether a repair changes one 8-bit encoding for another; until validated.
        self.margin = {True: 5.0, False: 1.0}

    def logp(self, text: str, own: np.ndarray | float = 1.0) -> np.ndarray:
        """log P of each character of ``text`` given the two before; 0 for the first two. ``own``: how often a place of
        ``text`` was counted itself, which doesn't speak for it."""
        c = _codes(text)
        if len(c) < 3:
            return np.zeros(len(c))
        t, b, u = _slots(c)
        before = (_hash(c[:-2], c[1:-1]) % np.uint64(BI)).astype(np.int64)
        prior = (_hash(c[1:-1]) % np.uint64(UNI)).astype(np.int64)
        own = own[2:] if isinstance(own, np.ndarray) else own
        p = (np.maximum(self.uni[u] - own, 0) + 0.1) / (self.total + 0.1 * UNI)
        p = (np.maximum(self.bi[b] - own, 0) + SMOOTHING * p) / (np.maximum(self.uni[prior] - own, 0) + SMOOTHING)
        p = (np.maximum(self.tri[t] - own, 0) + SMOOTHING * p) / (np.maximum(self.bi[before] - own, 0) + SMOOTHING)
        return np.append(np.zeros(2), np.log(p))

    def scores(self, windows: list[str], own: np.ndarray) -> np.ndarray:
        """Log-likelihood of each window but for its first two characters; ``own``: how often each was counted."""
        if not windows:
            return np.zeros(0)
        n = np.fromiter(map(len, windows), np.int64, len(windows))
        lp = self.logp("".join(windows), np.repeat(own, n))
        starts = np.cumsum(n) - n
        for k in (0, 1):
            lp[starts + k] = 0
        return np.add.reduceat(lp, starts)

    def gains(self, asked: list[tuple[str, int]]) -> list[tuple[str, bool, float] | None]:
        """For each window with the times it was counted itself, the likeliest repair of its run, whether that changes one
        8-bit encoding for another, and what it gains; None where no chain changes the run."""
        windows, ask, at = [], [], []
        for window, _ in asked:
            at.append(len(windows))
            run = window[2:-2]
            windows.append(window)
            ask.append((run, False))
            for fixed, narrow in _repairs(run):
                windows.append(window[:2] + fixed + window[-2:])
                ask.append((fixed, narrow))
        own = np.zeros(len(windows), np.float32)
        own[at] = [n for _, n in asked]
        s = self.scores(windows, own)
        at.append(len(windows))
        out: list[tuple[str, bool, float] | None] = []
        for first, last in zip(at, at[1:]):
            run = ask[first][0]
            for i in range(first + 1, last):
                new, narrow = ask[i]
                if not narrow and all(PLAIN.match(c) for c in new if c not in run):
                    s[i] += CHANCE * (len(run) - len(new))
            # what reads as UTF-8 goes before a change of letters
            best = min(range(first + 1, last), key=lambda i: (ask[i][1] or s[i] - s[first] <= self.margin[False], -s[i]), default=None)
            out.append(None if best is None else (*ask[best], float(s[best] - s[first])))
        return out

    def unlikely(self, texts: list[str]) -> list[list[re.Match]]:
        """The runs of each text with a character below the gate."""
        joined = "\n\n".join(["", *texts, ""])
        lp = self.logp(joined)
        c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        low = lp < GATE
        low[:-1] |= low[1:]
        low[:-1] |= low[1:]
        bad = np.flatnonzero(low & (c > 127))
        starts = 2 + np.append(0, np.cumsum(np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))))
        mine: dict[int, set[int]] = {}
        for p, k in zip(bad.tolist(), (np.searchsorted(starts, bad, side="right") - 1).tolist()):
            mine.setdefault(k, set()).add(p - int(starts[k]))
        none: set[int] = set()
        # what can't stand as it is goes through the chains however often a text repeats it
        return [[m for m in RUN.finditer(t) if not mine.get(k, none).isdisjoint(range(*m.span())) or _unnatural(_window(t, *m.span(), 1))] for k, t in enumerate(texts)]

    def tally(self, windows: list[tuple[str, int]]) -> np.ndarray:
        """Histograms over the margins of what the runs of clean windows gain, and of what the same runs garbled do, each
        window as often as it stands: by whether the repair is narrow, by whether the run was garbled, by how many margins
        the gain exceeds. A window is garbled by one of the usual chains, named by its hash."""
        usual = [c for c in chains() if c.wrong in {"cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"} and c.right in {"utf-8", "cp1252"}]
        out = np.zeros((2, 2, len(MARGINS) + 1), np.int64)
        for i in range(0, len(windows), RUNS):
            good, bad = windows[i : i + RUNS], []
            for w, n in good:
                run = w[2:-2]
                wrong = usual[zlib.crc32(w.encode("utf-8", "surrogatepass")) % len(usual)].garble(run)
                if wrong != run and RUN.fullmatch(wrong):
                    bad.append((w[:2] + wrong + w[-2:], n))
            for garbled, part in enumerate((good, bad)):
                for found, (_, n) in zip(self.gains([(w, 0) for w, _ in part]), part):
                    if found:
                        out[int(found[1]), garbled, np.searchsorted(MARGINS, found[2])] += n
        return out

    def settle(self, tallies: np.ndarray) -> None:
        """Set the margins by the sum of all tallies."""
        for narrow in (True, False):
            good, bad = tallies[int(narrow)]
            if bad.sum():
                worth = (bad.sum() - np.cumsum(bad)[:-1]) / bad.sum() - (good.sum() - np.cumsum(good)[:-1]) / max(1, good.sum())
                best = np.flatnonzero(worth >= worth.max() - 1e-9)
                self.margin[narrow] = max(2.0 if narrow else 0.0, MARGINS[int(best[0])])


def _batches(texts: list, size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Slices of about ``size`` characters."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def windows_of(text: str) -> list[str]:
    """The windows of all runs of a text."""
    return [_window(text, *m.span()) for m in RUN.finditer(text)]


def train(documents: DataFrame) -> Model:
    """Count the model over all clean records, and set its margins by their windows."""
    texts = documents.select(F.col("text").alias("t")).where(F.length("t") > 0)

    def batch(half: list, windows: Counter) -> pa.RecordBatch:
        slots = [np.flatnonzero(h) for h in half]
        n = np.concatenate([h[s] for h, s in zip(half, slots)])
        sides = np.concatenate([np.full(len(s), i, np.int8) for i, s in enumerate(slots)])
        keys = list(windows)
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([pa.array(sides), pa.array([k[0] for k in keys], pa.int8())]),
            pa.concat_arrays([pa.array(np.concatenate(slots), pa.int32()), pa.nulls(len(keys), pa.int32())]),
            pa.concat_arrays([pa.nulls(len(n), pa.string()), pa.array([k[1] for k in keys], pa.string())]),
            pa.concat_arrays([pa.array(n), pa.array(list(windows.values()), pa.int64())]),
        ], ["half", "slot", "window", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, windows = [np.zeros(SLOTS, np.int64) for _ in (0, 1)], Counter()
        for b in batches:
            halves: tuple[list, list] = ([], [])
            for t in b.column(0).to_pylist():
                plain = t.isascii()
                if plain or not _suspect(t):
                    side = zlib.crc32(t.encode("utf-8", "surrogatepass")) & 1
                    halves[side].append(t)
                    if not plain:
                        windows.update((side, w) for w in windows_of(t))
            for side, clean in enumerate(halves):
                for i, j in _batches(clean):
                    for at, slots, size in zip((0, TRI, TRI + BI), _slots(_codes("\n\n".join(["", *clean[i:j], ""]))), (TRI, BI, UNI)):
                        total[side][at : at + size] += np.bincount(slots, minlength=size)
            if len(windows) > SUMMED:
                yield batch([np.zeros(0, np.int64)] * 2, windows)
                windows = Counter()
        yield batch(total, windows)

    sums = cut(texts.mapInArrow(count, "half tinyint, slot int, window string, n bigint").groupBy("half", "slot", "window").agg(F.sum("n").alias("n")), "counts")
    counts = np.zeros((2, SLOTS), np.float32)
    for side in (0, 1):
        part = sums.where((F.col("half") == side) & F.col("slot").isNotNull()).select("slot", "n").toArrow()
        counts[side, part.column("slot").to_numpy()] = part.column("n").to_numpy()
    held = documents.sparkSession.sparkContext.broadcast(counts)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others: dict[int, Model] = {}
        total = np.zeros((2, 2, len(MARGINS) + 1), np.int64)
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            for side in (0, 1):
                mine = [(w, n) for h, w, n in rows if h == side]
                if mine:
                    if side not in others:
                        others[side] = Model(held.value[1 - side])
                    total += others[side].tally(mine)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["slot", "n"])

    tallies = np.zeros((2, 2, len(MARGINS) + 1), np.int64)
    # the chains are tried once for each run: its windows come together
    windows = sums.where("window is not null").select("half", "window", "n").repartition(2 * documents.sparkSession.sparkContext.defaultParallelism, F.expr("substring(window, 3, length(window) - 4)"))
    for slot, n in windows.mapInArrow(tally, "slot int, n bigint").groupBy("slot").agg(F.sum("n")).collect():
        tallies.ravel()[slot] = n
    held.unpersist()
    drop(sums)
    model = Model(counts.sum(axis=0))
    model.settle(tallies)
    return model


def restored(documents: DataFrame) -> DataFrame:
    """(doc_id, text, repaired, lost) of each garbled document: the text as far as it could be restored, the runs that
    were, and the characters that stay lost."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            ids, all_texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in _batches(all_texts):
                texts = all_texts[i:j]
                runs = m.unlikely(texts)
                # equal windows, counted equally often in their texts, are scored once
                asked: dict[tuple[str, int], tuple[str, bool, float] | None] = {}
                at = []
                for text, found in zip(texts, runs):
                    near = [text[max(0, x.start() - 1) : x.end() + 1] for x in found]
                    often = {x: text.count(x) for x in set(near)}
                    at.append([(x, (_window(text, *x.span()), often[y])) for x, y in zip(found, near)])
                    asked.update(dict.fromkeys(key for _, key in at[-1]))
                asked = dict(zip(asked, m.gains(list(asked))))
                rows = []
                for k, text in enumerate(texts):
                    good = [(x, asked[key][:2]) for x, key in at[k] if asked[key] and asked[key][2] > m.margin[asked[key][1]]]
                    # UTF-8 proves itself; a change of letters needs one that can't stand as it is
                    sure = any(narrow and _unnatural(_window(text, *x.span(), 1)) for x, (_, narrow) in good)
                    taken = [(x, new) for x, (new, narrow) in good if sure or not narrow]
                    if not taken and not LOST.search(text):
                        continue
                    out, a = [], 0
                    for x, new in taken:
                        out += [text[a : x.start()], new]
                        a = x.end()
                    fixed = "".join([*out, text[a:]])
                    rows.append((ids[i + k], fixed, len(taken), len(LOST.findall(fixed))))
                cols = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["doc_id", "text", "repaired", "lost"])

    odd = documents.where(F.col("text").rlike(r"[^\x00-\x7f]")).select("doc_id", "text")
    return odd.mapInArrow(run, f"doc_id {kind}, text string, repaired int, lost int")
