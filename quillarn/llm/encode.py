"""Problem 8: whole texts as the ids of a public byte-level BPE tokenizer.

The JVM cuts each text into the words the tokenizer merges within. Each Arrow batch is reduced to its distinct words, and
those a worker has not met yet are merged by recursive DuckDB queries over token-position rows: join the rows with the
merge table, contract each word's leftmost pair of least rank, until no pair is left. A recursive query keeps the rows of
all its rounds, so it ends after ``ROUNDS``; words that are not done go on from there, and as no merge of the vocabulary
makes a pair of lower rank, each further round contracts all the word's pairs of least rank at once, from the left. So a
word of any length goes the same way, with rows in proportion to its length. The words' ids are laid out in text order.

``decode`` joins ids with the vocabulary and aggregates the pieces in order.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text; any
character is encodable, since the alphabet is the 256 bytes. Repeated rows are encoded each; other columns don't matter.
Ids that aren't in the vocabulary can't be decoded and raise; null ids give a null text.
"""
from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("QUILLARN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json"
#: Words a worker remembers before it forgets them all.
KNOWN_WORDS = 400_000
#: Rows, at most, of all rounds of one recursive query, and rounds of one.
QUERY_ROWS = 3_000_000
ROUNDS = 64

# The tokenizer's word pattern; \s is spelled out because Java's own is ASCII only.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

# One round for each word: the leftmost pair of least rank.
LEFTMOST = """
WITH RECURSIVE t(w, pos, id, npos, nid, it) AS (
  SELECT w, pos, id, npos, nid, 0 FROM seed
  UNION ALL
  SELECT t.w, t.pos,
         CASE WHEN t.pos = b.pos THEN b.new ELSE t.id END,
         CASE WHEN t.pos = b.pos THEN b.nnpos ELSE t.npos END,
         CASE WHEN t.pos = b.pos THEN b.nnid WHEN t.npos = b.pos THEN b.new ELSE t.nid END,
         t.it + 1
  FROM t JOIN (
    SELECT a.w, a.pos, a.npos, a.new, n.npos AS nnpos, n.nid AS nnid
    FROM (SELECT p.w, arg_min(p.pos, m.rank * 1048576 + p.pos) AS pos, arg_min(p.npos, m.rank * 1048576 + p.pos) AS npos,
                 arg_min(m.new, m.rank * 1048576 + p.pos) AS new
          FROM t AS p JOIN merges AS m ON p.id * 65536 + p.nid = m.pair WHERE p.it < {rounds} GROUP BY p.w) AS a
    JOIN t AS n ON n.w = a.w AND n.pos = a.npos) AS b ON t.w = b.w
  WHERE t.pos <> b.npos)
SELECT w, pos, id, it FROM t QUALIFY it = max(it) OVER (PARTITION BY w) ORDER BY w, pos
"""
# One round for each word: all pairs of least rank, of overlapping ones (of a token with itself) every other from the left.
ALL = """
WITH RECURSIVE t(w, pos, id, npos, nid, it) AS (
  SELECT w, pos, id, npos, nid, 0 FROM seed
  UNION ALL
  (WITH hit AS (
     SELECT p.w, p.pos, p.npos, p.id = p.nid AS twin, m.new, m.rank FROM t AS p JOIN merges AS m ON p.id * 65536 + p.nid = m.pair WHERE p.it < {rounds}
     QUALIFY m.rank = min(m.rank) OVER (PARTITION BY p.w)),
   run AS (SELECT *, CASE WHEN twin THEN pos - (npos - pos) * row_number() OVER (PARTITION BY w ORDER BY pos) END AS first FROM hit),
   b AS (SELECT w, pos, npos, new FROM run QUALIFY NOT twin OR row_number() OVER (PARTITION BY w, first ORDER BY pos) % 2 = 1),
   busy AS (SELECT DISTINCT w FROM b),
   left_over AS (
     SELECT t.w, t.pos, coalesce(b.new, t.id) AS id, CASE WHEN b.new IS NULL THEN t.npos ELSE n.npos END AS npos, CASE WHEN b.new IS NULL THEN t.nid ELSE n.nid END AS nid, t.it + 1 AS it
     FROM t JOIN busy ON t.w = busy.w LEFT JOIN b ON b.w = t.w AND b.pos = t.pos LEFT JOIN t AS n ON n.w = b.w AND n.pos = b.npos
     WHERE NOT EXISTS (SELECT 1 FROM b AS gone WHERE gone.w = t.w AND gone.npos = t.pos))
   SELECT l.w, l.pos, l.id, l.npos, coalesce(b.new, l.nid), l.it FROM left_over AS l LEFT JOIN b ON b.w = l.w AND b.pos = l.npos))
SELECT w, pos, id, it FROM t QUALIFY it = max(it) OVER (PARTITION BY w) ORDER BY w, pos
"""
DECODE = "SELECT ids.doc, string_agg(v.piece, '' ORDER BY ids.pos) AS text FROM ids JOIN vocabulary AS v USING (id) GROUP BY ids.doc ORDER BY ids.doc"


def _byte_letters() -> dict[str, int]:
    """The printable letter byte-level vocabularies write for each byte: itself where printable, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Merger:
    """One worker's DuckDB connection with the merge table, and the words it knows."""

    def __init__(self, vocabulary: str):
        import duckdb

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        new = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1")
        self.con.execute("SET memory_limit = '400MB'")
        self.con.execute("SET temp_directory = ''")
        self.con.register("m", pa.table({"pair": left * 65536 + right, "rank": np.arange(len(merges)), "new": new}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m")
        if len(np.unique(new)) < len(new) or np.any(np.sort(new) != new):
            raise ValueError("contracting all pairs of a rank at once needs merges that make a new token each, in order")
        self.con.register("m", pa.table({"id": pa.array(list(vocab.values()), pa.int64()), "piece": list(vocab)}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM m")
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in _byte_letters().items():
            self.byte_id[b] = vocab[letter]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32)]
        self.sizes = [np.zeros(0, np.int64)]

    @staticmethod
    def portions(words: pa.Array) -> list[tuple[int, int]]:
        """Slices of words for one query each."""
        n = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        out, i, rows = [], 0, 0
        for j, k in enumerate(n.tolist()):
            k2 = k * min(k // 2 + 1, ROUNDS) + 1
            if j > i and rows + k2 > QUERY_ROWS:
                out.append((i, j))
                i, rows = j, 0
            rows += k2
        return [*out, (i, len(n))]

    def contract(self, w: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, id) of the merged tokens of words given as rows in the order of words and positions."""
        done, query = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], LEFTMOST
        while len(w):
            last = np.append(w[1:] != w[:-1], True)
            seed = pa.table({"w": w, "pos": pos, "id": ids, "npos": np.where(last, -1, np.append(pos[1:], 0)), "nid": np.where(last, -1, np.append(ids[1:], 0))})
            size = np.diff(np.append(np.flatnonzero(np.append(True, w[1:] != w[:-1])), len(w)))
            fits = (size * np.minimum(size // 2 + 1, ROUNDS)).sum() <= QUERY_ROWS
            rounds = ROUNDS if fits else max(1, min(ROUNDS, QUERY_ROWS // len(w)))
            self.con.register("seed", seed)
            out = self.con.sql(query.format(rounds=rounds)).to_arrow_table()
            self.con.unregister("seed")
            w, pos, ids, it = (out.column(k).to_numpy() for k in ("w", "pos", "id", "it"))
            open_ = it == rounds
            done.append((w[~open_], ids[~open_]))
            w, pos, ids, query = w[open_], pos[open_], ids[open_], ALL
        w, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(w, kind="stable")
        return w[order], ids[order]

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one word after the other, and how many each has."""
        words = words.cast(pa.large_string())
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int64, n + 1, words.offset * 8)
        if not n or offsets[0] == offsets[-1]:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        lengths = np.diff(offsets)
        w, i = self.contract(np.repeat(np.arange(n), lengths), np.arange(len(raw)) - np.repeat(offsets[:-1] - offsets[0], lengths), self.byte_id[raw])
        return i.astype(np.int32), np.bincount(w, minlength=n).astype(np.int64)

    def decode(self, ids: pa.ListArray) -> list[str]:
        """The texts of lists of ids; bytes that are no UTF-8 come out as U+FFFD."""
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        flat = ids.flatten()
        self.con.register("ids", pa.table({"doc": np.repeat(np.arange(len(sizes)), sizes), "pos": np.arange(len(flat)), "id": flat.cast(pa.int64())}))
        if self.con.sql("SELECT 1 FROM ids WHERE id IS NULL OR id NOT IN (SELECT id FROM vocabulary) LIMIT 1").fetchall():
            raise ValueError("there are ids that aren't in the vocabulary")
        out, letters = [""] * len(sizes), _byte_letters()
        for doc, text in self.con.sql(DECODE).fetchall():
            out[doc] = bytes(map(letters.__getitem__, text)).decode("utf-8", "replace")
        self.con.unregister("ids")
        return out

    def encode(self, words: pa.Array, sizes: np.ndarray) -> pa.ListArray:
        """The ids of texts given as their words, ``sizes`` of them each."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        names = distinct.to_pylist()
        fresh = [k for k, x in enumerate(names) if x not in self.known]
        if fresh:
            if len(self.known) + len(fresh) > KNOWN_WORDS:
                self.forget()
                fresh = list(range(len(names)))
            words = distinct.take(pa.array(fresh, pa.int64()))
            parts = [self.merge(words.slice(i, j - i)) for i, j in self.portions(words)]
            ids, counts = (np.concatenate(x) for x in zip(*parts))
            base = len(self.known)
            self.known.update((names[k], base + j) for j, k in enumerate(fresh))
            self.ids.append(ids)
            self.sizes.append(counts)
            if len(self.ids) > 1:
                self.ids, self.sizes = [np.concatenate(self.ids)], [np.concatenate(self.sizes)]
        flat, count = self.ids[0], self.sizes[0]
        starts = np.cumsum(count) - count
        slot = np.fromiter((self.known[x] for x in names), np.int64, len(names))[coded.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, np.int64)
        per = count[slot]
        ends = np.cumsum(per)
        take = np.repeat(starts[slot] - (ends - per), per) + np.arange(int(per.sum()))
        bounds = np.append(0, np.cumsum(sizes))
        offsets = np.append(0, ends)[bounds]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[take], pa.int32()))


_MERGERS: dict[str, Merger] = {}


def merger(vocabulary: str) -> Merger:
    """This worker process's merger: kept between tasks."""
    if vocabulary not in _MERGERS:
        _MERGERS[vocabulary] = Merger(vocabulary)
    return _MERGERS[vocabulary]


def _library_words(text: str) -> list[str]:
    """Words of a text with characters newer than the JVM's Unicode tables."""
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
    letters = _byte_letters()
    return [bytes(letters[c] for c in w).decode("utf-8") for w, _ in cut]


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of each row of ``documents``."""
    t = F.coalesce(F.col(text), F.lit(""))
    odd = t.rlike(r"\p{Cn}")
    cut = documents.select(
        F.col(key).alias("k"),
        F.when(~odd, F.regexp_extract_all(t, F.lit(WORDS), F.lit(0))).alias("w"),
        F.when(odd, t).alias("t"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary)
        for b in batches:
            lists, odds = b.column(1), b.column(2)
            if odds.null_count < len(odds):
                lists = pa.array([_library_words(o) if o is not None else w for w, o in zip(lists.to_pylist(), odds.to_pylist())], pa.list_(pa.string()))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), m.encode(lists.flatten(), sizes)], ["k", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return cut.mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), "ids")


def decode(rows: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of each row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                texts = m.decode(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t if ok else None for t, ok in zip(texts, part.column(1).is_valid().to_pylist())], pa.string())], ["k", "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"k {kind}, text string").select(F.col("k").alias(key), "text")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) of each row of ``documents``."""
    return encode(documents, vocabulary, key, text).select(key, F.size("ids").cast("bigint").alias("n_tokens"))
