"""Readers of the file forms question-answering data comes in. Rows of text files have dense ordinals in file order."""
from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QA = "stable_id string, dataset string, question string, answer string, aliases array<string>, metadata string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, value) of each line, numbered from 0 in each file; blank lines count. Compressed files are told by
    their suffix. A file is read in blocks; the lines of a block are numbered as they are read and the blocks by their
    places, so nothing is sorted. Lines end with LF, CR or both, not with other separators of Unicode."""
    at = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"), "value")
    blocks = at.groupBy("path", "block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("block")) - F.col("_n")
    return at.join(F.broadcast(blocks.withColumn("_before", before)), ["path", "block"]).select("path", (F.col("_before") + F.col("_at") - F.col("_first")).alias("ordinal"), "value")


def _filled(rows: DataFrame) -> DataFrame:
    return rows.where(F.trim("value") != "")


def jsonl(spark: SparkSession, path: str, schema: str = QA, first: int | None = None) -> DataFrame:
    """One JSON object a line, of the first ``first`` lines if that is given; blank lines are skipped, broken ones raise."""
    rows = _filled(lines(spark, path))
    if first is not None:
        rows = rows.where(F.col("ordinal") < first)
    return rows.select("ordinal", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("ordinal", "x.*")


def json_array(spark: SparkSession, path: str, schema: str = QA) -> DataFrame:
    """One array of objects a file, with their places."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{_nested(schema)}>>", {"mode": "FAILFAST"}).alias("xs"))
    return whole.select(F.posexplode("xs").alias("ordinal", "x")).select(F.col("ordinal").cast("bigint").alias("ordinal"), "x.*")


def _nested(schema: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)


def json_or_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value): a file's JSON values: those of its lines if the first line is a value and others follow, else the
    elements of its one array, or its one object."""
    head = [r.value for r in _filled(lines(spark, path)).where("ordinal < 1000").orderBy("ordinal").limit(2).collect()]
    if len(head) == 2 and spark.range(1).select(F.try_parse_json(F.lit(head[0])).isNotNull()).first()[0]:
        return _filled(lines(spark, path)).select("ordinal", "value")
    whole = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("value"))
    parts = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>", {"mode": "FAILFAST"})).otherwise(F.array("value"))
    return whole.select(F.posexplode(parts).alias("ordinal", "value")).select(F.col("ordinal").cast("bigint").alias("ordinal"), "value")


def _fields(rows: DataFrame, columns: list[str], header: bool, parts: Column, n: Column) -> DataFrame:
    if header:
        rows = rows.where("ordinal > 0")
    wrong = F.raise_error(F.format_string(f"line %d has not {len(columns)} fields", F.col("ordinal"))).cast("array<string>")
    kept = rows.select("ordinal", F.when(n, parts).otherwise(wrong).alias("f"))
    return kept.select((F.col("ordinal") - int(header)).alias("ordinal"), *[F.col("f")[i].alias(c) for i, c in enumerate(columns)])


def tsv(spark: SparkSession, path: str, columns: list[str], header: bool = False, quoted: bool = False, filled: bool = False) -> DataFrame:
    """Tab-separated text with exactly these columns; another number of fields raises, and so does a blank one if they must
    be ``filled``. With a header the first line is skipped and ordinals count the rows after it. ``quoted`` fields may be in
    double quotes, doubled inside. Blank lines are skipped but counted by the ordinals."""
    rows = _filled(lines(spark, path))
    k = len(columns)
    if quoted:
        names = [f"c{i}" for i in range(k + 1)]
        x = F.from_csv("value", ", ".join(f"{n} string" for n in names), {"sep": "\t", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\u0000"})
        parts, ok = F.array(*[x[n] for n in names[:k]]), x[names[k - 1]].isNotNull() & x[names[k]].isNull()
    else:
        parts = F.split("value", "\t", -1)
        ok = F.size(parts) == k
    if filled:
        ok = ok & F.forall(parts, lambda p: F.trim(p) != "")
    return _fields(rows, columns, header, parts, ok)


def validated_corpus(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """(ordinal, value, text) of JSON lines from ``start`` on; a blank line, a line that is no object and one without a text
    raise with their ordinals."""
    rows = lines(spark, path).where(F.col("ordinal") >= start)
    text = F.get_json_object("value", "$.text")
    why = F.when(F.trim("value") == "", "is blank").when(~F.ltrim("value").startswith("{") | F.try_parse_json("value").isNull(), "is no object").when(F.coalesce(F.trim(text), F.lit("")) == "", "has no text")
    bad = F.raise_error(F.concat(F.lit("line "), F.col("ordinal").cast("string"), F.lit(" "), why)).cast("string")
    return rows.select("ordinal", "value", F.when(why.isNull(), text).otherwise(bad).alias("text"))


def with_fallbacks(rows: DataFrame) -> DataFrame:
    """(doc_ix, doc_id, text) of documents (doc_ix, value as JSON): the id is the first of ``id``, ``_id`` and the place that
    is neither missing, empty nor the number 0; the text that of ``text`` or ``passage``."""
    raw = lambda n: F.get_json_object("value", f"$.{n}")
    number = F.try_variant_get(F.try_parse_json("value"), "$.id", "bigint") if hasattr(F, "try_variant_get") else F.lit(None)
    zero = F.col("value").rlike(r'"id"\s*:\s*0\s*[,}]') & (number == 0)
    own = F.when(~F.coalesce(zero, F.lit(False)), F.nullif(raw("id"), F.lit("")))
    return rows.select("doc_ix", F.coalesce(own, F.nullif(raw("_id"), F.lit("")), F.col("doc_ix").cast("string")).alias("doc_id"), F.coalesce(F.nullif(raw("text"), F.lit("")), raw("passage")).alias("text"))


def fetched(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """``hits`` with id and text of their places: the few places meet the documents, which needn't be read by offset."""
    few = documents.join(hits.select("doc_ix").distinct(), "doc_ix", "left_semi")
    return hits.join(with_fallbacks(few), "doc_ix")


def zip_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, member, content) of the members of ZIP files whose names match a regular expression, one member at a time; an
    archive is one task, as ZIP can't be split."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, raw in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for n in sorted(z.namelist()):
                        if re.search(pattern, n):
                            yield pd.DataFrame({"path": [p], "member": [n], "content": [z.read(n)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, content binary")


def relations(spark: SparkSession, path: str) -> DataFrame:
    """(relation, ordinal, question, answers) of an archive with one JSON array a relation, ``dev/<relation>.dev.json``."""
    m = zip_members(spark, path, r"(^|/)dev/[^/]+\.dev\.json$")
    items = F.from_json(F.decode("content", "utf-8"), "array<struct<question: string, answers: array<string>>>", {"mode": "FAILFAST"})
    return m.select(F.regexp_extract("member", r"([^/.]+)\.[^/]*$", 1).alias("relation"), F.posexplode(items).alias("ordinal", "x")).select("relation", F.col("ordinal").cast("bigint").alias("ordinal"), "x.*")


def arrow_ipc(spark: SparkSession, path: str, schema: T.StructType | str, first: int | None = None) -> DataFrame:
    """Rows of Arrow IPC files, in the file or the stream format, record batch by record batch; of the first files in the
    order of their names if ``first`` is given."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                try:
                    reader = pa.ipc.open_file(pa.BufferReader(raw))
                    parts = (reader.get_batch(i) for i in range(reader.num_record_batches))
                except pa.ArrowInvalid:
                    parts = iter(pa.ipc.open_stream(pa.BufferReader(raw)))
                for part in parts:
                    for at in range(0, len(part), 10_000):
                        yield part.slice(at, 10_000)

    files = spark.read.format("binaryFile").load(path)
    if first is not None:
        names = sorted(r.path for r in files.select("path").collect())[:first]
        files = files.where(F.col("path").isin(names))
    return files.select("content").mapInArrow(run, schema)


def shards(listed: list[str] | dict, most: int = 0, job: int = 0, jobs: int = 1) -> list[str]:
    """A job's share of a list of shards (or of an object's ``selected_shards``): in order, at most ``most`` in all, every
    ``jobs``-th."""
    names = listed.get("selected_shards") if isinstance(listed, dict) else listed
    if not isinstance(names, list) or not all(isinstance(n, str) for n in names):
        raise ValueError("shards are a list of paths")
    return sorted(names)[: most or None][job::jobs]


def npz(spark: SparkSession, path: str, teacher: bool = False) -> DataFrame:
    """(path, span, ids) of span caches: arrays ``span_ids`` and ``span_lens``; with ``teacher`` one row for each predicted
    token, (path, span, row, teacher_tok, teacher_prob). Arrays that don't fit the lengths raise."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, raw in zip(b["path"], b["content"]):
                with np.load(io.BytesIO(raw)) as z:
                    n = z["span_lens"].astype(int)
                    if not teacher:
                        ids = z["span_ids"]
                        parts = [r[:k] for r, k in zip(ids, n)] if ids.ndim == 2 else np.split(ids.ravel(), np.cumsum(n)[:-1])
                        yield pd.DataFrame({"path": p, "span": range(len(parts)), "ids": [x.astype("int32") for x in parts]})
                        continue
                    rows = np.maximum(n - 1, 0)
                    if not len(z["teacher_tok"]) == len(z["teacher_prob"]) == rows.sum():
                        raise ValueError(f"{p}: the teacher's rows don't fit the spans")
                    span = np.repeat(np.arange(len(n)), rows)
                    yield pd.DataFrame({"path": p, "span": span, "row": np.arange(len(span)), "teacher_tok": list(z["teacher_tok"].astype("int32")), "teacher_prob": list(z["teacher_prob"].astype("float32"))})

    schema = "path string, span int, row int, teacher_tok array<int>, teacher_prob array<float>" if teacher else "path string, span int, ids array<int>"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, values) of an array of one or two dimensions."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, raw in zip(b["path"], b["content"]):
                a = np.load(io.BytesIO(raw))
                a = a.reshape(len(a), -1)
                for at in range(0, len(a), 10_000):
                    part = a[at : at + 10_000].astype("float64")
                    yield pd.DataFrame({"path": p, "row": np.arange(at, at + len(part)), "values": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row bigint, values array<double>")


def cells(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files named ``<dataset>/<coefficient>.<kind>.jsonl``, with the three parts as columns."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)\.(\w+)\.jsonl$", 0)
    part = lambda i: F.regexp_extract(name, r"([^/]+)/([^/]+)\.(\w+)\.jsonl$", i)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumns({"dataset": part(1), "coefficient": part(2).cast("double"), "kind": part(3)})


def cell_path(root: str, dataset: str, coefficient: float, kind: str) -> str:
    return f"{root}/{dataset}/{coefficient:.8g}.{kind}.jsonl"


def first_that_reads(sources: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that can be read, tried in order; if none can, an error that names all failures."""
    failures = []
    for s in sources:
        try:
            df = s()
            df.limit(1).count()
            return df
        except Exception as e:  # any reason is reason to try the next
            failures.append(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
    raise ValueError("no source can be read: " + "; ".join(failures))


def files(spark: SparkSession, root: str, hashed: bool = True) -> DataFrame:
    """(relative_path, size, modified, sha256) of all files under a folder; hashing reads them, each in one task."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    name = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + re.escape(base), "")
    return b.select(name.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *([F.sha2("content", 256).alias("sha256")] if hashed else []))


def reusable(spark: SparkSession, path: str, sha256: str) -> bool:
    """Whether a file is there with the pinned digest; another digest raises."""
    try:
        got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    if got[0] != sha256:
        raise ValueError(f"{path} isn't the pinned file")
    return True


def tasks(spark: SparkSession, root: str, rows: str, identity: dict[str, str]) -> DataFrame:
    """The rows of finished tasks: files ``tasks/<name>.json`` with ``rows``, each with a receipt ``<name>.receipt.json`` that
    has its digest and the identity. A file without a receipt, or with another digest or identity, raises."""
    f = spark.read.format("binaryFile").load(f"{root}/tasks/*.json").select("path", F.decode("content", "utf-8").alias("text"), F.sha2("content", 256).alias("sha"))
    name = F.regexp_replace("path", r"(\.receipt)?\.json$", "")
    is_receipt = F.col("path").endswith(".receipt.json")
    r = f.where(is_receipt).select(name.alias("name"), F.col("text").alias("receipt"))
    both = f.where(~is_receipt).select(name.alias("name"), "text", "sha").join(r, "name", "left")
    ok = F.get_json_object("receipt", "$.sha256") == F.col("sha")
    for k, v in identity.items():
        ok = ok & (F.get_json_object("receipt", f"$.{k}") == v)
    text = F.when(F.coalesce(ok, F.lit(False)), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no valid receipt: "), F.col("name"))).cast("string"))
    return both.select(F.from_json(text, f"struct<rows: array<struct<{_nested(rows)}>>>", {"mode": "FAILFAST"})["rows"].alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
