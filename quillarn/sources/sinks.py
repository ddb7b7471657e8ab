"""Writers: canonical JSON lines with a digest, manifests and receipts, tables that may be written once, tables to read."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sorted(x: Column, kind: T.DataType) -> Column:
    """A value with the fields of all its structs in the order of their names."""
    if isinstance(kind, T.StructType):
        inside = F.struct(*[_sorted(x[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(x.isNotNull(), inside)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(x, lambda e: _sorted(e, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(x)))
    return x


def canonical_json(df: DataFrame) -> Column:
    """A row as JSON with all fields in the order of their names, without blanks, and nulls written."""
    return F.to_json(F.struct(*[_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, key: str = "stable_id") -> str:
    """Canonical JSON lines in the order of ``key``; files are ordered ranges of it. An existing path raises. Gives the
    digest of the rows."""
    df.select(key, canonical_json(df).alias("value")).orderBy(key).select("value").write.mode("errorifexists").text(path)
    return digest(df).first().digest


def digest(df: DataFrame, *by: str) -> DataFrame:
    """(by, rows, digest): a digest of a table's rows that doesn't depend on their order but on how often each comes: the sums
    of four 64-bit parts of SHA-256 of the canonical rows."""
    h = F.sha2(canonical_json(df), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).alias(f"_{i}") for i in range(4)]
    out = (df.groupBy(*by) if by else df.groupBy()).agg(F.count("*").alias("rows"), *parts)
    return out.select(*by, "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[F.coalesce(F.col(f"_{i}").cast("string"), F.lit("0")) for i in range(4)]), 256).alias("digest"))


def write_once(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def publish(df: DataFrame, path: str) -> bool:
    """Write a table, or check that what is there is the same; True if it was written."""
    try:
        write_once(df, path)
        return True
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
    if digest(df).first() != digest(df.sparkSession.read.schema(df.schema).parquet(path)).first():
        raise ValueError(f"{path} holds something else")
    return False


def append_log(records: DataFrame, path: str) -> None:
    """Add records to a log of JSON lines; what was there stays as it is."""
    records.select(canonical_json(records).alias("value")).write.mode("append").text(path)


def manifest(df: DataFrame, schema_version: str, dataset: str, split: str, sources: dict[str, str]) -> DataFrame:
    """(schema_version, dataset, split, row_count, digest, sources): the manifest of a table, ``sources`` by name and
    digest."""
    named = F.map_from_arrays(F.array(*map(F.lit, sorted(sources))), F.array(*[F.lit(sources[k]) for k in sorted(sources)])) if sources else F.create_map().cast("map<string,string>")
    return digest(df).select(F.lit(schema_version).alias("schema_version"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.col("rows").alias("row_count"), "digest", named.alias("sources"))


def write_dataset(df: DataFrame, root: str, schema_version: str, split: str, sources: dict[str, str]) -> None:
    """A data set as ordered JSON lines beside its manifest. Rows of more than one ``dataset`` raise."""
    names = [r.dataset for r in df.select("dataset").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError(f"one data set a file, not {names}")
    write_jsonl(df, f"{root}/{names[0]}.jsonl")
    m = manifest(df, schema_version, names[0], split, sources)
    m.select(F.to_json(F.struct(*sorted(m.columns))).alias("value")).coalesce(1).write.mode("errorifexists").text(f"{root}/{names[0]}.manifest")


def unpinned(df: DataFrame, expected: dict[str, tuple[int, str]]) -> DataFrame:
    """(dataset, rows, digest) of data sets whose rows or digest aren't the pinned ones, or that nobody expects."""
    want = df.sparkSession.createDataFrame([(k, n, d) for k, (n, d) in expected.items()], "dataset string, _rows bigint, _digest string")
    got = digest(df, "dataset").join(want, "dataset", "full")
    return got.where(~(F.col("rows").eqNullSafe(F.col("_rows")) & F.col("digest").eqNullSafe(F.col("_digest")))).select("dataset", "rows", "digest")


def closure(found: DataFrame, expected: DataFrame, *key: str) -> DataFrame:
    """(key, side) of files or artifacts that are there but not expected, or expected but not there."""
    f, e = found.select(*key).distinct(), expected.select(*key).distinct()
    return f.exceptAll(e).withColumn("side", F.lit("extra")).union(e.exceptAll(f).withColumn("side", F.lit("missing")))


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """(relative_path, problem) between two listings of files: those that are gone, new, or of another size, time or digest."""
    cols = [c for c in ("size", "modified", "sha256") if c in before.columns and c in now.columns]
    x, y = (d.select("relative_path", F.struct(*cols).alias(n)) for d, n in ((before, "_a"), (now, "_b")))
    both = x.join(y, "relative_path", "full")
    why = F.when(F.col("_b").isNull(), "gone").when(F.col("_a").isNull(), "new").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.withColumn("problem", why).where("problem is not null").select("relative_path", "problem")


def receipt_problems(receipts: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(name, field) of receipts (name, receipt as JSON) whose fields aren't the expected ones."""
    off = F.array_compact(F.array(*[F.when(~F.get_json_object("receipt", f"$.{k}").eqNullSafe(F.lit(v)), F.lit(k)) for k, v in expected.items()]))
    return receipts.select("name", F.explode(off).alias("field"))


def cache_manifest(spans: DataFrame) -> DataFrame:
    """(path, spans, tokens): spans and predicted tokens (one less than a span has) of each file of a span cache (path, span,
    ids), and of all of them under a null path."""
    n = F.greatest(F.lit(0), F.size("ids") - 1)
    each = spans.groupBy("path").agg(F.count("*").alias("spans"), F.sum(n).alias("tokens"))
    return each.union(spans.agg(F.lit(None).cast("string").alias("path"), F.count("*").alias("spans"), F.sum(n).alias("tokens")))


def merge_shards(parts: DataFrame, part: str, sizes: str, offset: str) -> DataFrame:
    """``parts`` whose offsets, which begin at 0 in each part, are moved to where the part stands behind the others."""
    from pyspark.sql import Window

    n = parts.groupBy(part).agg(F.sum(sizes).alias("_n"))
    ahead = n.select(part, (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(part)) - F.col("_n")).alias("_ahead"))
    return parts.join(F.broadcast(ahead), part).withColumn(offset, F.col(offset) + F.col("_ahead")).drop("_ahead")


def staged_inputs(captures: DataFrame, wanted: DataFrame, *cell: str) -> DataFrame:
    """(cell, root) of the one completed capture of each wanted cell; none or several raise."""
    n = captures.where("complete").groupBy(*cell).agg(F.count("*").alias("_n"), F.min("root").alias("root"))
    one = F.when(F.col("_n") == 1, F.col("root")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("not one capture:"), *[F.col(c).cast("string") for c in cell])).cast("string"))
    return wanted.select(*cell).distinct().join(n, list(cell), "left").select(*cell, one.alias("root"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def table_lines(table: DataFrame, key: str, columns: list[str], scaled: list[str] = (), order: str | None = None) -> DataFrame:
    """(place, line): a small table as Markdown: two decimals, ``scaled`` columns by 100, ``nan`` for what is missing."""
    from pyspark.sql import Window

    shown = [F.format_string("%.2f", F.coalesce(F.col(c).cast("double") * (100 if c in scaled else 1), F.lit(float("nan")))) for c in columns]
    body = table.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order or key)).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", key, *shown), F.lit(" |")).alias("line"))
    head = ["| " + " | ".join([key, *columns]) + " |", "|" + "---|" * (len(columns) + 1)]
    return table.sparkSession.createDataFrame([(i - 1, h) for i, h in enumerate(head)], "place int, line string").union(body)


def plot_points(cells: DataFrame, methods: list[str]) -> DataFrame:
    """(method, x, y, coefficient) of trade-off curves: harm against correction; cells whose net effect isn't their
    difference raise."""
    off = F.abs(F.col("net_em") - (F.col("correction_contribution") - F.col("harm_contribution"))) > 1e-6
    y = F.when(off, F.raise_error(F.lit("the net effect isn't the difference")).cast("double")).otherwise(F.col("correction_contribution"))
    return cells.where(F.col("method").isin(methods)).select("method", F.col("harm_contribution").alias("x"), y.alias("y"), "coefficient")


def write_staged(df: DataFrame, root: str, name: str) -> str:
    """A table under a name of its own, published by one rename: a reader sees all of it or nothing. An existing one raises."""
    spark: SparkSession = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    final, temporary = path(f"{root}/{name}"), path(f"{root}/.staging-{name}")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise ValueError(f"{final} is there already")
    df.write.mode("overwrite").parquet(temporary.toString())
    if not fs.rename(temporary, final):
        raise ValueError(f"{final} couldn't be published")
    return final.toString()
