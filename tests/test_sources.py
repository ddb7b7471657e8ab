"""Readers, writers and streams on small files."""
import gzip
import json
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillarn.sources import files, sinks
from quillarn.streaming import metrics


def test_lines_are_numbered_densely(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for name, n in (("a", 700), ("b", 90)):
            (tmp_path / f"{name}.txt").write_text("".join(f"{name} {i}\n" * (i % 2 + 1) for i in range(n)))
        rows = files.lines(spark, str(tmp_path)).collect()
        for name in "ab":
            text = (tmp_path / f"{name}.txt").read_text().splitlines()
            mine = sorted((r.ordinal, r.value) for r in rows if r.path.endswith(f"{name}.txt"))
            assert mine == list(enumerate(text))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tsv(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    rows = files.tsv(spark, write("a.tsv", "q1\tx\n\nq2\ty\n"), ["q", "a"]).orderBy("ordinal").collect()
    assert [(r.q, r.a, r.ordinal) for r in rows] == [("q1", "x", 0), ("q2", "y", 2)]
    with pytest.raises(Exception, match="fields"):
        files.tsv(spark, write("b.tsv", "q1\tx\ty\n"), ["q", "a"]).collect()
    got = files.tsv(spark, write("c.tsv", 'q\ta\n"say ""hi"""\t[\'x\']\nq\ta\n'), ["q", "a"], header=True, quoted=True).orderBy("ordinal").collect()
    assert [(r.ordinal, r.q, r.a) for r in got] == [(0, 'say "hi"', "['x']"), (1, "q", "a")]
    for bad in ("a\n", "a\tb\tc\n"):
        with pytest.raises(Exception, match="fields"):
            files.tsv(spark, write("d.tsv", bad), ["q", "a"], quoted=True).collect()
    with pytest.raises(Exception, match="fields"):
        files.tsv(spark, write("e.tsv", "1\tx\t \ty\n"), ["i", "k", "q", "r"], filled=True).collect()
    with gzip.open(tmp_path / "f.tsv.gz", "wt") as f:
        f.write("q\tz\n")
    assert files.tsv(spark, str(tmp_path / "f.tsv.gz"), ["q", "a"]).first().a == "z"


def test_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n" + json.dumps({"stable_id": "a", "aliases": ["x"]}) + "\n" + json.dumps({"stable_id": "b"}) + "\n")
    assert files.jsonl(spark, str(tmp_path / "a.jsonl")).first().aliases == ["x"] and files.jsonl(spark, str(tmp_path / "a.jsonl"), first=2).count() == 1
    (tmp_path / "b.json").write_text(json.dumps([{"question": "q"}, {"question": "r"}]))
    assert [(r.ordinal, r.question) for r in files.json_array(spark, str(tmp_path / "b.json"), "question string").collect()] == [(0, "q"), (1, "r")]
    (tmp_path / "c.json").write_text(json.dumps({"Q1": ["a"]}, indent=1))
    assert files.json_or_lines(spark, str(tmp_path / "a.jsonl")).count() == 2 and files.json_or_lines(spark, str(tmp_path / "b.json")).count() == 2
    assert json.loads(files.json_or_lines(spark, str(tmp_path / "c.json")).first().value) == {"Q1": ["a"]}
    (tmp_path / "d.jsonl").write_text('{"text": "x"}\n{"text": " "}\n[1]\n\n')
    assert files.validated_corpus(spark, str(tmp_path / "a.jsonl"), 9).count() == 0
    for start, why in ((1, "no text"), (2, "no object"), (3, "blank")):
        with pytest.raises(Exception, match=why):
            files.validated_corpus(spark, str(tmp_path / "d.jsonl"), start).orderBy("ordinal").collect()


def test_documents_by_place(spark):
    docs = spark.createDataFrame([(0, '{"id": 0, "text": "", "passage": "p"}'), (1, '{"id": "0", "text": "t"}'), (2, '{"_id": "u", "text": "t"}')], "doc_ix bigint, value string")
    hits = spark.createDataFrame([(i, 1) for i in (0, 1, 2)], "doc_ix bigint, rank int")
    assert sorted((r.doc_id, r.text) for r in files.fetched(docs, hits).collect()) == [("0", "p"), ("0", "t"), ("u", "t")]


def test_archives_and_arrays(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/dev/P17.dev.json", json.dumps([{"question": "q", "answers": ["a"]}, {"question": "r", "answers": []}]))
        z.writestr("x/train/P17.train.json", "[]")
    assert [(r.relation, r.ordinal, r.answers) for r in files.relations(spark, str(tmp_path / "a.zip")).collect()] == [("P17", 0, ["a"]), ("P17", 1, [])]
    t = pa.table({"n": pa.array(range(25_000), pa.int64())})
    (tmp_path / "ipc").mkdir()
    with pa.ipc.new_file(tmp_path / "ipc/0.arrow", t.schema) as w:
        w.write_table(t)
    with pa.ipc.new_stream(tmp_path / "ipc/1.arrow", t.schema) as w:
        w.write_table(t)
    assert files.arrow_ipc(spark, str(tmp_path / "ipc"), "n bigint").count() == 50_000 and files.arrow_ipc(spark, str(tmp_path / "ipc"), "n bigint", first=1).count() == 25_000
    np.savez(tmp_path / "s.npz", span_ids=np.arange(8).reshape(2, 4), span_lens=np.array([4, 2]), teacher_tok=np.arange(8).reshape(4, 2).astype("int32"), teacher_prob=np.full((4, 2), 0.5, "float16"))
    assert [r.ids for r in files.npz(spark, str(tmp_path / "s.npz")).orderBy("span").collect()] == [[0, 1, 2, 3], [4, 5]]
    assert [(r.span, r.teacher_tok) for r in files.npz(spark, str(tmp_path / "s.npz"), teacher=True).orderBy("row").collect()] == [(0, [0, 1]), (0, [2, 3]), (0, [4, 5]), (1, [6, 7])]
    got = sinks.cache_manifest(files.npz(spark, str(tmp_path / "s.npz"))).where("path is null").first()
    assert (got.spans, got.tokens) == (2, 4)
    np.save(tmp_path / "a.npy", np.arange(6).reshape(3, 2))
    assert [(r.row, r["values"]) for r in files.npy(spark, str(tmp_path / "a.npy")).orderBy("row").collect()][2] == (2, [4.0, 5.0])
    assert files.shards({"selected_shards": ["c", "a", "b", "d"]}, 3, 1, 2) == ["b"]
    with pytest.raises(ValueError):
        files.shards([1])


def test_cells(spark, tmp_path):
    (tmp_path / "nq").mkdir()
    path = files.cell_path(str(tmp_path), "nq", 0.75, "predictions")
    with open(path, "w") as f:
        f.write('{"stable_id": "a"}\n')
    r = files.cells(spark, f"{tmp_path}/*/*.predictions.jsonl", "stable_id string").first()
    assert (r.dataset, r.coefficient, r.kind) == ("nq", 0.75, "predictions")


def test_fallback_and_pins(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    df = files.first_that_reads([lambda: spark.read.text(str(tmp_path / "none")), lambda: spark.read.text(str(tmp_path / "a.txt"))])
    assert df.first().value == "x"
    with pytest.raises(ValueError, match="no source"):
        files.first_that_reads([lambda: spark.read.text(str(tmp_path / "none"))])
    import hashlib

    sha = hashlib.sha256(b"x").hexdigest()
    assert files.reusable(spark, str(tmp_path / "a.txt"), sha) and not files.reusable(spark, str(tmp_path / "b.txt"), sha)
    with pytest.raises(ValueError, match="pinned"):
        files.reusable(spark, str(tmp_path / "a.txt"), "0")


def test_listings_and_tasks(spark, tmp_path):
    import hashlib

    (tmp_path / "tasks").mkdir()
    body = json.dumps({"rows": [{"stable_id": "a"}, {"stable_id": "b"}]})
    (tmp_path / "tasks/0.json").write_text(body)
    (tmp_path / "tasks/0.receipt.json").write_text(json.dumps({"sha256": hashlib.sha256(body.encode()).hexdigest(), "run": "r"}))
    assert {r.stable_id for r in files.tasks(spark, str(tmp_path), "stable_id string", {"run": "r"}).collect()} == {"a", "b"}
    with pytest.raises(Exception, match="receipt"):
        files.tasks(spark, str(tmp_path), "stable_id string", {"run": "other"}).collect()
    before = spark.createDataFrame(files.files(spark, str(tmp_path)).collect(), files.files(spark, str(tmp_path)).schema)
    assert {r.relative_path for r in before.collect()} == {"tasks/0.json", "tasks/0.receipt.json"}
    (tmp_path / "tasks/0.json").write_text(body + " ")
    (tmp_path / "tasks/1.json").write_text("{}")
    assert {tuple(r) for r in sinks.changed_files(before, files.files(spark, str(tmp_path))).collect()} == {("tasks/0.json", "changed"), ("tasks/1.json", "new")}
    want = spark.createDataFrame([("tasks/0.json",), ("tasks/9.json",), ("tasks/0.receipt.json",)], "relative_path string")
    assert {tuple(r) for r in sinks.closure(files.files(spark, str(tmp_path)), want, "relative_path").collect()} == {("tasks/1.json", "extra"), ("tasks/9.json", "missing")}
    r = spark.createDataFrame([("a", '{"status": "complete", "n": 3}')], "name string, receipt string")
    assert [x.field for x in sinks.receipt_problems(r, {"status": "complete", "n": "4"}).collect()] == ["n"]


def test_digests(spark):
    one = spark.createDataFrame([(1,), (1,)], "n int")
    two = spark.createDataFrame([(2,), (2,)], "n int")
    d = lambda x: sinks.digest(x).first().digest
    assert d(one) != d(two) and d(one) == d(one.repartition(3)) and d(one) != d(one.limit(1)) and d(one.limit(0)) != d(one)
    nested = spark.createDataFrame([((1, "x"),)], "s struct<b:int,a:string>")
    assert nested.select(sinks.canonical_json(nested)).first()[0] == '{"s":{"a":"x","b":1}}'


def test_publish(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "stable_id string, n int")
    path = str(tmp_path / "t")
    assert sinks.publish(df, path) and not sinks.publish(df.repartition(3), path)
    with pytest.raises(ValueError):
        sinks.publish(df.withColumn("n", F.lit(5)), path)
    assert sinks.write_staged(df, str(tmp_path), "s").endswith("/s")
    with pytest.raises(ValueError, match="already"):
        sinks.write_staged(df, str(tmp_path), "s")


def test_data_sets(spark, tmp_path):
    df = spark.createDataFrame([("b", "nq", 2), ("a", "nq", 1)], "stable_id string, dataset string, n int")
    sinks.write_dataset(df, str(tmp_path / "d"), "v1", "test", {"src": "0f"})
    lines = "".join(p.read_text() for p in sorted((tmp_path / "d/nq.jsonl").glob("part-*"))).splitlines()
    assert [json.loads(x)["stable_id"] for x in lines] == ["a", "b"] and lines[0] == '{"dataset":"nq","n":1,"stable_id":"a"}'
    m = json.loads("".join(p.read_text() for p in (tmp_path / "d/nq.manifest").glob("part-*")))
    assert m["row_count"] == 2 and m["sources"] == {"src": "0f"} and m["digest"] == sinks.digest(df).first().digest
    with pytest.raises(ValueError, match="one data set"):
        sinks.write_dataset(df.withColumn("dataset", F.col("stable_id")), str(tmp_path / "e"), "v1", "test", {})
    pins = {"nq": (2, sinks.digest(df, "dataset").first().digest)}
    assert sinks.unpinned(df, pins).count() == 0 and sinks.unpinned(df.limit(1), pins).count() == 1
    sinks.append_log(df.limit(1), str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 3
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == df.columns


def test_tables_and_shards(spark):
    t = spark.createDataFrame([("b", 0.5, 3.0), ("a", None, 2.0)], "method string, em double, ppl double")
    assert [r.line for r in sinks.table_lines(t, "method", ["em", "ppl"], ["em"]).orderBy("place").collect()] == ["| method | em | ppl |", "|---|---|---|", "| a | NaN | 2.00 |", "| b | 50.00 | 3.00 |"]
    parts = spark.createDataFrame([(0, 2, 0), (0, 3, 2), (1, 4, 0)], "part int, n int, at bigint")
    assert sorted(r.at for r in sinks.merge_shards(parts, "part", "n", "at").collect()) == [0, 2, 5]
    caps = spark.createDataFrame([("c", "x", True), ("c", "y", False), ("d", "z", True), ("d", "w", True)], "cell string, root string, complete boolean")
    assert sinks.staged_inputs(caps, caps.where("cell = 'c'"), "cell").first().root == "x"
    with pytest.raises(Exception, match="capture"):
        sinks.staged_inputs(caps, caps, "cell").collect()
    cells = spark.createDataFrame([("m", 0.3, 0.1, 0.2, 0.5), ("n", 0.3, 0.1, 0.1, 0.5)], "method string, correction_contribution double, harm_contribution double, net_em double, coefficient double")
    assert tuple(sinks.plot_points(cells, ["m"]).first()) == ("m", 0.1, 0.3, 0.5)
    with pytest.raises(Exception, match="difference"):
        sinks.plot_points(cells, ["n"]).collect()


# Streams


def log(spark, n=30):
    return spark.createDataFrame([(i, "a", i * 1.0) for i in range(n)], "step bigint, attempt_id string, loss double").withColumns({"ce": F.col("loss"), "seen_tokens": F.col("step"), "logged_at": F.timestamp_seconds(F.col("step") * 600 + 1_000_000)})


def test_stream(spark, tmp_path):
    df = log(spark)
    df.union(df).write.parquet(str(tmp_path / "log"))
    stream = metrics.intervals(metrics.read_log(spark, str(tmp_path / "log"), df.schema), every=10)
    got = metrics.run_available(stream, "intervals", str(tmp_path / "cp"))
    assert {r.interval: r.loss for r in got.collect()} == {0: 4.5, 1: 14.5, 2: 24.5}


def test_windows_are_appended_and_forgotten(spark, tmp_path):
    """Closed stretches are appended once; the stream forgets them, and rows that come too late change nothing."""
    df = log(spark)
    df.union(df.limit(5)).coalesce(1).write.parquet(str(tmp_path / "log"))

    def run():
        stream = metrics.windows(metrics.read_log(spark, str(tmp_path / "log"), df.schema), "1 hour", "1 hour")
        metrics.append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run()
    batch = {tuple(r) for r in metrics.windows(df, "1 hour").collect()}
    assert first and set(first) <= batch and len(set(r[0] for r in first)) == len(first)
    df.limit(1).withColumn("loss", F.lit(99.0)).write.mode("append").parquet(str(tmp_path / "log"))
    assert run() == first


def test_ledger(spark, tmp_path):
    jobs = spark.createDataFrame([(i,) for i in range(6)], "job_id bigint")
    jobs.union(jobs).write.parquet(str(tmp_path / "jobs"))
    work = lambda d: d.select("job_id", (F.col("job_id") * 2).alias("x"))

    def run():
        s = spark.readStream.schema("job_id bigint").parquet(str(tmp_path / "jobs"))
        metrics.ledger(s, work, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "out/results")).collect())

    assert run() == list(range(6))
    spark.createDataFrame([(5,), (9,)], "job_id bigint").write.mode("append").parquet(str(tmp_path / "jobs"))
    assert run() == [0, 1, 2, 3, 4, 5, 9]


def test_contracts_and_resumes(spark, tmp_path):
    cp = str(tmp_path / "cp")
    metrics.agreed(spark, {"lr": 0.1, "steps": 3}, cp)
    metrics.agreed(spark, {"steps": 3, "lr": 0.1}, cp)
    with pytest.raises(ValueError, match="lr"):
        metrics.agreed(spark, {"lr": 0.2, "steps": 3}, cp)
    with pytest.raises(ValueError, match="steps"):
        metrics.agreed(spark, {"lr": 0.1, "steps": 3.0}, cp)
    lines = spark.createDataFrame([(i, '{"a": 1}' if i < 7 else '{"a"') for i in range(8)], "ordinal bigint, value string")
    assert metrics.complete_rows(lines, 4).count() == 4 and metrics.complete_rows(lines.where("ordinal < 7"), 1).count() == 7


def test_heartbeat(spark, tmp_path):
    import time

    told = []
    listener = metrics.Heartbeat(told.append)
    spark.streams.addListener(listener)
    try:
        log(spark).write.parquet(str(tmp_path / "log"))
        metrics.append(metrics.windows(metrics.read_log(spark, str(tmp_path / "log"), log(spark).schema)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        for _ in range(50):
            if any(t["phase"] == "ended" for t in told):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert {"started", "running", "ended"} <= {t["phase"] for t in told}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from quillarn import session

    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host"

            @staticmethod
            def getConf():
                return Fake.conf

    with pytest.raises(ValueError, match="share"):
        session.shared_dir(Fake)


def test_records_and_status(spark):
    raw = log(spark, 3).withColumns({"epoch": F.lit(0), "epoch_fraction": F.lit(0.1), "kl": F.lit(0.0), "lr": F.lit(0.1), "tokens_per_s": F.lit(1.0), "wall_seconds": F.lit(1800.0), "world_size": F.lit(4), "resume_from_step": F.lit(None).cast("bigint")})
    r = metrics.records(raw)
    assert {x.gpu_hours for x in r.collect()} == {2.0}
    s = json.loads(metrics.status(r, 4).first().value)
    assert (s["phase"], s["step"], s["share"], s["gpu_hours"]) == ("running", 2, 0.5, 2.0)
    assert json.loads(metrics.status(r.limit(0), 4).first().value)["phase"] == "starting"
