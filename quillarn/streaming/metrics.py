"""The training log as a stream, and work that is done exactly once."""
from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The log's files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def records(steps: DataFrame) -> DataFrame:
    """The log's records of raw steps: hours of all workers are what the clock says by the number of them."""
    hours = F.col("wall_seconds") * F.col("world_size") / 3600
    names = ["step", "optimizer_step", "epoch", "epoch_fraction", "seen_tokens", "ce", "kl", "loss", "lr", "tokens_per_s", "wall_seconds", "gpu_hours", "world_size", "attempt_id", "resume_from_step", "logged_at"]
    return steps.withColumns({"optimizer_step": F.col("step"), "gpu_hours": hours}).select(*names)


def status(log: DataFrame, steps: int) -> DataFrame:
    """(value): where a run stands by its last record, as JSON: phase, step, share of the steps, tokens and hours."""
    last = log.where("step is not null").agg(F.max_by(F.struct("step", "seen_tokens", "gpu_hours", "loss"), F.struct("step", "logged_at")).alias("r")).select("r.*")
    phase = F.when(F.col("step").isNull(), "starting").when(F.col("step") >= steps, "complete").otherwise("running")
    return last.select(F.to_json(F.struct(phase.alias("phase"), "step", F.round(F.col("step") / steps, 6).alias("share"), "seen_tokens", "gpu_hours", "loss")).alias("value"))


def intervals(log: DataFrame, every: int = 1000, late: str = "30 days") -> DataFrame:
    """Means of each ``every`` steps, over rows sent once; rows later than ``late`` are dropped with their state."""
    if log.isStreaming:
        log = log.withWatermark("logged_at", late)
    rows = log.where(F.col("step").isNotNull()).dropDuplicates(["attempt_id", "step", "logged_at"])
    return rows.groupBy(F.floor(F.col("step") / every).alias("interval")).agg(F.count("*").alias("rows"), F.round(F.avg("loss"), 6).alias("loss"), F.round(F.avg("ce"), 6).alias("ce"), F.max("seen_tokens").alias("seen_tokens"))


def windows(log: DataFrame, length: str = "1 hour", late: str = "30 days") -> DataFrame:
    """Means of each stretch of time, over rows sent once. Time closes a stretch, so its state ends with the watermark and
    the stream can append it to files."""
    if log.isStreaming:
        log = log.withWatermark("logged_at", late)
    rows = log.where(F.col("step").isNotNull() & F.col("logged_at").isNotNull()).dropDuplicates(["attempt_id", "step", "logged_at"])
    w = rows.groupBy(F.window("logged_at", length).alias("w")).agg(F.count("*").alias("rows"), F.round(F.avg("loss"), 6).alias("loss"), F.max("step").alias("last_step"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "loss", "last_step")


def append(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append what a stream closes to a table of files."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_available(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """All that has arrived, through the stream into a table in memory; for reports and tests of few rows."""
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def ledger(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, key: str = "job_id") -> StreamingQuery:
    """Do each job of a stream once: of a batch, those without a receipt are worked on, the results written and then the
    receipts, both under the batch's number. A batch that is run again after a failure overwrites its own results and finds
    the receipts of all earlier ones, so no job counts twice."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        done = path(f"{root}/receipts")
        fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
        fresh = batch.dropDuplicates([key])
        if fs.exists(done):
            earlier = spark.read.schema(f"{key} {batch.schema[key].dataType.simpleString()}, batch bigint").parquet(f"{root}/receipts").where(F.col("batch") != number)
            fresh = fresh.join(earlier.select(key), key, "left_anti")
        fresh = fresh.persist()
        work(fresh).write.mode("overwrite").parquet(f"{root}/results/batch={number}")
        fresh.select(key).write.mode("overwrite").parquet(f"{root}/receipts/batch={number}")
        fresh.unpersist()

    return jobs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def contract_digest(contract: dict) -> str:
    return hashlib.sha256(json.dumps(contract, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def agreed(spark: SparkSession, contract: dict, checkpoint: str) -> None:
    """Tie a checkpoint to the settings it was begun with: the first run stores them, a later one with others raises and
    names the fields that differ."""
    path = f"{checkpoint}/contract"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    text = json.dumps(contract, sort_keys=True, separators=(",", ":"), allow_nan=False)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        return
    stored = json.loads(spark.read.text(path).first().value)
    off = sorted(k for k in stored.keys() | contract.keys() if k not in stored or k not in contract or type(stored[k]) is not type(contract[k]) or stored[k] != contract[k])
    if off:
        raise ValueError(f"the run's settings changed: {off}")


def complete_rows(lines: DataFrame, batch: int) -> DataFrame:
    """Of the lines (ordinal, value) a broken run left, those a resumed one keeps: whole JSON lines from the first on, as many
    as whole batches."""
    broken = lines.where(F.try_parse_json("value").isNull()).agg(F.min("ordinal").alias("_broken"))
    n = lines.agg(F.count("*").alias("_n"))
    most = F.floor(F.coalesce("_broken", "_n") / batch) * batch
    return lines.crossJoin(F.broadcast(broken)).crossJoin(F.broadcast(n)).where(F.col("ordinal") < most).select("ordinal", "value")


class Heartbeat(StreamingQueryListener):
    """Keeps the last progress of each query and hands it on."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"query": str(event.id), "phase": "started"})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"query": str(p.id), "phase": "running", "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        self.tell({"query": str(event.id), "phase": "idle"})

    def onQueryTerminated(self, event) -> None:
        self.tell({"query": str(event.id), "phase": "failed" if event.exception else "ended"})
