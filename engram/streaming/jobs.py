"""Periodic jobs and streams over the store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engram.operators import consolidate, embed, lifecycle, store
from engram.plans.staging import stage

#: A client's bucket is forgotten after this idle time.
IDLE_SECONDS = 300


def every(spark: SparkSession, seconds: int, job: Callable[[int], None]) -> DataStreamWriter:
    """Run ``job`` each period; a failed run is repeated by restarting the query from its checkpoint."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.trigger(processingTime=f"{seconds} seconds").foreachBatch(lambda _, no: job(no))


def decay_job(spark: SparkSession, path: str) -> Callable[[int], None]:
    """Decay and prune the published snapshot, and publish the next version."""

    def run(_: int) -> None:
        snap = store.current(spark, path)
        version = 1 + max(int(x) for x in _versions(spark, path))
        store.publish(lifecycle.decay_and_prune(snap, F.current_timestamp()), path, version)

    return run


def consolidation_job(spark: SparkSession, path: str, inputs: Callable[[store.Snapshot], tuple[DataFrame, DataFrame, DataFrame]], report: Callable[[DataFrame], None] | None = None) -> Callable[[int], None]:
    """Consolidate the published snapshot and publish the next version. ``inputs``: its timeline, tool nodes and entity terms."""

    def run(_: int) -> None:
        snap = store.current(spark, path)
        version = 1 + max(int(x) for x in _versions(spark, path))
        after, counters = consolidate.consolidate(snap, *inputs(snap), F.current_timestamp())
        store.publish(after, path, version)
        if report is not None:
            report(counters)

    return run


def backfill_job(spark: SparkSession, path: str, model: embed.Model, name: str, dimensions: int) -> Callable[[int], None]:
    """Embed the records that have no vector yet, and publish the next version if there are any."""

    def run(_: int) -> None:
        snap = store.current(spark, path)
        embeddings, added = embed.backfill(snap.embeddings, embed.record_texts(snap.records), model, name, dimensions, F.current_timestamp())
        if not (added := stage(added)).isEmpty():
            version = 1 + max(int(x) for x in _versions(spark, path))
            store.publish(snap.having(embeddings=embeddings), path, version)

    return run


def _versions(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return [n[1:] for n in names if n.startswith("v") and n[1:].isdigit()]


def capture_stream(requests: DataFrame, write: Callable[[DataFrame, int], None], late: str = "1 hour", key: str = "request_id") -> DataStreamWriter:
    """Each micro-batch of requests (with ``timestamp``) goes to ``write`` once; redelivered ones within ``late`` are dropped."""
    return requests.withWatermark("timestamp", late).dropDuplicatesWithinWatermark([key]).writeStream.foreachBatch(write)


def _spend(tokens: float, last: float | None, at: float, rate: float, burst: float) -> tuple[bool, float]:
    tokens = burst if last is None or at - last > IDLE_SECONDS else min(burst, tokens + (at - last) * rate)
    return (True, tokens - 1) if tokens >= 1 else (False, tokens)


def admit(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """A batch of requests (client, request_id, t) with ``admitted`` by a token bucket for each client.

    Each client's requests are read in order, batch by batch, with the bucket carried on: a client with any number of
    requests takes no more memory. Rows without a client or a time are refused."""

    def bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, tokens, last = None, burst, None
        for pdf in batches:
            out = []
            for c, at in zip(pdf["client"], pdf["at"]):
                if c != client:
                    client, tokens, last = c, burst, None
                if pd.isna(c) or pd.isna(at):
                    out.append(False)
                    continue
                ok, tokens = _spend(tokens, last, at, rate, burst)
                last = at
                out.append(ok)
            yield pdf.drop(columns="at").assign(admitted=out)

    ordered = requests.select("client", "request_id", "t", (F.unix_micros("t") / 1e6).alias("at")).repartition("client").sortWithinPartitions("client", "t", "request_id")
    return ordered.mapInPandas(bucket, "client string, request_id long, t timestamp, admitted boolean")


def admit_stream(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """The same on a stream, with each client's bucket as state that ends when it is idle."""

    def bucket(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        for pdf in batches:
            pdf = pdf.sort_values(["t", "request_id"])
            out = []
            for at in pdf["t"].map(pd.Timestamp.timestamp):
                ok, tokens = _spend(tokens, last, at, rate, burst)
                last = at
                out.append(ok)
            yield pdf.assign(admitted=out)[["client", "request_id", "admitted"]]
        state.update((tokens, last))
        state.setTimeoutDuration(IDLE_SECONDS * 1000)

    return requests.select("client", "request_id", "t").groupBy("client").applyInPandasWithState(
        bucket, "client string, request_id long, admitted boolean", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def running_requests(requests: DataFrame, seconds: int) -> DataFrame:
    """Requests of each client within the last ``seconds`` before each one."""
    w = Window.partitionBy("client").orderBy(F.col("t").cast("double")).rangeBetween(-seconds, 0)
    return requests.withColumn("recent", F.count("*").over(w))
