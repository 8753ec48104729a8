"""Micro-batches: ingest with quarantine and resumption, progress, latency windows."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files, some in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


RETRIED = (ConnectionError, TimeoutError, OSError)


def delays(tries: int, base: float = 1.0, most: float = 30.0, jitter: Callable[[], float] = random.random) -> list[float]:
    """Seconds between tries: doubled each time, and up to one more by chance, ``most`` at most."""
    return [min(base * 2**i + jitter(), most) for i in range(tries - 1)]


def retried(work: Callable[[], None], tries: int = 4, base: float = 1.0, most: float = 30.0, errors: tuple = RETRIED, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> int:
    """Do ``work``, again after errors that may pass; the number of tries it took. The last error, and any other, is raised."""
    waits = delays(tries, base, most, jitter)
    for i in range(tries):
        try:
            work()
            return i + 1
        except errors:
            if i == len(waits):
                raise
            sleep(waits[i])
    raise ValueError("no tries")


def ingest(rows: DataFrame, out: str, checkpoint: str, valid: Column, transform: Callable[[DataFrame], DataFrame] | None = None, retry: Callable[[Callable[[], None]], int] = retried) -> StreamingQuery:
    """Valid rows to ``out``/good, others to ``out``/quarantine; a restart goes on where the last run stopped.

    Each micro-batch writes into a folder of its number, so that a repeated
    batch replaces what it wrote before. A batch whose ``transform`` still fails
    after its tries goes to ``out``/failed as it came, and the next ones go on.
    """

    def each(batch: DataFrame, n: int) -> None:
        ok = F.coalesce(valid, F.lit(False))
        good, bad = batch.where(ok), batch.where(~ok)
        bad.write.mode("overwrite").parquet(f"{out}/quarantine/batch={n}")
        try:
            retry(lambda: (transform(good) if transform else good).write.mode("overwrite").parquet(f"{out}/good/batch={n}"))
        except RETRIED:
            good.write.mode("overwrite").parquet(f"{out}/failed/batch={n}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency_windows(events: DataFrame, ts: str = "ts", value: str = "value", every: str = "5 minutes", late: str | None = None, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Count, mean and 95th percentile of windows; on a stream, with ``late`` as the watermark."""
    e = events.withColumn("t_", F.col(ts).cast("timestamp"))
    if late is not None:
        e = e.withWatermark("t_", late)
    g = e.groupBy(F.window("t_", every).alias("w"), *by)
    p95 = F.percentile_approx(value, 0.95, 10000)
    return g.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), p95.alias("p95")).select(F.col("w.start").alias("start"), *by, "n", "mean", "p95")


def alerts(windows: DataFrame, limit: float) -> DataFrame:
    return windows.where(F.col("p95") > limit)


def progress(query: StreamingQuery) -> dict:
    """State of a run: how many batches and rows, and whether it is active."""
    done = query.recentProgress
    return {"active": query.isActive, "batches": len(done), "rows": sum(p["numInputRows"] for p in done), "error": str(query.exception()) if query.exception() else None}
