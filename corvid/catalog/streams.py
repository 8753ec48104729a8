"""Micro-batches over the events table."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from ..plans import retrieval as R
from ..plans import review as V
from ..streaming import ingest as I
from ..streaming import metrics as M
from ..streaming.tasks import Tasks
from .base import query
from .scans import scratch


RISKS = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' WHEN '3' THEN 'low' ELSE 'none' END"


@query(
    "r1_progress_events",
    f"""WITH f AS (SELECT o_custkey AS review_id, o_orderkey AS clause, {RISKS} AS risk, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
       g AS (SELECT review_id, count(*) AS n, 'high:' || count(*) FILTER (risk = 'high') || ' medium:' || count(*) FILTER (risk = 'medium') || ' low:' || count(*) FILTER (risk = 'low') || ' none:' || count(*) FILTER (risk = 'none') AS counts FROM f GROUP BY 1)
       SELECT review_id, 2 * i - 2 AS seq, 'progress' AS event, i || '/' || n AS payload FROM f UNION ALL SELECT review_id, 2 * i - 1, 'finding', clause || ':' || risk FROM f
       UNION ALL SELECT review_id, 2 * n, 'summary', counts FROM g UNION ALL SELECT review_id, 2 * n + 1, 'done', CAST(n AS VARCHAR) FROM g""",
)
def r1(t):
    """The events of each review in their order; a service sends those of one with ``sources.tables.events``."""
    return V.review_events(t.orders.select(F.col("o_custkey").alias("review_id"), F.col("o_orderkey").alias("clause"), F.expr(RISKS).alias("risk")))


def _ingested(t) -> str:
    base = scratch(t.spark)
    t.events.withColumn("ts", F.col("ts").cast("timestamp")).repartition(4, "event_id").write.parquet(f"{base}/in")
    schema = t.spark.read.parquet(f"{base}/in").schema.simpleString()[7:-1]
    ddl = ", ".join(f"{x.split(':', 1)[0]} {x.split(':', 1)[1]}" for x in schema.split(","))
    failed = set()

    def unsteady(batch):
        """Work that fails the first time it is asked for: the batch is tried again."""
        if not failed:
            failed.add(True)
            raise ConnectionError("once")
        return batch

    for _ in range(2):  # the second run resumes, and finds nothing left
        q = I.ingest(I.stream(t.spark, f"{base}/in", ddl), f"{base}/out", f"{base}/state", F.col("value") >= 10, unsteady, lambda work: I.retried(work, base=0.01, jitter=lambda: 0.0))
        q.awaitTermination()
    return base


@query("r3_quarantine", "SELECT CASE WHEN value >= 10 THEN 'good' ELSE 'quarantine' END AS state, count(*) AS n FROM events GROUP BY 1")
def r3(t):
    base = _ingested(t)
    n = lambda s: t.spark.read.parquet(f"{base}/out/{s}").agg(F.lit(s).alias("state"), F.count("*").alias("n"))
    return n("good").unionByName(n("quarantine"))


@query("r4_resume", "SELECT event_id FROM events WHERE value >= 10")
def r4(t):
    return t.spark.read.parquet(f"{_ingested(t)}/out/good").select("event_id")


@query("r7_latency_windows", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def r7(t):
    w = I.latency_windows(t.events)
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


BOUNDS = [10, 25, 50, 100, 150, 250]
SIX_HOURS = 6 * 3600


@query(
    "r7_histogram_alerts",
    """WITH b AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, [count(*) FILTER (value <= 10), count(*) FILTER (value <= 25), count(*) FILTER (value <= 50), count(*) FILTER (value <= 100), count(*) FILTER (value <= 150), count(*) FILTER (value <= 250), count(value)] AS c FROM events GROUP BY 1, 2),
       i AS (SELECT *, 0.95 * c[7] AS rank, len(list_filter(c, lambda x: x < 0.95 * c[7])) AS i FROM b WHERE c[7] > 0),
       p AS (SELECT start, event_type, CASE WHEN i >= 6 THEN 250.0 ELSE CAST([0, 10, 25, 50, 100, 150, 250][i + 1] AS DOUBLE) + ([10, 25, 50, 100, 150, 250][i + 1] - [0, 10, 25, 50, 100, 150, 250][i + 1]) * coalesce((rank - CASE WHEN i > 0 THEN c[i] ELSE 0 END) / nullif(c[i + 1] - CASE WHEN i > 0 THEN c[i] ELSE 0 END, 0), 0) END AS p95 FROM i),
       o AS (SELECT *, CASE WHEN start - lag(start) OVER w = INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM p WHERE p95 > 120 WINDOW w AS (PARTITION BY event_type ORDER BY start)),
       r AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY start) AS run FROM o)
       SELECT start, event_type, round(p95, 6) AS p95, CASE WHEN start - min(start) OVER (PARTITION BY event_type, run) >= INTERVAL '12 hours' THEN 'firing' ELSE 'pending' END AS state FROM r""",
)
def r7b(t):
    """The 95th percentile of each window from its buckets, and alerts where it stays above a limit for twelve hours."""
    h = M.histogram(t.events, BOUNDS, "6 hours", ["event_type"])
    p = h.select("start", "event_type", M.quantile(F.col("counts"), BOUNDS, 0.95).alias("p95"))
    a = M.alerts(p, ["event_type"], 120.0, SIX_HOURS, 2 * SIX_HOURS)
    return a.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.round("p95", 6).alias("p95"), "state")


@query("r5_task_states", "SELECT * FROM (VALUES (0, 'count', 'completed'), (1, 'broken', 'failed'), (2, 'late', 'cancelled')) AS v (task_id, name, state)")
def r5(t):
    """One task at a time: one that ends, one that fails, and one that is cancelled before its turn."""
    tasks, go = Tasks(t.spark), threading.Event()
    tasks.submit("count", lambda: (go.wait(60), t.documents.count())[1])
    tasks.submit("broken", lambda: t.documents.select("no such column").count())
    tasks.cancel(tasks.submit("late", t.documents.count))
    go.set()
    tasks.wait()
    tasks.close()
    return tasks.states().select("task_id", "name", "state")


def letters(texts: list[str]) -> list[list[int]]:
    return [[s.count(c) for c in "aeiou"] for s in texts]


@query("r6_vector_stream", "SELECT doc_id, array_to_string([length(text) - length(replace(text, c, '')) FOR c IN ['a', 'e', 'i', 'o', 'u']], ' ') AS vector FROM documents")
def r6(t):
    """Vectors in batches as texts stream by; a count of letters stands for the model."""
    v = R.vectors(t.documents, letters)
    return v.select("doc_id", F.concat_ws(" ", F.transform("vector", lambda x: x.cast("long").cast("string"))).alias("vector"))
