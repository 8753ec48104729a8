"""Rates, quantiles from buckets and alerts, on tables and on a stream that is late and starts again."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corvid.streaming import metrics as M

T0 = dt.datetime(2024, 1, 1)
BOUNDS = [1.0, 2.0, 5.0]


def test_rates_over_resets(spark):
    values = [5, 9, 9, 2, 4, 100]  # a reset before the 2
    df = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=100 * i), v) for i, v in enumerate(values)] + [("b", T0, 7)], "s string, at timestamp, value long")
    got = [round(r["rate"] * 300) for r in M.rates(df, ["s"]).where("s = 'a'").orderBy("at").collect()]
    rises = [0, 4, 0, 2, 2, 96]
    assert got == [sum(rises[max(0, i - 2) : i + 1]) for i in range(6)]
    assert M.increases(df, ["s"]).where("s = 'b'").first()["rise"] == 0


@pytest.mark.parametrize(("counts", "q", "want"), [([0, 10, 10, 10], 0.5, 1.5), ([4, 4, 8, 8], 0.75, 3.5), ([0, 0, 0, 9], 0.5, 5.0), ([10, 10, 10, 10], 0.95, 0.95), ([0, 0, 0, 0], 0.5, None), ([2, 2, 2, 4], 0.5, 1.0)])
def test_quantiles(spark, counts, q, want):
    got = spark.range(1).select(M.quantile(F.array(*map(F.lit, counts)), BOUNDS, q).alias("v")).first()["v"]
    assert got == pytest.approx(want) if want is not None else got is None


def minutes(values):
    return [("s", T0 + dt.timedelta(minutes=m), v) for m, v in values]


def test_alerts_last(spark):
    rows = minutes([(0, 3.0), (1, 3.0), (2, 3.0), (3, 1.0), (4, 3.0), (6, 3.0), (7, 3.0), (8, 3.0), (9, 3.0)])  # below at 3, nothing at 5
    df = spark.createDataFrame(rows, "k string, start timestamp, p95 double")
    got = {int((r["start"] - T0).total_seconds() / 60): r["state"] for r in M.alerts(df, ["k"], 2.0, 60, 120).collect()}
    assert got == {0: "pending", 1: "pending", 2: "firing", 4: "pending", 6: "pending", 7: "pending", 8: "firing", 9: "firing"}


def test_a_stream_gives_what_the_table_gives(spark, tmp_path):
    rnd = random.Random(1)
    event = lambda m, v=None: (rnd.choice("ab"), T0 + dt.timedelta(minutes=m, seconds=rnd.randrange(60)), v or rnd.choice([0.5, 1.5, 4.0, 4.5]))
    first = [event(m) for m in range(20) for _ in range(6)]
    second = [event(m) for m in range(18, 30) for _ in range(6)] + [event(0, 99.0)] * 50  # and rows that come too late
    files = [first, second, [("a", T0 + dt.timedelta(hours=5), 0.5)], [("b", T0 + dt.timedelta(hours=9), None)]]
    schema = "k string, ts timestamp, value double"

    def run(n):
        spark.createDataFrame(files[n], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        a = M.alert_stream(s, "k", BOUNDS, 0.95, 3.0, 60, 120, "5 minutes")
        a.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination()

    for n in range(4):  # each run goes on from the state of the one before
        run(n)
    table = spark.createDataFrame(first + [e for e in second if e[2] < 99], schema)
    p = M.histogram(table, BOUNDS, "1 minute", ["k"]).select("start", "k", M.quantile(F.col("counts"), BOUNDS, 0.95).alias("p95"))
    want = sorted((r["k"], r["start"], round(r["p95"], 9), r["state"]) for r in M.alerts(p, ["k"], 3.0, 60, 120).collect())
    got = sorted((r["series"], r["start"], round(r["quantile"], 9), r["state"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == want and {w[3] for w in want} == {"pending", "firing"}
