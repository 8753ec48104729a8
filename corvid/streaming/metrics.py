"""Counters, histograms and alerts: rates with resets, quantiles from buckets, and states that last, on tables and on streams."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def increases(samples: DataFrame, series: Sequence[str], at: str = "at", value: str = "value") -> DataFrame:
    """``samples`` of counters with ``rise``: what each has grown by since the sample before. A counter that is lower than before was reset, and has grown by all it shows; the first sample tells no growth."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(at))
    return samples.withColumn("rise", F.when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def rates(samples: DataFrame, series: Sequence[str], at: str = "at", value: str = "value", seconds: int = 300) -> DataFrame:
    """``samples`` with ``rate``: growth a second over the last ``seconds``."""
    x = increases(samples, series, at, value).withColumn("s_", F.unix_micros(F.col(at).cast("timestamp")))
    last = Window.partitionBy(*series).orderBy("s_").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return x.withColumn("rate", F.sum("rise").over(last) / seconds).drop("s_", "rise")


def histogram(events: DataFrame, bounds: Sequence[float], every: str, by: Sequence[str], at: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    """(start, by, counts): in each window how many values are at most each bound, and how many there are at all; on a stream, with ``late`` as the watermark. Null values are in no bucket."""
    e = events.withColumn("t_", F.col(at).cast("timestamp"))
    if late is not None:
        e = e.withWatermark("t_", late)
    counts = F.array(*(F.count_if(F.col(value) <= b) for b in bounds), F.count(value))
    return e.groupBy(F.window("t_", every).alias("w"), *by).agg(counts.alias("counts")).select(F.col("w.start").alias("start"), *by, "counts")


def quantile(counts: Column, bounds: Sequence[float], q: float) -> Column:
    """The ``q``-quantile of a histogram, evenly spread inside a bucket: from 0 in the first; the last bound for what lies beyond it; null of nothing."""
    ends = F.array(*(F.lit(float(b)) for b in bounds))
    rank = q * F.element_at(counts, -1)
    i = F.size(F.filter(counts, lambda c: c < rank))  # buckets that end below the rank
    low, before = F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0.0)), F.when(i > 0, F.get(counts, i - 1)).otherwise(F.lit(0))
    inside = low + (F.get(ends, i) - low) * F.coalesce(F.try_divide(rank - before, F.get(counts, i) - before), F.lit(0.0))
    return F.when(F.element_at(counts, -1) > 0, F.when(i >= len(bounds), F.lit(float(bounds[-1]))).otherwise(inside))


def alerts(rows: DataFrame, by: Sequence[str], limit: float, every: int, lasting: int, value: str = "p95") -> DataFrame:
    """``rows`` (start, by, value) above ``limit`` with ``state``: pending, or firing once it has been so in each window of ``every`` seconds for ``lasting`` seconds."""
    w = Window.partitionBy(*by).orderBy("start")
    s = F.unix_seconds(F.col("start").cast("timestamp"))
    over = rows.where(F.col(value) > limit)
    new = (s - F.lag(s).over(w) != every) | F.lag(s).over(w).isNull()
    x = over.withColumn("run_", F.sum(new.cast("int")).over(w))
    since = F.min(s).over(Window.partitionBy(*by, "run_"))
    return x.withColumn("state", F.when(s - since >= lasting, "firing").otherwise("pending")).drop("run_")


def alert_stream(events: DataFrame, series: str, bounds: Sequence[float], q: float, limit: float, every: int, lasting: int, late: str, at: str = "ts", value: str = "value") -> DataFrame:
    """(series, start, quantile, state): histogram, quantile and alerts of a stream of events in one keyed state.

    The state of a series are the counts of its open windows, and since when it
    is above ``limit``. A window is final once the watermark (``late``) has
    passed it; later rows for it are left out. Null values and times count
    nowhere.
    """

    def of_counts(counts: list[int]) -> float:
        rank = q * counts[-1]
        i = sum(c < rank for c in counts)
        if i >= len(bounds):
            return float(bounds[-1])
        low, before = (bounds[i - 1], counts[i - 1]) if i else (0.0, 0)
        return low + (bounds[i] - low) * ((rank - before) / (counts[i] - before) if counts[i] > before else 0.0)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, since, last = state.get if state.exists else ("{}", -1, -1)
        windows = {int(k): v for k, v in json.loads(kept).items()}
        mark = state.getCurrentWatermarkMs() / 1000
        for pdf in () if state.hasTimedOut else frames:
            pdf = pdf[pdf["v_"].notna() & pdf["t_"].notna()]
            starts = pdf["t_"].astype("int64") // 10 ** {"ns": 9, "us": 6, "ms": 3, "s": 0}[pdf["t_"].dt.unit] // every * every
            for start, values in pdf["v_"].groupby(starts.to_numpy()):
                if start + every > mark:
                    held = windows.setdefault(int(start), [0] * (len(bounds) + 1))
                    windows[int(start)] = [c + int(n) for c, n in zip(held, [*((values <= b).sum() for b in bounds), len(values)], strict=True)]
        out = []
        for start in sorted(w for w in windows if w + every <= mark):
            p = of_counts(windows.pop(start))
            if p > limit:
                since = start if since < 0 or start - last != every else since
                out.append((key[0], pd.Timestamp(start, unit="s"), p, "firing" if start - since >= lasting else "pending"))
            else:
                since = -1
            last = start
        state.update((json.dumps(windows), since, last))
        if windows:
            state.setTimeoutTimestamp(max(int(mark * 1000) + 1, (min(windows) + every) * 1000))
        yield pd.DataFrame(out, columns=["series", "start", "quantile", "state"])

    kind = events.schema[series].dataType.simpleString()
    e = events.select(series, F.col(at).cast("timestamp").alias("t_"), F.col(value).cast("double").alias("v_")).withWatermark("t_", late)
    return e.groupBy(series).applyInPandasWithState(run, f"series {kind}, start timestamp, quantile double, state string", "windows string, since long, last long", "append", GroupStateTimeout.EventTimeTimeout)
