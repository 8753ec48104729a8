"""Vectors in lists around centres, with radii that bound what a list can hold.

Centres come from k-means over a bounded sample; every vector then lies in the
list of its nearest centre. A list keeps its radius: the widest angle between
its centre and a vector of it. A vector of the list is no nearer to a query than
the angle to the centre less the radius, so that, once a query has as many hits
as asked for, lists that cannot better the worst of them are not read (exact),
or only the nearest lists are read at all (``probe``).

    path/vectors/list=...   doc_id, v (unit length)
    path/lists              list, centre, radius, n
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import tables as T
from . import retrieval as R

SAMPLE = 100_000  # vectors that centres are fitted on, at most
BLOCK = 2048  # queries, and vectors of a list, that meet in a task
FIRST = 2  # lists read before any bound is known
SLACK = 1e-6


@dataclass
class Lists:
    vectors: DataFrame
    lists: DataFrame
    folder: str | None = None  # where a search may keep what it needs twice


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; null where it has none, or holds what is no number."""
    x = v.cast("array<double>")
    size = F.sqrt(dot(x, x))
    known = lambda s: F.when((s > 0) & ~F.isnan(s) & (s < float("inf")), F.transform(x, lambda c: c / s))
    return F.get(F.transform(F.array(size), known), F.lit(0))  # bound: once for a vector, not for each component


def angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def write(vectors: DataFrame, path: str, lists: int | None = None, seed: int = 1) -> None:
    """vectors (doc_id, v) of one length to lists under ``path``; those without a direction are left out. By default a quarter as many lists as the square root of the rows, 4096 at most."""
    spark = vectors.sparkSession
    vectors.select("doc_id", unit(F.col("v")).alias("v")).where("v is not null").write.parquet(f"{path}/units")
    x = spark.read.parquet(f"{path}/units")  # lengths are taken once, for the count, the fit and the lists
    n = x.count()
    k = max(1, min(lists or math.isqrt(n) // 4, 4096, n))
    if n:
        some = x if n <= SAMPLE else x.sample(SAMPLE / n * 0.95, seed)
        fitted = KMeans(k=k, seed=seed, maxIter=10).fit(some.select(array_to_vector("v").alias("features")))
        centres = np.array(fitted.clusterCenters())
    else:
        centres = np.zeros((1, 1))
    size = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = centres / np.where(size > 0, size, 1.0)
    sent = spark.sparkContext.broadcast(centres)  # k rows, 4096 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            scores = m @ sent.value.T
            best = scores.argmax(1)
            away = np.arccos(np.clip(scores[np.arange(len(best)), best], -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.int32()), pa.array(away)], names=["doc_id", "v", "list", "away"])

    kind = x.schema["doc_id"].dataType.simpleString()
    x.mapInArrow(run, f"doc_id {kind}, v array<double>, list int, away double").write.parquet(f"{path}/assigned")
    dealt = spark.read.parquet(f"{path}/assigned")
    made = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    dealt.groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("n")).join(F.broadcast(made), "list").coalesce(1).write.parquet(f"{path}/lists")  # a row for each list
    dealt.drop("away").repartition("list", F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.partitionBy("list").parquet(f"{path}/vectors")
    T.drop(spark, f"{path}/units")


def read(spark: SparkSession, path: str, kind: str = "bigint") -> Lists:
    return Lists(spark.read.schema(f"doc_id {kind}, v array<double>, list int").parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/lists"), path)


def kept(vectors: DataFrame, folder: str, name: str, lists: int | None = None) -> Lists:
    """The lists of ``vectors`` (doc_id, v) under ``folder``, made once for the files they come from (:func:`tables.kept`)."""
    path = T.kept(vectors, folder, name, f"lists={lists}", lambda p: write(vectors, p, lists))
    return read(vectors.sparkSession, path, vectors.schema["doc_id"].dataType.simpleString())


def bounds(x: Lists, queries: DataFrame) -> DataFrame:
    """(query_id, q, list, n, bound, near): for each query and list the greatest cosine that the list can hold, and the list's place by the angle to its centre. queries (query_id, q)."""
    q = queries.select("query_id", unit(F.col("q")).alias("q")).where("q is not null")
    pairs = q.crossJoin(F.broadcast(x.lists))  # lists: 4096 rows at most
    a = angle(F.col("q"), F.col("centre"))
    pairs = pairs.select("query_id", "q", "list", "n", a.alias("a"), F.cos(F.greatest(F.lit(0.0), a - F.col("radius"))).alias("bound"))
    return pairs.withColumn("near", F.row_number().over(Window.partitionBy("query_id").orderBy("a", "list"))).drop("a")


def met(x: Lists, asked: DataFrame, top: int, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score): of each query, what may be among its first ``top`` of the lists it asks. asked (query_id, q, list, n), and ``floor`` if lower scores are of no use; null for none.

    Vectors of a list are dealt into blocks of about ``block``, and so are its
    queries; each two blocks meet in a task.
    """
    per_list = asked.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("qbs"), F.ceil(F.first("n") / block).cast("int").alias("vbs"))
    share = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = F.broadcast(per_list)  # a row for each list, 4096 at most
    left = x.vectors.join(few, "list").select("list", "doc_id", "v", share("doc_id", "vbs").alias("vb"), every("qbs").alias("qb"))
    floor = F.col("floor") if "floor" in asked.columns else F.lit(None).cast("double").alias("floor")
    right = asked.select("query_id", "q", "list", floor).join(few, "list").select("list", "query_id", "q", "floor", share("query_id", "qbs").alias("qb"), every("vbs").alias("vb"))
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("query_id", asked), ("doc_id", x.vectors))}

    def run(v: pa.Table, q: pa.Table) -> pa.Table:
        out = [pa.array([], q.schema.field("query_id").type), pa.array([], v.schema.field("doc_id").type), pa.array([], pa.float64())]
        if len(v) and len(q):
            a, b = (t[c].combine_chunks().flatten().to_numpy().reshape(len(t), -1) for t, c in ((q, "q"), (v, "v")))
            scores, rank = a @ b.T, np.unique(v["doc_id"].to_numpy(), return_inverse=True)[1]
            least = q["floor"].to_numpy()
            keep = scores >= np.where(np.isnan(least), -np.inf, least)[:, None] - 2 * SLACK
            many = np.flatnonzero(keep.sum(1) > top)  # only these have more than can be of use
            if len(v) > top and len(many):
                keep[many] &= scores[many] >= np.partition(scores[many], len(v) - top, axis=1)[:, [len(v) - top]] - SLACK
                for row in np.flatnonzero(keep.sum(1) > 4 * top):  # many of one score: the smallest ids
                    j = np.flatnonzero(keep[row])
                    keep[row, j[np.lexsort((rank[j], -np.round(scores[row, j] / SLACK)))[4 * top :]]] = False
            i, j = np.nonzero(keep)
            out = [q["query_id"].combine_chunks().take(pa.array(i)), v["doc_id"].combine_chunks().take(pa.array(j)), pa.array(scores[i, j])]
        return pa.table(out, names=["query_id", "doc_id", "score"])

    by = ["list", "qb", "vb"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")


def search(x: Lists, queries: DataFrame, top: int, probe: int | None = None, allowed: DataFrame | None = None, digits: int = 6, first: int = FIRST) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``top`` vectors of each query by cosine. queries (query_id, q).

    Exact, or of the ``probe`` nearest lists only. Queries without a direction
    have no hits. With ``allowed`` (doc_id), only these, filtered before they are
    ranked. No query and no vector passes through the driver.
    """
    if allowed is not None:
        x = Lists(x.vectors.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi"), x.lists, x.folder)
    once = lambda df, name: T.cut(df, x.folder, name) if x.folder else df
    lists = bounds(x, queries)
    if probe is not None:
        found = met(x, lists.where(F.col("near") <= probe), top)
    else:
        lists = once(lists, "bounds")
        start = once(met(x, lists.where(F.col("near") <= first), top), "start")
        floor = R.ranked(start, top).groupBy("query_id").agg(F.when(F.count("*") == top, F.min("score")).alias("floor"))
        rest = lists.where(F.col("near") > first).join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 2 * SLACK))
        found = start.unionByName(met(x, rest, top))
    return R.ranked(found.withColumn("score", F.round("score", digits)), top)
