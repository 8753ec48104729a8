"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are dealt into buckets of similar length. The queries first meet the
bucket of longest vectors, which gives each query a score its k-th result must
reach. From that, the query's length and the bucket's greatest length follows a
local cosine threshold for each other bucket: above 1, the pair is skipped
before anything moves; high ones are pruned by coordinates (the query's largest
components give each candidate's product an upper bound), low ones by length.
The products of what is left are computed in whole numbers. Buckets are a
sixteenth of the vectors, and of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

BUCKETS, BUCKET, BLOCK = 16, 1 << 15, 1 << 14  # buckets at least, candidates in a bucket and queries in a block at most
FEW = 1_000_000  # pairs of block and bucket, and rows of small tables, that are broadcast, at most
LIMIT = 1 << 52  # greatest component; beyond, doubles are no whole numbers
FOCUS = 8  # coordinates for the upper bound
HIGH = 0.6  # local cosine from which coordinates prune
SCALE = 1024


def scaled(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v, norm2) with v = floor(scale * x) as longs. Vectors null, or with null or non-finite components, and null ids go.

    Components whose floor is beyond ``LIMIT`` in size raise an error: doubles do
    not hold them apart, so no product of theirs would be exact.
    """
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = lambda c: F.when(F.abs(c) * scale <= LIMIT, F.floor(c * F.lit(float(scale))).cast("long")).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond 2^52")).cast("long"))
    clean = vectors.where(x.isNotNull() & ~bad & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))
    return clean.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def product(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whole-number products; in doubles where these are exact, as BLAS is quicker. An error where a sum could exceed 64 bits."""
    most = float(np.abs(p).max(initial=0)) * float(np.abs(q).max(initial=0)) * p.shape[1]
    if most < 2**53:
        return (p.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("scores of these vectors do not fit 64 bits")
    return p @ q


def local_top(query_id: np.ndarray, q: np.ndarray, floor: np.ndarray, vec_id: np.ndarray, p: np.ndarray, k: int, high: float = HIGH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates of one bucket that may be among a query's k best: (query_id, vec_id, score).

    ``floor``: a score that k candidates of the query are known to reach, or -inf.
    """
    length = np.sqrt((p.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-length, kind="stable")
    p, vec_id, length = p[order], vec_id[order], length[order]
    pf = p.astype(np.float64)
    square = length**2
    out_q, out_v, out_s = [], [], []
    for start in range(0, len(q), 256):
        whole: list[int] = []
        for i in range(start, min(start + 256, len(q))):
            row, low = q[i].astype(np.float64), floor[i]
            size = math.sqrt(float(row @ row))
            top = length[0] if len(length) else 0.0
            cosine = low / (size * top) if size * top > 0 else -1.0
            slack = 1e-9 * (1 + abs(low))
            if cosine > 1 + 1e-9:
                continue
            if cosine >= high:  # coordinate pruning
                f = np.argsort(-np.abs(row), kind="stable")[:FOCUS]
                rest = max(0.0, size * size - float(row[f] @ row[f]))
                bound = pf[:, f] @ row[f] + np.sqrt(np.maximum(square - (pf[:, f] ** 2).sum(1), 0.0) * rest)
                at = np.flatnonzero(bound >= low - slack)
            elif low > 0 and size > 0:  # length pruning: a prefix, as lengths fall
                at = np.arange(np.searchsorted(-length, -(low / size) * (1 - 1e-9), side="right"))
            else:
                at = np.arange(len(p))
            if len(at) > len(p) // 4:
                whole.append(i)
                continue
            score = product(p[at], q[i])
            pick(query_id[i], vec_id[at], score, low, k, out_q, out_v, out_s)
        if whole:
            scores = product(p, q[whole].T)
            for n, i in enumerate(whole):
                pick(query_id[i], vec_id, scores[:, n], floor[i], k, out_q, out_v, out_s)
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(out_q, np.int64), join(out_v, np.int64), join(out_s, np.int64)


def pick(query: int, ids: np.ndarray, score: np.ndarray, low: float, k: int, out_q: list, out_v: list, out_s: list) -> None:
    """Append the k best of one query and bucket, the query's own row left out."""
    ok = (score >= low) & (ids != query)
    ids, score = ids[ok], score[ok]
    if len(score) > k:
        cutoff = np.partition(score, len(score) - k)[len(score) - k]
        ok = score >= cutoff
        ids, score = ids[ok], score[ok]
        best = np.lexsort((ids, -score))[:k]
        ids, score = ids[best], score[best]
    out_q.append(np.full(len(ids), query, np.int64))
    out_v.append(ids)
    out_s.append(score)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", high: float = HIGH) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products among all other rows.

    Ties go to the smaller vec_id. Rows of ``vectors`` with the query's id are
    its own and left out. A repeated row is a candidate each time, and a query
    once. Vectors of another length than a query's do not meet it. A query
    without candidates gives no row. Components, and scores, that do not fit are
    an error (:func:`scaled`, :func:`product`), never a wrong score. Neither side
    is collected: blocks of queries meet buckets of candidates, both of bounded size.
    """
    pool = scaled(vectors, scale, id_col, vec_col).withColumn("size", F.size("v"))
    n = pool.count()
    nb = max(min(BUCKETS, n), math.ceil(n / BUCKET), 1)
    # longest first; the id splits ties, so that one very common vector fills no bucket beyond its share
    dealt = pool.repartitionByRange(nb, F.desc("norm2"), F.xxhash64("vec_id")).withColumn("bucket", F.spark_partition_id())
    dealt = cut(dealt, "norm-buckets")
    # repeated ids of one vector are told apart, so that both count
    ask = scaled(queries, scale, id_col, vec_col).dropDuplicates(["vec_id"]).withColumn("size", F.size("v"))
    blocks = max(1, math.ceil(ask.count() / BLOCK))
    ask = cut(ask.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.sqrt("norm2").alias("len"), "size", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")), "queries")
    lengths = cut(dealt.groupBy("size", "bucket").agg(F.sqrt(F.max("norm2")).alias("top"), F.count("*").alias("held")), "bucket-lengths")
    small = lambda df, rows: F.broadcast(df) if rows <= FEW else df

    def meet(pairs: DataFrame, asking: DataFrame) -> DataFrame:
        """The local results of (block, bucket, size) ``pairs``: the queries of the block, each with its floor, and the vectors of the bucket."""
        pairs = cut(pairs, "pairs")
        sent = small(pairs, pairs.count())
        left = asking.join(sent, ["block", "size"])
        right = dealt.join(sent, ["bucket", "size"]).select("block", "bucket", "size", "vec_id", "v")

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            q, p = np.stack(a["q"].to_numpy()), np.stack(b["v"].to_numpy())
            found = local_top(a["query_id"].to_numpy(), q, a["floor"].to_numpy(float), b["vec_id"].to_numpy(), p, k, high)
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

        keys = ["block", "bucket", "size"]
        return left.select("query_id", "q", "floor", *keys).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")

    # the buckets of longest vectors that hold a floor's worth of candidates besides the query itself
    order = Window.partitionBy("size").orderBy(F.desc("top"), "bucket")
    lengths = lengths.withColumn("before", F.coalesce(F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seed, blocks_of = F.col("before") <= k, ask.select("block", "size").distinct()
    unknown = ask.withColumn("floor", F.lit(float("-inf")))
    first = cut(meet(blocks_of.join(F.broadcast(lengths.where(seed)), "size").select("block", "bucket", "size"), unknown), "seed-results")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    known = cut(ask.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "floors")
    # a pair goes if the bucket's longest vector, in line with any query of the block, would not reach that query's floor; no vector moves for it
    need = known.groupBy("block", "size").agg(F.min(F.when(F.col("floor") <= 0, 0.0).otherwise(F.when(F.col("len") > 0, F.col("floor") / F.col("len")).otherwise(float("inf")))).alias("need"))
    rest = lengths.where(~seed)
    reach = need.join(small(rest, nb), "size").where(F.col("top") * (1 + 1e-9) >= F.col("need")).select("block", "bucket", "size")
    found = first.unionByName(meet(reach, known))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
