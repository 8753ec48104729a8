"""SimHash at a similarity, with wide fingerprints, for near copies that differ in many words.

Fingerprints of 64 bits within a few bits of each other hold only texts that
hardly differ: texts with a Jaccard similarity of 0.8 differ in about ten of 64
bits. Here fingerprints have 256 bits, and two texts are near duplicates if
they agree in a share of ``similarity`` of them. Unrelated texts agree in half,
give or take 3 %.

At that radius neither blocks nor pivots keep pairs of unrelated fingerprints
apart, and comparing all pairs grows with the square of the table. So only
texts that share a key are compared. Keys are those shingles of a text that
come first in one order of all shingles, rare ones before frequent ones: of m
distinct shingles, a share of 1 - ``similarity`` and one more. Two texts of
which each has a share of ``similarity`` of the other's shingles have a key in
common, whatever the order is: of the shingles they share, the first in the
order is preceded in either text by those alone that the other one lacks. That
holds for every pair with a Jaccard similarity of ``similarity``. So no link
between such texts is left out, at any number of documents.

How frequent a shingle is, is counted over all texts, in a table of bounded size
that shingles share; a wrong count costs time, not links. In a bucket of texts
with one key, distances to pivots discard pairs, and the rest is verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, slices, without_ids
from .graph import components
from .simhash import SEED, WORD, forest

WIDE, SHINGLE, SIMILARITY = 4, 5, 0.8  # words of 64 bits, words in a shingle, share of equal bits
PIVOTS = 8
SMALL = 128  # rows of a bucket up to which all pairs are listed
CHUNK = 1 << 20  # pairs that are verified at once
HOT = 1 << 16  # rows of a bucket that is dealt as one; larger ones are dealt as pairs of tiles
TASK = 1 << 20  # keys in a task, about
SLOTS = 12, 20  # bits of the table of counts, at least and at most: about one slot a document between them
PART = 1 << 12  # slots that are summed as one row
FAN = 256  # tables of counts that are added in one task
LEVEL = 58  # bits of a key below its level of frequency


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits from a hash (the finaliser of SplitMix)."""
    h = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles; of fewer words, of the whole sequence; none for no word."""
    found = WORD.findall((text or b"").lower())
    if not found:
        return np.zeros(0, np.uint64)
    grams = set(map(b" ".join, zip(*(found[i:] for i in range(shingle))))) if len(found) >= shingle else {b" ".join(found)}  # noqa: B905
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64, len(grams))


def wide_fingerprint(h: np.ndarray, words: int = WIDE) -> bytes:
    """Majority of each bit over the hashes of distinct shingles; ties go by the smallest hash. Zero for no word."""
    if not len(h):
        return bytes(8 * words)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        each = np.stack([mixed(part, k) for k in range(words)], axis=1)
        ones += np.unpackbits(each.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    low = np.stack([mixed(h.min()[None], k) for k in range(words)], axis=1)
    tie = np.unpackbits(low.view(np.uint8).ravel(), bitorder="little").astype(bool)
    return np.packbits((ones * 2 > len(h)) | ((ones * 2 == len(h)) & tie), bitorder="little").tobytes()


def keys_of(h: np.ndarray, levels: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles in the order of all, by level of frequency, then hash; one key zero for no word."""
    if not len(h):
        return np.zeros(1, np.int64)
    bits = int(len(levels)).bit_length() - 1
    order = (levels[h >> np.uint64(64 - bits)].astype(np.uint64) << np.uint64(LEVEL)) | (h >> np.uint64(64 - LEVEL))
    n = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1
    return (np.partition(order, n - 1)[:n] if n < len(order) else order).view(np.int64)


def frequencies(docs: DataFrame, shingle: int, n: int) -> np.ndarray:
    """A level for each slot of hashes: bits of the number of texts that have a shingle of the slot. ``docs``: the texts alone, ``n`` of them."""
    bits = min(max(SLOTS[0], math.ceil(math.log2(max(n, 1)))), SLOTS[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, np.int64)
        for b in slices(batches):
            found = [shingles(t, shingle) for t in b.column(0).cast(pa.binary()).to_pylist()]
            seen += np.bincount((np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), minlength=len(seen)) if found else 0
        rows = [seen[at : at + PART].tobytes() for at in range(0, len(seen), PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], names=["part", "seen"])

    def add(tables: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in tables.column("seen").to_pylist())
        return pa.table({"part": pa.array([tables.column("part")[0].as_py()], pa.int32()), "seen": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, seen binary"
    tables = cut(docs.mapInArrow(count, schema).withColumn("task", F.spark_partition_id()), "shingle-counts")
    left = (tables.agg(F.max("task")).first()[0] or 0) + 1
    while left > FAN:  # a row of each task is too much for one group
        left = math.ceil(left / FAN)
        tables = tables.withColumn("task", F.pmod("task", F.lit(left)).cast("int"))
        tables = cut(tables.groupBy("part", "task").applyInArrow(lambda t: add(t).append_column("task", t.column("task").slice(0, 1)), schema + ", task int"), "shingle-counts")
    rows = dict(map(tuple, tables.groupBy("part").applyInArrow(add, schema).collect()))  # 2^20 counts at most
    seen = np.concatenate([np.frombuffer(rows[i], np.int64) for i in range(len(rows))]) if rows else np.zeros(1 << bits, np.int64)
    return np.ceil(np.log2(seen + 1)).astype(np.uint8)


def ball_links(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the rows of one bucket as all pairs within ``most`` bits do.

    The first row left is a pivot; the rows within ``most`` of it are its ball,
    and linked to it. A row outside can be linked to one of the ball only if
    their distances to the pivot differ by ``most`` at most, so only the shell
    up to twice that is compared with the ball, each row until it has a link.
    Then the ball is done with, as nothing further out can be linked to it.
    """
    left, right = [], []
    rows = np.arange(len(fp))
    while len(rows) > 1:
        d = np.bitwise_count(fp[rows] ^ fp[rows[0]]).sum(1).astype(np.int64)
        near = d <= most
        ball, far = rows[near], rows[~near]
        left.append(np.full(len(ball) - 1, ball[0]))
        right.append(ball[1:])
        d_ball, d_far = d[near], d[~near]
        at = d_far <= d_ball.max() + most
        shell, d_shell = far[at], d_far[at]
        begin = 1  # the pivot itself has no link outside
        while begin < len(ball) and len(shell):
            step = max(1, CHUNK // len(shell))
            b, d_b = ball[begin : begin + step], d_ball[begin : begin + step]
            x, y = np.nonzero(np.abs(d_b[:, None] - d_shell[None, :]) <= most)
            ok = np.bitwise_count(fp[b[x]] ^ fp[shell[y]]).sum(1) <= most
            x, y = x[ok], y[ok]
            y, first = np.unique(y, return_index=True)
            left.append(b[x[first]])
            right.append(shell[y])
            shell, d_shell = np.delete(shell, y), np.delete(d_shell, y)
            begin += step
        rows = far
    return (np.concatenate(left), np.concatenate(right)) if left else (rows[:0], rows[:0])


def near_pairs(fp: np.ndarray, group: np.ndarray, most: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group within ``most`` bits: all of a small group, enough to connect it of a large one. Rows are sorted by group."""
    left, right = [], []
    starts = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    sizes = np.diff(np.append(starts, len(group)))
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        a, b = ball_links(fp[s : s + n], most)
        left.append(a + s)
        right.append(b + s)
    i = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    dist = np.zeros((len(fp), len(table)), np.int16)
    if len(i):
        dist[i] = np.stack([np.bitwise_count(fp[i] ^ p[None, :]).sum(1) for p in table], axis=1)
    for lag in range(1, SMALL):
        i = i[i + lag < len(fp)]
        i = i[group[i] == group[i + lag]]
        if not len(i):
            break
        a, b = i, i + lag
        for p in range(dist.shape[1]):
            ok = np.abs(dist[a, p] - dist[b, p]) <= most
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]).sum(1) <= most
        left.append(a[ok])
        right.append(b[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([*left, none]), np.concatenate([*right, none])


def links(distinct: DataFrame, most: int) -> DataFrame:
    """(u, v): edges that join the nodes (node, fp, keys) as all pairs with a common key within ``most`` bits do."""
    spark = distinct.sparkSession
    total = distinct.agg(F.sum(F.size("keys"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK))
    pivots = np.frombuffer(b"".join(xxhash.xxh64_digest(b"pivot %d" % i, SEED) for i in range(PIVOTS * WIDE)), np.uint64).reshape(PIVOTS, WIDE)
    rows = distinct.select("node", "fp", F.explode("keys").alias("key"))
    # counts of slots are no less than those of their keys, so that only keys of the levels of hot ones need counting
    level = F.shiftrightunsigned("key", LEVEL)
    often = rows.where(level >= math.ceil(math.log2(HOT + 1))).groupBy("key").agg(F.count("*").alias("n"))
    hot = cut(often.where(F.col("n") > HOT), "hot-keys")
    some = hot.count()
    i = j = F.lit(0)
    if some:
        rows = rows.join(F.broadcast(hot) if some <= 100_000 else hot, "key", "left")
        rows = rows.withColumn("k", F.coalesce(F.ceil(F.col("n") / HOT), F.lit(1)).cast("int")).withColumn("c", F.pmod(F.xxhash64("node", "key"), F.col("k")).cast("int"))
        # a tile meets each other tile; two rows of one tile meet there too
        rows = rows.withColumn("other", F.explode(F.expr("if(k = 1, array(0), filter(sequence(0, k - 1), x -> x <> c))")))
        i, j = F.least("c", "other"), F.greatest("c", "other")
    dealt = rows.select(F.xxhash64("key", i, j).alias("bucket"), "key", "node", "fp").repartition(parts, "bucket").sortWithinPartitions("bucket", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None

        def solve(x: dict[str, np.ndarray]) -> pa.RecordBatch:
            new = np.zeros(len(x["node"]), bool)
            for c in ("bucket", "key"):
                new[1:] |= x[c][1:] != x[c][:-1]
            a, b = near_pairs(x["fp"], np.cumsum(new), most, pivots)
            label = forest(len(new), a, b)
            at = np.flatnonzero(label != np.arange(len(new)))
            return pa.RecordBatch.from_arrays([pa.array(x["node"][at]), pa.array(x["node"][label[at]])], names=["u", "v"])

        for batch in batches:
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "key", "node")}
            now["fp"] = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(-1, WIDE)
            if rest is not None:
                now = {k: np.concatenate([rest[k], v]) for k, v in now.items()}
            same = (now["bucket"] == now["bucket"][-1:]) & (now["key"] == now["key"][-1:])  # rows of the last bucket, which may go on
            if not same.all():
                yield solve({k: v[~same] for k, v in now.items()})
            rest = {k: v[same] for k, v in now.items()}
        if rest is not None and len(rest["node"]):
            yield solve(rest)

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row: the smallest id reachable over near duplicates.

    Null text counts as empty, and texts without a word are duplicates of each
    other. Rows with a null id stay and do not lower component_id.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    texts = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))
    sent = spark.sparkContext.broadcast(frequencies(texts.select(text_col), shingle, docs.count()))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h = [shingles(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            fp, keys = [wide_fingerprint(x) for x in h], [np.sort(keys_of(x, sent.value, similarity)) for x in h]
            sig = [xxhash.xxh3_128_digest(f + k.tobytes()) for f, k in zip(fp, keys, strict=True)]
            flat = pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sig, pa.binary()), pa.array(fp, pa.binary()), lists], names=[id_col, "sig", "fp", "keys"])

    marked = cut(texts.mapInArrow(prints, f"`{id_col}` {kind}, sig binary, fp binary, keys array<long>"), "wide")
    grouped = marked.groupBy("sig", "fp", "keys").agg(F.min(id_col).alias("low"), F.count("*").alias("n"))
    distinct = cut(grouped.withColumn("node", F.monotonically_increasing_id()), "wide-fp")
    roots = components(links(distinct, math.floor(64 * WIDE * (1 - similarity))))
    owned = cut(distinct.join(roots, "node", "left").select("sig", "n", "low", F.coalesce("root", "node").alias("root")), "wide-roots")
    lows = cut(owned.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("m")), "wide-lows")
    classes = cut(lookup(owned.select("sig", "n", "root"), lows, ["root"], "m").select("sig", "n", "component_id"), "wide-classes")
    return lookup(marked.select(id_col, "sig"), classes, ["sig"]).select(id_col, "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that have the smallest id of their component."""
    marks = cut(near_duplicates(docs, similarity, shingle, id_col, text_col), "components")
    kept = F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id"))
    return without_ids(docs, marks.where(~kept).select(id_col), id_col)
