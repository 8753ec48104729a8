"""Exact deduplication against an immutable snapshot, with static binary fuse filters.

A snapshot's distinct digests are dealt into shards by their first bits, and
each shard gets a binary fuse filter (three slots of 8 bits a key, about 9 bits
in all, no false negatives; T. M. Graf and D. Lemire, 2022). Incoming digests
are grouped among themselves, then screened by the filter of their shard. Only
positives join the snapshot's exact buckets. Texts move only for rows in groups
of two or more, to be compared byte for byte.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, slices, without_ids

SHARD = 60_000  # digests in a shard, on average
BROADCAST_DIGESTS = 5_000_000  # digests whose filter (about 6 MB) is sent to all executors, at most


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text in UTF-8, A-Z lower-cased; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            d = [hashlib.sha256((t or b"").lower()).digest() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d, pa.binary())], names=[id_col, "digest"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, digest binary")


# --- the filter


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed & (2**64 - 1))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def slots(h: np.ndarray, seg: int, count: int) -> np.ndarray:
    """Three places of each hash, in three neighbouring segments."""
    hi = ((h >> np.uint64(32)) * np.uint64(count * seg)) >> np.uint64(32)
    mask = np.uint64(seg - 1)
    return np.stack([hi, (hi + np.uint64(seg)) ^ ((h >> np.uint64(18)) & mask), (hi + np.uint64(2 * seg)) ^ (h & mask)]).astype(np.int64)


def build_filter(keys: np.ndarray) -> bytes:
    """A filter for distinct 64-bit keys: seed, segment length, segments, fingerprints."""
    n = len(keys)
    seg = min(1 << 18, 1 << int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    count = max(1, math.ceil(round(n * factor) / seg) - 2) if n > 1 else 1
    for seed in range(1, 1000):
        h = mix(keys, seed * 0x9E3779B97F4A7C15)
        at = slots(h, seg, count)
        size = (count + 2) * seg
        degree = np.bincount(at.ravel(), minlength=size)
        xor = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(xor, row, np.arange(n))
        # peel in rounds: each slot that one key is left in gives that key its place
        rounds, left = [], n
        while left:
            single = np.flatnonzero(degree == 1)
            if not len(single):
                break
            who, first = np.unique(xor[single], return_index=True)
            rounds.append((who, single[first]))
            for row in at[:, who]:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(xor, row, who)
            left -= len(who)
        if not left:
            break
        if seed % 20 == 0:
            count += max(1, count // 8)
    else:
        raise ValueError("no seed peels the filter; are keys distinct?")
    table = np.zeros(size, np.uint8)
    mark = (h ^ (h >> np.uint64(32))).astype(np.uint8)
    for who, place in reversed(rounds):
        # keys placed in one round share no slot that is set here, as each slot holds one key alone
        table[place] = 0
        table[place] = mark[who] ^ table[at[0, who]] ^ table[at[1, who]] ^ table[at[2, who]]
    return np.array([seed, seg, count], "<i8").tobytes() + table.tobytes()


def maybe_in(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be one of the filter's; never false for one that is."""
    seed, seg, count = np.frombuffer(blob, "<i8", 3)
    table = np.frombuffer(blob, np.uint8, offset=24)
    h = mix(keys, int(seed) * 0x9E3779B97F4A7C15)
    at = slots(h, int(seg), int(count))
    return (h ^ (h >> np.uint64(32))).astype(np.uint8) == table[at[0]] ^ table[at[1]] ^ table[at[2]]


def keys_of(digest: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digest), ">u8").astype(np.uint64)


def shard_of(shards: int):
    """Shard of a digest, by bits that the filter's keys do not use."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 9, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def make_filters(groups: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) over the digests of a snapshot: written once, never changed."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [build_filter(np.unique(keys_of(pdf["digest"])))]})

    return groups.select("digest").withColumn("shard", shard_of(shards)).groupBy("shard").applyInPandas(build, "shard int, filter binary")


def screen(groups: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """``groups`` (digest, low, keep_id, n) with ``maybe``: whether the snapshot may hold the digest."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        maybe = maybe_in(right["filter"].iloc[0], keys_of(left["digest"])) if len(right) and len(left) else np.zeros(len(left), bool)
        return left[["digest", "keep_id", "n"]].assign(maybe=maybe)

    dealt = groups.withColumn("shard", shard_of(shards))
    kind = groups.schema["keep_id"].dataType.simpleString()
    return dealt.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(run, f"digest binary, keep_id {kind}, n long, maybe boolean")


# --- the operator


def members(rows: DataFrame, digests_: DataFrame) -> DataFrame:
    """(doc_id, digest, norm): rows of ``rows`` (doc_id, text) that may have one of the digests, and their normalised texts.

    A filter over the digests, sent to all executors if a count shows it small,
    screens the texts where they are read, and nothing moves. Few pass that have
    none of the digests; the caller joins.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    n = digests_.count()
    sent = None
    if 0 < n <= BROADCAST_DIGESTS:
        build = lambda it: (pd.DataFrame({"filter": [build_filter(np.unique(np.concatenate([keys_of(p["digest"]) for p in it])))]}) for _ in range(1))
        sent = rows.sparkSession.sparkContext.broadcast(bytes(digests_.coalesce(1).mapInPandas(build, "filter binary").first()["filter"]))

    def screen_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            norm = [(t or b"").lower() for t in b.column(1).cast(pa.binary()).to_pylist()]
            digest = [hashlib.sha256(t).digest() for t in norm]
            ok = np.ones(len(norm), bool)
            if sent is not None and norm:
                ok = maybe_in(sent.value, np.frombuffer(b"".join(d[:8] for d in digest), ">u8").astype(np.uint64))
            at = np.flatnonzero(ok).tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array([digest[i] for i in at], pa.binary()), pa.array([norm[i].decode() for i in at], pa.string())], names=["doc_id", "digest", "norm"]
            )

    return rows.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(screen_texts, f"doc_id {kind}, digest binary, norm string")


def against_snapshot(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """(digest, keep_id, n) over both sides, each (doc_id, digest).

    Each side is grouped on its own. The snapshot's filters screen the batch's
    distinct digests: negatives are new for certain, positives join.
    """

    def grouped(df: DataFrame) -> DataFrame:
        return df.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))

    old, new = cut(grouped(snapshot), "snapshot-groups"), grouped(batch)
    shards = max(1, math.ceil(old.count() / SHARD))
    filters = cut(make_filters(old, shards), "fuse-filters")
    seen = cut(screen(new, filters, shards), "screened")
    hits = seen.where("maybe").select("digest", F.col("keep_id").alias("k2"), F.col("n").alias("n2"))
    merged = old.join(hits, "digest", "full_outer").select(
        "digest", F.greatest("keep_id", "k2").alias("keep_id"), (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n")
    )
    return merged.unionByName(seen.where("not maybe").select("digest", "keep_id", "n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. The row with the largest id of a group stays. Rows with a null id
    count in group_size, and are kept only if no row of the group has an id.
    Rows that repeat an id are rows of their own in group_size, and share kept.

    The table is read as a snapshot (half of the rows, by a hash of the id) and
    a batch that comes in.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = cut(digests(rows), "digests")
    side = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    groups = cut(against_snapshot(keyed.where(side == 0), keyed.where(side == 1)), "groups")
    many = groups.where("n > 1").select("digest")
    # the bytes behind each digest that more than one row has: copies in one task become one row before they move
    texts = members(rows, cut(many, "shared-digests"))
    apart = cut(texts.groupBy("digest", "norm").agg(F.count("*").alias("c")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1"), "apart")
    out = lookup(keyed, groups.withColumn("rows", F.col("n")), ["digest"], "rows").select(
        F.col("doc_id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "digest"
    )
    if not apart.isEmpty():  # two texts of one SHA-256: group these by their bytes
        split = texts.join(apart, "digest", "left_semi").groupBy("digest", "norm")
        exact = split.agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        redo = texts.join(apart, "digest", "left_semi").join(exact, ["digest", "norm"])
        out = out.join(apart, "digest", "left_anti").unionByName(
            redo.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "digest")
        )
    return out.drop("digest")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that exact_dedup keeps."""
    marks = cut(exact_dedup(docs, id_col, text_col).select(id_col, "kept"), "kept")
    ids = marks.groupBy(id_col).agg(F.bool_or("kept").alias("kept"))
    return without_ids(docs, ids.where("not kept").select(id_col), id_col)
