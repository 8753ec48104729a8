"""Packing of tokenized documents by swap-based local search.

Only documents longer than a sequence are cut. Pieces are dealt into groups of
bounded size. A group starts from a plain placement, bin after bin as pieces
come (next fit), and a local search does the packing: the fullest bin that has
room takes pieces from emptier ones, by a move, an exchange of one for one, of
two for one or of one for two, the one that leaves the least room, if it raises
the sum of squared fills. So full bins get fuller and others empty. What lies
in bins that are still underfull is dealt into fewer groups and searched again,
until the number of such bins falls no more.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .wordbpe import groups, of

CAPACITY, END = 4096, 1
GROUP = 8192  # pieces in a group, on average
UNDERFULL = 0.995  # bins filled less than this take part in a further round
LOOK = 12  # pieces of a bin, and of one length in all bins, that an exchange looks at
ROUNDS = 8  # rounds over underfull bins, at most; each has fewer pieces than the last


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids, then ``end``, cut at ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last = of(path), int(end).to_bytes(4, "little")
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            row, piece, start, length, crc = [], [], [], [], []
            for s in groups(texts):
                for i, ids in enumerate(bpe.encode_batch(texts[s]), s.start):
                    ids += last
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        row.append(i)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(length: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of piece numbers: longest piece first, each into the bin that it fills best."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    bins: list[list[int]] = []
    for i in np.argsort(-length, kind="stable").tolist():
        n = int(length[i])
        fit = rooms >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            k = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
            bins[k].append(i)
            r -= n
        else:
            k, r = len(bins), capacity - n
            bins.append([i])
        if not by_room[r]:
            rooms |= 1 << r
        by_room[r].append(k)
    return bins


def next_fit(length: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of piece numbers as they come: a piece that does not fit the last bin opens the next."""
    bins: list[list[int]] = []
    room = -1
    for i, n in enumerate(length.tolist()):
        if n > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= n
    return bins


class Pool:
    """Pieces of open bins by length, with bit sets of the lengths there are."""

    def __init__(self, capacity: int):
        self.capacity, self.by_length, self.has, self.mirror = capacity, [set() for _ in range(capacity + 1)], 0, 0

    def add(self, piece: int, n: int) -> None:
        if not self.by_length[n]:
            self.has |= 1 << n
            self.mirror |= 1 << (self.capacity - n)
        self.by_length[n].add(piece)

    def remove(self, piece: int, n: int) -> None:
        self.by_length[n].remove(piece)
        if not self.by_length[n]:
            self.has ^= 1 << n
            self.mirror ^= 1 << (self.capacity - n)

    def most(self, n: int) -> int:
        """The greatest length up to ``n`` that there is, or -1."""
        return (self.has & ((2 << n) - 1)).bit_length() - 1 if n >= 0 else -1

    def two(self, n: int) -> int:
        """The longer of two lengths that there are and that make ``n``, or -1. Of two of one length there may be one piece only."""
        # bit k of the mirror, shifted: a piece of length n - k is there
        shift = self.capacity - n
        both = self.has & (self.mirror >> shift if shift >= 0 else self.mirror << -shift)
        return both.bit_length() - 1


def local_search(bins: list[list[int]], length: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins after moves and exchanges; each raises the sum of squared fills, so it ends. Empty bins go."""
    size, where = length.tolist(), {}
    held = [set(b) for b in bins]
    fill = [sum(size[i] for i in b) for b in bins]
    pool = Pool(capacity)
    for k, b in enumerate(bins):
        for i in b:
            where[i] = k
            pool.add(i, size[i])
    queue = [(-f, k) for k, f in enumerate(fill)]
    heapq.heapify(queue)
    closed = [False] * len(bins)

    def shift(piece: int, to: int) -> None:
        k = where[piece]
        held[k].remove(piece)
        held[to].add(piece)
        fill[k] -= size[piece]
        fill[to] += size[piece]
        where[piece] = to
        if closed[k] != closed[to]:
            (pool.remove if closed[to] else pool.add)(piece, size[piece])

    def emptiest(n: int, but: int = -1) -> int:
        """A piece of length ``n``, of a bin as empty as any of some; -1 if ``but`` is the only one."""
        some = [i for i in itertools.islice(pool.by_length[n], LOOK + 1) if i != but]
        return min(some, key=lambda i: (fill[where[i]], i)) if some else -1

    def gain(to: int, come: tuple[int, ...], go: tuple[int, ...]) -> tuple[int, int]:
        """What an exchange adds to the sum of squares, and the bin that pieces which go are for: the emptiest that takes them, -1 if none does."""
        change: dict[int, int] = {}
        for i in come:
            change[where[i]] = change.get(where[i], 0) - size[i]
        back = sum(size[i] for i in go)
        target = min(change, key=lambda k: (fill[k] + change[k], k))
        if fill[target] + change[target] + back > capacity:
            return 0, -1
        change[target] += back
        change[to] = sum(size[i] for i in come) - back
        return sum((2 * fill[k] + d) * d for k, d in change.items()), target

    def options(k: int, room: int):
        """(weight that comes more than goes, pieces that come, pieces that go), each the best of its kind for some pieces that go."""
        mine = sorted(held[k], key=lambda i: (size[i], i))[:LOOK]
        for go in [(), *((i,) for i in mine), *itertools.combinations(mine, 2)]:
            goes = sum(size[i] for i in go)
            want = goes + room
            one = pool.most(min(want, capacity))
            if one > goes:
                yield one - goes, (one,), go
            if len(go) < 2 and want <= 2 * capacity:
                a = pool.two(want)
                if a > 0:
                    yield room, (a, want - a), go

    while queue:
        was, k = heapq.heappop(queue)
        if closed[k] or -was != fill[k]:  # its fill has changed since: it stands in the queue with the new one
            continue
        closed[k] = True
        for i in held[k]:
            pool.remove(i, size[i])
        while fill[k] and (room := capacity - fill[k]) > 0:
            for _, lengths, go in sorted(options(k, room), key=lambda o: (-o[0], len(o[1]) + len(o[2]))):
                first = emptiest(lengths[0])
                come = (first,) if len(lengths) == 1 else (first, emptiest(lengths[1], first))
                if come[-1] < 0:
                    continue
                more, target = gain(k, come, go)
                if more > 0:
                    break
            else:
                break
            touched = {where[i] for i in come}
            for i in go:
                shift(i, target)
            for i in come:
                shift(i, k)
            for b in touched:
                heapq.heappush(queue, (-fill[b], b))
    return [sorted(b) for b in held if b]


def pack(length: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of piece numbers by local search from a plain placement, again as long as bins become fewer.

    Where that needs more bins than the pieces would fill (pieces that fit badly,
    such as all above a third of a bin), the search also starts from best fit,
    and the fewer bins stay.
    """
    least = -(-int(length.sum()) // capacity)

    def search(bins: list[list[int]]) -> list[list[int]]:
        while len(bins) > least and len(new := local_search(bins, length, capacity)) < len(bins):
            bins = new
        return bins

    bins = search(next_fit(length, capacity))
    return min(bins, search(best_fit(length, capacity)), key=len) if len(bins) > least else bins


def _round(rows: DataFrame, n_groups: int, base: int, capacity: int) -> DataFrame:
    """``rows`` (uid, length) packed in groups: (uid, length, sequence_id, offset, fill)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        length, group = pdf["length"].to_numpy(), int(pdf["g"].iloc[0])
        bins = pack(length, capacity)
        at = np.array([i for b in bins for i in b])
        size = np.array([len(b) for b in bins])
        seq = np.repeat(np.arange(len(bins)), size)
        ends = np.cumsum(length[at])
        first = np.cumsum(size) - size
        begin = (ends - length[at])[first]
        fill = np.add.reduceat(length[at], first)
        return pd.DataFrame({"uid": pdf["uid"].to_numpy()[at], "length": length[at], "sequence_id": base + (group << 32) + seq, "offset": ends - length[at] - begin[seq], "fill": fill[seq]})

    g = F.pmod(F.xxhash64(F.lit(base), "uid"), F.lit(n_groups)).cast("int")
    return rows.select("uid", "length", g.alias("g")).groupBy("g").applyInPandas(run, "uid long, length long, sequence_id long, offset long, fill long")


def best_fit_pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Null text counts as empty: one piece with ``end`` alone. Rows that repeat an
    id, and null ids, are documents of their own. Full pieces are sequences of
    their own. An empty table gives no row.
    """
    rows = cut(pieces(docs, path, capacity, end, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    left = rows.where(F.col("length") < capacity).select("uid", "length")
    n, done, before = left.count(), None, None
    for r in range(ROUNDS):
        packed = cut(_round(left, max(1, math.ceil(n / group)), r << 56, capacity), "packed")
        rest = packed.where(F.col("fill") < UNDERFULL * capacity)
        bins, n = rest.agg(F.count_distinct("sequence_id"), F.count("*")).first()
        more = before is None or bins < before  # underfull bins fall in number
        shut = packed.where(F.col("fill") >= UNDERFULL * capacity) if more and bins > 1 and r < ROUNDS - 1 else packed
        done = shut if done is None else done.unionByName(shut)
        if shut is packed:
            break
        left, before = rest.select("uid", "length"), bins
    placed = done.select("uid", "sequence_id", "offset")
    full = rows.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("uid") + F.lit(1 << 61), "offset": F.lit(0).cast("long")})
    out = full.unionByName(rows.where(F.col("length") < capacity).join(placed, "uid").select(*full.columns))
    return out.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
