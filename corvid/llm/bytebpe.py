"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is a word over a monoid whose elements are "encoded segments". Encoding
splits the text in halves until a segment is a leaf, encodes the leaves and
joins neighbours. A join redoes only a window around the boundary and grows it
until what lies outside is proved unchanged:

* between pre-tokens: a match of the pattern depends only on what follows its
  start, and on at most ``LOOK`` characters after its end. So a match that ends
  ``LOOK`` characters before the boundary stands, and once a re-run match starts
  where a match of the right half starts, everything after it stands;
* inside a pre-token: a token sequence is the BPE encoding of its bytes exactly
  if each adjacent pair of tokens is the encoding of that pair's bytes. So the
  window grows until the pairs at both of its edges pass.

Decoding maps ids to bytes and concatenates up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

LEAF_CHARS = 8192  # a segment of text at most this long is encoded in one go
LEAF_BYTES = 48  # a pre-token at most this long is merged directly
LOOK = 3  # characters after its end that a match of the pattern can depend on
CACHE = 400_000  # pre-tokens remembered by a worker

# Letters, digits and white space among the characters below, for which `re` is exact and quicker.
PLAIN = re.compile("[\t-\r -~¡-ÿ]*")
PLAIN_CLASSES = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼½¾", r"\s": r"\t-\r "}


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def plain_pattern(pattern: str) -> re.Pattern:
    """``pattern`` for texts of PLAIN characters only."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        key = next((k for k in PLAIN_CLASSES if pattern.startswith(k, i)), None)
        if key:
            out.append(PLAIN_CLASSES[key] if inside else f"[{PLAIN_CLASSES[key]}]")
            i += len(key)
            continue
        if pattern.startswith(r"\S", i):
            out.append(f"[^{PLAIN_CLASSES[r'\s']}]")
            i += 2
            continue
        inside = pattern[i] == "[" or (inside and pattern[i] != "]")
        out.append(pattern[i])
        i += 1
    return re.compile("".join(out))


def unicode_pattern(pattern: str) -> regex.Pattern:
    """White space as Unicode's White_Space, whatever the module's ``\\s`` means."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class ByteBpe:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.slow, self.fast = unicode_pattern(pattern), plain_pattern(pattern)
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[tuple[int, int], bool] = {}
        outer = self

        class Cache(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                if len(self) >= CACHE:
                    self.clear()
                ids = tuple(outer.piece(piece.encode()))
                if len(piece) <= 2 * LEAF_BYTES:
                    self[piece] = ids
                return ids

        self.cache = Cache()

    # --- inside a pre-token

    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties; quadratic, for short data."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > 8 * LEAF_BYTES:
            return self.merge_long(data)
        none = 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        pair = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            i = pair.index(low)
            parts[i] += parts.pop(i + 1)
            del pair[i]
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def merge_long(self, data: bytes) -> list[int]:
        """The same for windows that have grown long: a heap of pairs over a linked list."""
        ranks, n = self.ranks, len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, e = heapq.heappop(heap)
            j = ends[i] if alive[i] else n
            if j >= n or ends[j] != e:
                continue
            ends[i], alive[j] = e, 0
            if e < n:
                before[e] = i
                if (r := ranks.get(data[i : ends[e]])) is not None:
                    heapq.heappush(heap, (r, i, ends[e]))
            h = before[i]
            if h >= 0 and (r := ranks.get(data[h:e])) is not None:
                heapq.heappush(heap, (r, h, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return out

    def stands(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side are the encoding of their bytes."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            data = self.bytes_of[a] + self.bytes_of[b]
            ids = self.merge(data) if len(data) <= 2 * LEAF_BYTES else self.piece(data, strict=True)
            ok = self.pairs[a, b] = ids == [a, b]
        return ok

    def piece(self, data: bytes, strict: bool = False) -> list[int]:
        """Ids of one pre-token: halves, encoded, and joined."""
        if len(data) <= LEAF_BYTES or (strict and len(data) <= 1024):
            return self.merge(data)
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        half = len(data) // 2
        return self.join_tokens(self.piece(data[:half]), self.piece(data[half:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sides' bytes, from their encodings."""
        if not left or not right or self.stands(left[-1], right[0]):
            return left + right
        i = j = 2
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            inner = b"".join(self.bytes_of[t] for t in left[len(left) - i :] + right[:j])
            mid = self.merge(inner)
            grow_left = i < len(left) and not self.stands(left[-i - 1], mid[0])
            grow_right = j < len(right) and not self.stands(mid[-1], right[j])
            if not grow_left and not grow_right:
                return left[: len(left) - i] + mid + right[j:]
            i, j = i * 2 if grow_left else i, j * 2 if grow_right else j

    # --- between pre-tokens

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text (they cover it), by halves."""
        find = self.fast if PLAIN.fullmatch(text) else self.slow
        return self._split(text, 0, len(text), find)

    def _split(self, text: str, a: int, b: int, find) -> list[str]:
        if b - a <= LEAF_CHARS:
            return find.findall(text[a:b] if (a, b) != (0, len(text)) else text)
        half = (a + b) // 2
        return self.join_pieces(self._split(text, a, half, find), self._split(text, half, b, find), find)

    @staticmethod
    def join_pieces(left: list[str], right: list[str], find) -> list[str]:
        """Re-run the pattern from the first match that may change, until it meets a match of the right side."""
        i, seen = len(left), 0
        while i and seen < LOOK:
            i -= 1
            seen += len(left[i])
        if i:
            i -= 1  # its end is LOOK characters off, but the one before is safe in any case
        window, j = "".join(left[i:]), 0
        border, step = len(window), 8
        while True:
            j = min(j + step, len(right))
            step *= 2
            more = "".join(right[:j])
            starts = {border}
            at = border
            for p in right[:j]:
                at += len(p)
                starts.add(at)
            out, end = [], 0
            for m in find.finditer(window + more):
                s = m.start()
                if s >= border and s in starts:
                    break
                out.append(m[0])
                end = m.end()
            else:
                s = end
            # the match before `s` must not have looked past what the window holds
            if j == len(right) or (s in starts and s + LOOK <= border + len(more)):
                if s < border + len(more):
                    at, k = border, 0
                    while at < s:
                        at += len(right[k])
                        k += 1
                    return left[:i] + out + right[k:]
                return left[:i] + out + right[j:]

    # --- whole texts

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_made: dict[tuple[str, str], ByteBpe] = {}


def of(path: str, pattern: str) -> ByteBpe:
    """One encoder for each Python worker."""
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBpe(load_ranks(path), pattern)
    return _made[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each text. One narrow pass; null text counts as empty, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = of(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                ids = [np.asarray(bpe.encode(t or ""), np.int32) for t in s.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([s.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes that the ids stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = of(path, pattern)
        for b in batches:
            out = [bpe.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes): digests of the ids and of what they decode to.

    Both directions run in one pass, so that ids need not cross to the JVM and
    back. Null text: empty, 0 tokens. Repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = of(path, pattern)
        for b in batches:
            n, a, d, size = [], [], [], []
            for t in b.column(1):
                ids = bpe.encode(t.as_py() or "")
                back = bpe.decode(ids)
                n.append(len(ids))
                a.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                d.append(hashlib.sha256(back).hexdigest())
                size.append(len(back))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d), pa.array(size, pa.int64())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
