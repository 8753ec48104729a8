"""BPE with word ends, by rank-synchronous merging of ragged numpy arrays.

Pre-tokens that a worker has not met are held side by side in one flat array
of symbols. Each round looks up the rank of every adjacent pair, takes each
pre-token's lowest, and applies that pair at all its places in all pre-tokens
at once, until no pair is left; the symbols that survive are the tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CACHE = 200_000  # pre-tokens remembered by a worker, about 200 bytes each
ROUND = 400_000  # symbols held at once, or one pre-token
NONE = np.int64(1 << 40)

# What the tokenizer's pattern keeps, for texts of PLAIN characters.
PLAIN = re.compile("[\t-\r -~¡-ÿ]*")
PLAIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


def byte_chars() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class WordBpe:
    """Ids of texts by a tokenizer file with normaliser, pre-tokenizer and BPE with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        self.v = np.int64(len(vocab) + len(spec["added_tokens"]))
        chars = byte_chars()
        self.char_byte = {c: i for i, c in enumerate(chars)}
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        code = np.array([vocab[a] * self.v + vocab[b] for a, b in pairs], np.int64)
        self.hash_pairs(code)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # all places of a pair can be merged at once only if no merge makes a pair of lower rank
        first: dict[str, int] = {}
        for i, (a, b) in enumerate(pairs):
            first.setdefault(a + b, i)
        self.ordered = all(max(first.get(a, -1), first.get(b, -1)) < i for i, (a, b) in enumerate(pairs))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        tok = Tokenizer.from_file(path)
        self.normal, self.pre = tok.normalizer, tok.pre_tokenizer
        self.cache: dict[bytes | str, bytes] = {}  # ids as little-endian unsigned 32-bit integers

    def words(self, text: str) -> list[str | bytes]:
        """Pre-tokens: str where the text is PLAIN, else bytes as the tokenizer's own parts give them."""
        if PLAIN.fullmatch(text):
            return PLAIN_SPLIT.findall(text.lower())
        out = []
        for p, _ in self.pre.pre_tokenize_str(self.normal.normalize_str(text)):
            out.append(bytes(map(self.char_byte.__getitem__, p)))
        return out

    def hash_pairs(self, code: np.ndarray) -> None:
        """An open table of pairs in which each is at its slot or one of the next two."""
        size, self.shift = 1 << 20, np.uint64(44)
        for seed in range(1, 2000):
            self.mult = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1))
            table, rank = np.full(size + 3, -1, np.int64), np.full(size + 3, NONE)
            left = np.arange(len(code))
            slot = self.slot(code)
            for step in range(3):
                free = table[slot[left] + step] == -1
                table[slot[left[free]] + step] = code[left[free]]
                left = left[table[slot[left] + step] != code[left]]
            if not len(left):
                break
        else:
            raise ValueError("no hash places all pairs")
        for step in range(3):
            at = np.flatnonzero(table[slot + step] == code)
            rank[slot[at] + step] = at
        self.table, self.rank = table, rank

    def slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * self.mult) >> self.shift).astype(np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.v + b
        at = self.slot(code)
        for _ in range(2):
            at = np.where(self.table[at] == code, at, at + 1)
        return np.where(self.table[at] == code, self.rank[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all (non-empty) words, one after another, and where each word's end."""
        size = np.array([len(w) for w in words], np.int64)
        who = np.arange(len(words))
        done_who, done_size, done_sym = [], [], []
        data = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[data]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[data[ends]]
        edge = np.zeros(len(sym), bool)
        edge[ends] = True
        rank = np.full(len(sym), NONE)
        if len(sym) > 1:
            rank[:-1] = self.ranks_of(sym[:-1], sym[1:])
        rank[edge] = NONE
        while len(who):
            starts = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, starts)
            done = low == NONE
            if done.any():
                keep = np.repeat(~done, size)
                done_who.append(who[done])
                done_size.append(size[done])
                done_sym.append(sym[~keep])
                sym, rank, edge = sym[keep], rank[keep], edge[keep]
                who, size, low = who[~done], size[~done], low[~done]
                if not len(who):
                    break
                starts = np.cumsum(size) - size
            hit = rank == np.repeat(low, size)
            at = np.flatnonzero(hit)
            if not self.ordered:
                first = np.full(len(who), len(sym))
                np.minimum.at(first, np.repeat(np.arange(len(who)), size)[at], at)
                at = first
            else:  # a pair of equal symbols can overlap itself: every second place of a run
                near = np.flatnonzero(np.diff(at) == 1)
                if len(near):
                    begins = np.ones(len(at), bool)
                    begins[near + 1] = False
                    run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                    at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = self.made[rank[at]]
            edge[at] = edge[at + 1]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            dirty = np.zeros(len(sym), bool)
            dirty[at] = True
            size = size - np.add.reduceat(gone.astype(np.int64), starts)
            keep = ~gone
            sym, rank, edge, dirty = sym[keep], rank[keep], edge[keep], dirty[keep]
            new = np.flatnonzero(dirty)
            new = np.unique(np.concatenate([new, new[new > 0] - 1]))
            fresh = np.full(len(new), NONE)
            in_word = ~edge[new]
            a = new[in_word]
            fresh[in_word] = self.ranks_of(sym[a], sym[a + 1])
            rank[new] = fresh
        who, size, sym = map(np.concatenate, (done_who, done_size, done_sym))
        order = np.argsort(who)
        ends = np.cumsum(size[order])
        at = np.repeat((np.cumsum(size) - size)[order], size[order]) + np.arange(len(sym)) - np.repeat(ends - size[order], size[order])
        return sym[at], ends

    def learn(self, split: list[list[tuple[int | None, list[str | bytes]]]]) -> None:
        """Put the tokens of the words not met before into the cache, in batches of bounded size."""
        words: set[str | bytes] = set()
        for t in split:
            for _, ws in t:
                words.update(ws)
        new = words.difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = words
        batch: list[str | bytes] = []
        held = 0
        for w in [*new, None]:
            if w is None or held + len(w) > ROUND:
                if batch:
                    raw = [x.encode() if isinstance(x, str) else x for x in batch]
                    ids, ends = self.merge(raw)
                    data, ends = ids.astype("<u4").tobytes(), (ends * 4).tolist()
                    self.cache.update(zip(batch, (data[a:b] for a, b in zip([0, *ends], ends)), strict=True))  # noqa: B905
                batch, held = [], 0
            if w is not None:
                batch.append(w)
                held += len(w)

    def parts(self, text: str) -> list[tuple[int | None, list[str | bytes]]]:
        """(special id, []) or (None, words), in the order of the text."""
        if self.marks and "<|" in text:
            return [(self.special[p], []) if p in self.special else (None, self.words(p)) for p in self.marks.split(text) if p]
        return [(None, self.words(text))]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.parts(t) for t in texts]
        self.learn(split)
        get = self.cache.__getitem__
        out = []
        for t in split:
            if len(t) == 1 and t[0][0] is None:
                out.append(b"".join(map(get, t[0][1])))
            else:
                out.append(b"".join(mark.to_bytes(4, "little") if mark is not None else b"".join(map(get, ws)) for mark, ws in t))
        return out

    def count_batch(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        split = [self.parts(t) for t in texts]
        self.learn(split)
        get = self.cache.__getitem__
        return [sum((mark is not None) + sum(map(len, map(get, ws))) // 4 for mark, ws in t) for t in split]


_made: dict[str, WordBpe] = {}


def of(path: str) -> WordBpe:
    """One tokenizer for each Python worker."""
    if path not in _made:
        _made[path] = WordBpe(path)
    return _made[path]


def groups(texts: list[str], most: int = 2_000_000) -> Iterator[slice]:
    """Slices of the list with at most so many characters, or one text."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def count(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each text.

    One narrow pass. Null text counts as empty: 0 bytes, 0 tokens. Strings of
    special tokens inside a text are one token each, as the library has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = of(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = np.array([c for s in groups(texts) for c in bpe.count_batch(texts[s])], np.int64)
            size = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
