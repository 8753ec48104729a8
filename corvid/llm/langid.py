"""Language of texts, with spans: scripts narrow the candidates, Viterbi labels the words.

Each word is scored for each language: its log probability where training knows
the word, else the mean over its character trigrams, both as differences from
the best language. Only languages that training has seen in the word's script
are candidates for it. A Viterbi pass with a penalty for each switch labels the
words, and so the spans; the language with the most labelled letters wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

TRAIN_DOCS = 10_000  # labelled documents that the model is fitted on, at most; of these, it keeps all labels, words and trigrams
STEP_CELLS = 1 << 24  # words times labels that are labelled at once, unless one text has more
SEEN = 50_000  # counts that a task of the training holds before it gives them away
SCORE_CELLS = 1 << 15  # new words times labels that are scored at once: each word has about eight trigrams with as many cells
SWITCH = 6.0  # penalty for a change of language, in nats
WORD_CACHE = 150_000
UND = "und"
WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

# Script ranges of the Unicode blocks with letters.
SCRIPTS = [
    ("Latin", 0x41, 0x24F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x400, 0x52F),
    ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x77F), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF),
    ("Tamil", 0xB80, 0xBFF), ("Thai", 0xE00, 0xE7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Hangul", 0xAC00, 0xD7AF),
    ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Han", 0x20000, 0x2FA1F),
]


def script(word: str) -> str:
    """Script of a word's first letter."""
    c = ord(word[0])
    return next((s for s, a, b in SCRIPTS if a <= c <= b), "Other")


def grams(word: str) -> list[str]:
    w = f"\x02{word}\x03"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Logs:
    """Log probabilities of entries by language: one value for what a language lacks, and a list of what it has. Grows with what was counted, however many languages there are."""

    def __init__(self, entries: list[str], rows: np.ndarray, langs: np.ndarray, counts: np.ndarray, n: int):
        """``counts`` of the entries at ``rows`` in the languages at ``langs``, of which there are ``n``."""
        total = np.bincount(langs, counts, n) + 1
        self.none = np.log(0.5 / total)
        order = np.argsort(rows, kind="stable")
        self.langs = langs[order].astype(np.int32)
        self.more = (np.log((counts + 0.5) / total[langs]) - self.none[langs])[order].astype(np.float32)
        self.starts = np.searchsorted(rows[order], np.arange(len(entries) + 1))
        self.row = {w: i for i, w in enumerate(entries)}

    def sums(self, entries: list[str], at: np.ndarray, n: int) -> np.ndarray:
        """``n`` rows of sums by language over the entries, each added at its row; entries that training has not seen add nothing."""
        get = self.row.get
        rows = np.fromiter((get(w, -1) for w in entries), np.int64, len(entries))
        rows, at = rows[rows >= 0], at[rows >= 0]
        size = self.starts[rows + 1] - self.starts[rows]
        each = np.repeat(self.starts[rows] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum()) if len(rows) else np.zeros(0, np.int64)
        cells = np.bincount(np.repeat(at, size) * len(self.none) + self.langs[each], self.more[each], n * len(self.none))
        return (cells.reshape(n, len(self.none)) + np.bincount(at, minlength=n)[:, None] * self.none).astype(np.float32)


class Model:
    """Log probabilities of words and trigrams by language, and the scripts of each."""

    def __init__(self, langs: list[str], words: "Logs", tri: "Logs", scripts: dict[str, list[int]], docs: list[int]):
        self.langs, self.prior = langs, np.log(np.array(docs, float) + 1)
        self.words, self.tri = words, tri
        names = sorted(scripts)
        fit = np.array([scripts[n] for n in names], float).reshape(len(names), len(langs))
        fit = fit > 0.01 * np.maximum(fit.sum(0), 1)  # scripts of a hundredth of a language's words at least
        # the last row is for scripts that training has not seen: every language is a candidate
        self.script_row, self.fit = {n: i for i, n in enumerate(names)}, np.concatenate([fit, np.ones((1, len(langs)), bool)])
        self.cache: dict[str, int] = {}
        self.table = np.zeros((1024, len(langs)), np.float32)  # a row for each word of the cache

    def score(self, words: list[str]) -> np.ndarray:
        """Of each word and language: log odds against the best, -40 for languages without the word's script."""
        cuts = [grams(w) for w in words]
        whole = self.words.sums(words, np.arange(len(words)), len(words))
        by_tri = self.tri.sums([g for c in cuts for g in c], np.repeat(np.arange(len(words)), [len(c) for c in cuts]), len(words)) * 0.5
        if len(self.langs) > 1:
            best = np.sort(whole, axis=1)
            sure = best[:, -1] - best[:, -2] >= 0.7  # the word itself tells; else its trigrams help
        else:
            sure = np.ones(len(words), bool)
        s = np.where(sure[:, None], whole, whole + by_tri)
        s = np.maximum(s - s.max(1, keepdims=True), -8.0)
        fit = self.fit[[self.script_row.get(script(w), -1) for w in words]]
        return np.where(fit | ~fit.any(1, keepdims=True), s, -40.0).astype(np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        """Row of the score table of each word."""
        new = list(set(words).difference(self.cache))
        if new:
            at = len(self.cache)
            while at + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            step = max(1, SCORE_CELLS // len(self.langs))
            for i in range(0, len(new), step):
                self.table[at + i : at + min(i + step, len(new))] = self.score(new[i : i + step])
            self.cache.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))

    def viterbi(self, docs: list[list[str]], penalty: float = SWITCH) -> list[np.ndarray]:
        """The best labels of each document's words: all documents take their n-th step together."""
        if len(self.cache) * max(len(self.langs), 8) > WORD_CACHE * 8:
            self.cache = {}
            self.table = self.table[:1024].copy()
        rows = [self.ids(d) for d in docs]
        if not self.cache:
            return [np.zeros(0, np.int32) for _ in docs]
        table, L = self.table, len(self.langs)
        order = np.argsort([-len(r) for r in rows], kind="stable")
        size = np.array([len(rows[i]) for i in order])
        most = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(most), side="left")  # documents with more than t words
        starts = np.concatenate([[0], np.cumsum(live)])
        flat = np.zeros(int(starts[-1]), np.int64)  # word t of the documents alive at t, t after t
        for d, i in enumerate(order):
            flat[starts[: size[d]] + d] = rows[i]
        v = np.zeros((len(docs), L), np.float32) + (self.prior - self.prior.max()).astype(np.float32)
        # a word's label before it is its own, or the best of all: a bit of each label tells which
        stays, tops = np.zeros((len(flat), (L + 7) // 8), np.uint8), np.zeros(len(flat), np.int32)
        last = np.zeros((len(docs), L), np.float32)
        for t in range(most):
            n, at = live[t], starts[t]
            cur = v[:n]
            top = cur.argmax(1)
            jump = np.take_along_axis(cur, top[:, None], 1) - penalty
            stay = cur >= jump
            stays[at : at + n] = np.packbits(stay, axis=1, bitorder="little")
            tops[at : at + n] = top
            v[:n] = np.where(stay, cur, jump) + table[flat[at : at + n]]
            last[:n] = v[:n]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(docs)
        state = last.argmax(1)
        labels = np.zeros(len(flat), np.int32)
        for t in range(most - 1, -1, -1):
            n, at = live[t], starts[t]
            labels[at : at + n] = state[:n]
            stay = stays[at + np.arange(n), state[:n] >> 3] >> (state[:n] & 7) & 1
            state[:n] = np.where(stay, state[:n], tops[at : at + n])
        for d, i in enumerate(order):
            out[i] = labels[starts[: size[d]] + d]
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of each run of words with one label."""
        found = list(WORDS.finditer(text))
        labels = self.viterbi([[m[0].lower() for m in found]])[0]
        out: list[tuple[int, int, str]] = []
        for m, k in zip(found, labels, strict=True):
            lang = self.langs[k]
            if out and out[-1][2] == lang:
                out[-1] = (out[-1][0], m.end(), lang)
            else:
                out.append((m.start(), m.end(), lang))
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, share of letters that carry its label) of each text."""
        if not self.langs:
            return [(UND, 0.0)] * len(texts)
        docs = [WORDS.findall(t.lower()) for t in texts]
        paths: list[np.ndarray] = []
        at = 0
        while at < len(docs):  # as many texts together as the bound on cells lets
            end, cells = at, 0
            while end < len(docs) and (end == at or cells + len(docs[end]) * len(self.langs) <= STEP_CELLS):
                cells += len(docs[end]) * len(self.langs)
                end += 1
            paths += self.viterbi(docs[at:end])
            at = end
        out = []
        for words, labels in zip(docs, paths, strict=True):
            if not any(c.isalpha() for w in words for c in w):  # \w has numerals besides letters and digits
                out.append((UND, 0.0))
                continue
            weight = np.bincount(labels, np.fromiter(map(len, words), float, len(words)), len(self.langs))
            best = int(weight.argmax())
            out.append((self.langs[best], float(weight[best] / weight.sum())))
        return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(docs: DataFrame, most: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most ``most`` labelled rows (those with the smallest hashes of their id), each whole.

    That number of rows is the only bound: all labels, words and trigrams of
    these rows are learned. Null or empty labels and texts take no part; without
    any row, a model without labels.
    """
    rows = docs.where(F.col(text_col).isNotNull() & (F.coalesce(F.trim(F.col(lang_col)), F.lit("")) != "")).select(id_col, F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # a threshold on the hash, from the count, leaves little to sort
    n = rows.count()
    h = F.xxhash64(id_col)
    share = min(1.0, 1.2 * most / max(n, 1) + 0.001)
    sample = rows.where(h < F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else rows
    sample = sample.withColumn("h", h)
    if sample.count() > most:
        edge = sample.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
        sample = sample.where(F.col("h") <= edge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys]), pa.array([seen[k] for k in keys], pa.int64())], names=["kind", "lang", "gram", "c"])
            seen.clear()
            return out

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = Counter(WORDS.findall(text.lower()))
                for w, c in words.items():
                    seen["w", lang, w] += c
                    seen["s", lang, script(w)] += c
                    for g in grams(w):
                        seen["t", lang, g] += c
                seen["d", lang, ""] += 1
                if len(seen) > SEEN:
                    yield flush()
        if seen:
            yield flush()

    counts = cut(sample.select("text", "lang").mapInArrow(run, "kind string, lang string, gram string, c long").groupBy("kind", "lang", "gram").agg(F.sum("c").alias("c")), "gram-counts")
    told = counts.toArrow()  # of at most ``most`` texts
    names = sorted(set(told["lang"].to_pylist()))
    place = pa.array(names, pa.string())

    def of_kind(kind: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        t = told.filter(pc.equal(told["kind"], kind)).combine_chunks()
        grams_of = t["gram"].combine_chunks().dictionary_encode() if len(t) else pa.array([], pa.string()).dictionary_encode()
        return grams_of.dictionary.to_pylist(), grams_of.indices.to_numpy().astype(np.int64), pc.index_in(t["lang"], place).to_numpy().astype(np.int64), t["c"].to_numpy().astype(float)

    words, tri = (Logs(*of_kind(k), len(names)) for k in ("w", "t"))
    dense: dict[str, dict[str, list[int]]] = {"s": {}, "d": {}}
    for kind, table in dense.items():
        entries, rows_of, langs_of, n_of = of_kind(kind)
        for r, k, c in zip(rows_of, langs_of, n_of, strict=True):
            table.setdefault(entries[r], [0] * len(names))[k] += int(c)
    return Model(names, words, tri, dense["s"], dense["d"].get("", [0] * len(names)))


def predict(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score), and the spans of each text if asked for.

    ``und`` with score 0 where the text is null or has no letter. One narrow
    pass over whole texts; the model (bounded by ``train``) is broadcast. Repeated
    rows give repeated results, very long texts are labelled whole, an empty table
    gives an empty one; further columns are not read.
    """
    sent = spark.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                texts = [t or "" for t in s.column(1).to_pylist()]
                got = m.predict(texts)
                cols = [s.column(0), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.float64())]
                names = [id_col, "lang_pred", "score"]
                if spans:
                    cols.append(pa.array([[{"start": a, "end": e, "lang": k} for a, e, k in m.spans(t)] for t in texts], span_type))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", spans array<struct<start: long, end: long, lang: string>>" if spans else ""
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double{more}")


def with_letters(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that have a language: a predicted one, or any letter. Rows pass through where they are.

    Null text, and text without a letter, has none, whatever the model has
    learned; a letter is enough where the model has no label to give.
    """
    sent = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                texts = [t or "" for t in s.column(place).to_pylist()]
                found = sent.value.predict(texts)
                yield s.filter(pa.array([f[0] != UND or has_letter(t) for f, t in zip(found, texts, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
