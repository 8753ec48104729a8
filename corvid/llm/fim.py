"""Fill-in-the-middle transformation on ropes, and its inverse.

A text becomes a rope: a balanced tree whose leaves hold a run of units and
cache how many units and code points they have; inner nodes add these up. Both
cuts go down one path of the tree by unit rank. The parts are put in the new
order with sentinels between, which makes a few new inner nodes and moves no
text; the text is written once, leaf by leaf. The inverse splits a rope of the
output by code points at its sentinels and puts the parts back in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import free, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # fixed values: the sentinels
PLAIN, PSM, SPM = "plain", "psm", "spm"
LEAF = 512  # units of a leaf


@dataclass(slots=True)
class Rope:
    """A leaf has ``text`` and ``ends`` (code points at which its units end); an inner node has two sides."""

    units: int
    points: int
    text: str = ""
    ends: np.ndarray | None = None
    left: "Rope | None" = None
    right: "Rope | None" = None


NOTHING = Rope(0, 0)


def unit_ends(text: str) -> np.ndarray:
    """Code points at which units end: a word with the white space before it; white space at the end of the text is a unit."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = (c == 32) | ((c >= 9) & (c <= 13))
    last = ~space
    last[:-1] &= space[1:]
    if len(c):
        last[-1] = True
    return np.flatnonzero(last) + 1


def leaf(text: str, ends: np.ndarray) -> Rope:
    return Rope(len(ends), len(text), text, ends) if text else NOTHING


def join(a: Rope, b: Rope) -> Rope:
    if not a.points:
        return b
    return Rope(a.units + b.units, a.points + b.points, left=a, right=b) if b.points else a


def balanced(leaves: list[Rope]) -> Rope:
    """One tree over the leaves, level by level."""
    while len(leaves) > 1:
        leaves = [join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else NOTHING


def rope(text: str, per_leaf: int = LEAF) -> Rope:
    ends = unit_ends(text)
    out, start = [], 0
    for i in range(0, len(ends), per_leaf):
        own = ends[i : i + per_leaf]
        out.append(leaf(text[start : own[-1]], own - start))
        start = int(own[-1])
    return balanced(out)


def split(r: Rope, rank: int, by_units: bool = True) -> tuple[Rope, Rope]:
    """The first ``rank`` units (or code points), and the rest. A leaf that is cut inside a unit has no part of that unit's end on its left."""
    size = r.units if by_units else r.points
    if rank <= 0:
        return NOTHING, r
    if rank >= size:
        return r, NOTHING
    if r.left is not None:
        mine = r.left.units if by_units else r.left.points
        if rank < mine:
            a, b = split(r.left, rank, by_units)
            return a, join(b, r.right)
        a, b = split(r.right, rank - mine, by_units)
        return join(r.left, a), b
    at = int(r.ends[rank - 1]) if by_units else rank
    k = int(np.searchsorted(r.ends, at, "right"))
    return leaf(r.text[:at], r.ends[:k]), leaf(r.text[at:], r.ends[k:] - at)


def written(r: Rope) -> str:
    out, todo = [], [r]
    while todo:
        x = todo.pop()
        if x.left is None:
            out.append(x.text)
        else:
            todo += [x.right, x.left]
    return "".join(out)


def mark(sentinel: str) -> Rope:
    return Rope(0, len(sentinel), sentinel, np.zeros(0, np.int64))


def draws(doc_id: object, seed: int) -> tuple[int, ...]:
    """Four unsigned integers of 32 bits from the id alone, so that a row's form does not depend on how rows are dealt."""
    return tuple(np.frombuffer(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16], ">u4").tolist())


def rearranged(text: str, doc_id: object, seed: int, rate: int, spm_rate: int) -> tuple[str, int, str, int | None, int | None]:
    """(output, n, form, prefix_chars, middle_chars) of one text."""
    whole = rope(text)
    n = whole.units
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return text, n, PLAIN, None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, rest = split(whole, first)
    middle, suffix = split(rest, second - first)
    form = SPM if h4 % 100 < spm_rate else PSM
    order = [mark(SUFFIX), suffix, mark(PREFIX), prefix] if form == SPM else [mark(PREFIX), prefix, mark(SUFFIX), suffix]
    return written(balanced([*order, mark(MIDDLE), middle])), n, form, prefix.points, middle.points


def restored(output: str, form: str) -> str:
    """The text that ``output`` was made of. A sentinel is in it once: neither the text nor a seam can hold another."""
    if form == PLAIN:
        return output
    inner, middle = (SUFFIX, MIDDLE) if form == PSM else (PREFIX, MIDDLE)
    _, body = split(rope(output), len(PREFIX), by_units=False)  # behind the first sentinel
    a, b = (output.index(s) - len(PREFIX) for s in (inner, middle))
    one, rest = split(body, a, by_units=False)
    _, rest = split(rest, len(inner), by_units=False)
    two, rest = split(rest, b - a - len(inner), by_units=False)
    _, three = split(rest, len(middle), by_units=False)
    parts = [one, three, two] if form == PSM else [two, three, one]
    return written(balanced(parts))


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text, or its parts in another order between sentinels.

    ``rate``: how many of a hundred texts are rearranged, ``spm_rate``: how many
    of a hundred of these get the suffix first. A null text counts as empty; an
    empty one, or one that holds a sentinel, stays plain, with null lengths. A
    null id draws like an empty one. Whole texts, one narrow pass; repeated rows
    give repeated results, and repeated ids with other texts the same draws; an
    empty table gives an empty one; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [rearranged(t or "", i, seed, rate, spm_rate) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            out, n, form, pre, mid = zip(*made, strict=True) if made else ((),) * 5
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(pre, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumnRenamed("doc_id", id_col)


def restore(outputs: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``outputs`` with the original text in ``restored`` (or a name like it that is free). A null output gives an empty text, a null form counts as plain."""
    name = free(outputs, "restored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = {f.lower(): i for i, f in enumerate(b.schema.names)}
            texts = [restored(o or "", f or PLAIN) for o, f in zip(b.column(at[output_col.lower()]).to_pylist(), b.column(at[form_col.lower()]).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, name])

    return outputs.mapInArrow(run, StructType([*outputs.schema.fields, StructField(name, StringType())]))


def digests(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): ``transform`` and ``restore`` of each row, as digests."""
    both = restore(transform(docs, seed, id_col=id_col, text_col=text_col).select(F.col(id_col).alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output"))
    out = both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
    return out.withColumnRenamed("doc_id", id_col)
