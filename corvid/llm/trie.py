"""Prefix trie of conversations by one global sort of their turn arrays.

Each turn becomes a key of 16 bytes, and a conversation the string of its keys.
In the order of these strings, conversations that share a prefix stand side by
side, and the trie is what a stack sees that sweeps over them: the longest
common prefix (LCP) of two neighbours says which nodes close and which open. A
task sweeps one range of the order. Nodes on the path of its first or of its
last conversation may go on in another range; they are handed over as open
stacks, one row a task, and stitched from range to range. All other nodes are
final where they close.

Sums over subtrees are sums over what closes while a node is open. Ids of
conversations that end in a node come in ascending order, and go into its
digest as they come.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, uncut

KEY = 16  # bytes of a turn's key: the first half of a SHA-256
BLOCK = 1024  # ids in a block of those that end in one node
SHARED = 5  # turns at most that a conversation takes from the first of its hundred
STEP = 2048  # rows of an output batch
ROOT = bytes(KEY)

NODE = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()),
                  ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()), ("ids", pa.string()), ("task", pa.int64()), ("stack", pa.string())])
SCHEMA = "kind string, key binary, parent binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved long, ends string, ids string, task long, stack string"


def child_key(parent: bytes, turn: bytes) -> bytes:
    """The key of a node: a hash of the whole prefix, from its parent's key and its last turn."""
    return hashlib.blake2b(parent + turn, digest_size=KEY).digest()


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their start, by halving."""
    low, high = 0, min(len(a), len(b)) // KEY
    if a[: high * KEY] == b[: high * KEY]:
        return high
    while low + 1 < high:  # the first `low` turns agree, the first `high` do not
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * KEY : mid * KEY] == b[low * KEY : mid * KEY] else (low, mid)
    return low


class Node:
    """An open node: what has ended or closed below it so far."""

    __slots__ = ("key", "chars", "low", "n", "children", "leaves", "saved", "hash", "open", "left")

    def __init__(self, key: bytes, chars: int, left: bool = False):
        self.key, self.chars, self.left = key, chars, left
        self.low, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.hash = None  # of the ids that end here
        self.open = False  # whether ids that end here may be in other ranges as well

    def takes(self, low: int | None, n: int) -> None:
        self.n += n
        if low is not None and (self.low is None or low < self.low):
            self.low = low

    def closed(self) -> tuple[int, int]:
        """Leaves and saved characters of the whole subtree."""
        return self.leaves or 1, self.saved + (self.n - 1) * self.chars

    def folds(self, child: "Node") -> None:
        """A child is final."""
        leaves, saved = child.closed()
        self.takes(child.low, child.n)
        self.children += 1
        self.leaves += leaves
        self.saved += saved

    def row(self, parent: "Node | None", depth: int) -> dict:
        leaves, saved = self.closed()
        ends = None if self.open else (self.hash or hashlib.sha256()).hexdigest()
        return {"kind": "node", "key": self.key, "parent": parent and parent.key, "conv_id": self.low, "depth": depth, "n_convs": self.n,
                "n_children": self.children, "n_leaves": leaves, "saved": saved, "ends": ends}

    def packed(self) -> list:
        """What another range needs to go on with it."""
        return [self.key.hex(), self.chars, self.low, self.n, self.children, self.leaves, self.saved, None if self.open else self.hash and self.hash.hexdigest(), self.open]


def sweep(rows: Iterator[tuple[bytes, list[int], int]], task: int) -> Iterator[dict]:
    """Rows (path, lengths of turns, conv_id) in order, to final nodes, blocks of ids, and one row of open stacks."""
    stack: list[Node] = []
    ends: list[int] = []  # ids that end in the node on top and are in no block yet
    left: list[list] = []  # nodes of the first path that have closed, deepest first
    prev: bytes | None = None
    first = b""

    def block(node: Node) -> dict:
        text = ",".join(map(str, ends))
        low = ends[0]
        ends.clear()
        return {"kind": "ids", "key": node.key, "conv_id": low, "ids": text, "task": task}

    def close() -> dict | None:
        node = stack.pop()
        if node.left:  # the ranges before may have had it too
            left.append(node.packed())
            return None
        stack[-1].folds(node)
        return node.row(stack[-1], len(stack))

    for path, lengths, conv_id in rows:
        if prev is None:
            stack.append(Node(ROOT, 0, left=True))
            same, first = 0, path
        else:
            same = lcp(prev, path)
        if path != prev:
            if prev is not None:
                if stack[-1].open and ends:
                    yield block(stack[-1])
                ends.clear()
            while len(stack) > same + 1:
                if (out := close()) is not None:
                    yield out
            for d in range(same, len(path) // KEY):
                stack.append(Node(child_key(stack[-1].key, path[d * KEY : (d + 1) * KEY]), lengths[d], left=prev is None))
            stack[-1].open = prev is None
        top = stack[-1]
        top.takes(conv_id, 1)
        if top.hash is None:
            top.hash = hashlib.sha256(str(conv_id).encode())
        else:
            top.hash.update(b",%d" % conv_id)
        ends.append(conv_id)
        if len(ends) >= BLOCK:
            yield block(top)
        prev = path
    if prev is None:
        return
    if ends:
        yield block(stack[-1])
    stack[-1].open = True
    told = {"first": first.hex(), "left": left, "last": prev.hex(), "stack": [n.packed() for n in stack]}
    yield {"kind": "stack", "task": task, "stack": json.dumps(told)}


def stitch(stacks: Iterator[dict]) -> Iterator[dict]:
    """Open stacks of all ranges in order, to the nodes that lie on them."""
    stack: list[Node] = []
    prev: bytes | None = None

    def unpacked(x: list) -> tuple[Node, str | None]:
        node = Node(bytes.fromhex(x[0]), x[1])
        node.low, node.n, node.children, node.leaves, node.saved, node.open = x[2], x[3], x[4], x[5], x[6], x[8]
        return node, x[7]

    digests: list[str | None] = []  # beside the stack

    def close() -> dict:
        node, ends = stack.pop(), digests.pop()
        parent = stack[-1] if stack else None
        if parent:
            parent.folds(node)
        out = node.row(parent, len(stack))
        return out | ({"ends": ends} if ends and not node.open else {})

    for told in stacks:
        first, last = bytes.fromhex(told["first"]), bytes.fromhex(told["last"])
        same = -1 if prev is None else lcp(prev, first)
        while len(stack) > same + 1:
            yield close()
        through = len(first) // KEY - len(told["left"])  # nodes of the first path to this depth are open at the end, too
        down = [*told["stack"][: through + 1], *reversed(told["left"])]
        for d, x in enumerate(down):
            node, ends = unpacked(x)
            if d <= same:
                own = stack[d]
                own.takes(node.low, node.n)
                own.children, own.leaves, own.saved = own.children + node.children, own.leaves + node.leaves, own.saved + node.saved
                own.open |= node.open
                digests[d] = digests[d] or ends
            else:
                stack.append(node)
                digests.append(ends)
        while len(stack) > through + 1:
            yield close()
        for x in told["stack"][through + 1 :]:
            node, ends = unpacked(x)
            stack.append(node)
            digests.append(ends)
        prev = last
    while stack:
        yield close()


def batches_of(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= STEP:
            yield pa.RecordBatch.from_pylist(held, NODE)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, NODE)


def turn_arrays(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as structs of key and code points of the text.

    Ordered by number (null first), then role, then key; repeated turns stay. A
    null role or text counts as empty. Rows without an id belong to no
    conversation and are left out. Texts do not move: a turn is 16 bytes of hash
    and a length.
    """
    role, text = F.coalesce(F.col(f"`{role_col}`"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    rows = turns.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), key.alias("key"), F.length(text).cast("long").alias("chars")).alias("t")
    )
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["chars"].alias("chars"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % 100, then the own turns after the first h; h = crc32(c) % 6."""
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, SHARED).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).cast("int")
    both = own.join(heads, F.col("conv_id") - F.col("conv_id") % 100 == F.col("head_id"), "left").withColumn("h", h)
    lead = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(lead, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


def trie(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each distinct prefix.

    ``conversations``: (conv_id, turns) with turns as arrays of (key, chars).
    Equal conversations are members of the same nodes; one without turns ends in
    the root; without any conversation there is no node. A conversation is one
    row of 40 bytes a turn on its way; its range is chosen by its turns and its
    id, so equal ones, however many, are dealt over the tasks.
    """
    spark = conversations.sparkSession
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = conversations.select(F.unhex(F.array_join(F.col("turns")["key"], "")).alias("path"), F.col("turns")["chars"].alias("chars"), "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        return batches_of(sweep(each, TaskContext.get().partitionId()))

    def run_stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (json.loads(x.as_py()) for b in batches for x in b.column(1))
        return batches_of(stitch(each))

    ranged = rows.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    swept = cut(ranged.mapInArrow(run, SCHEMA), "trie-swept")
    # one small row a range, in one task
    stacks = swept.where("kind = 'stack'").select("task", "stack").repartition(1).sortWithinPartitions("task")
    stitched = cut(stacks.mapInArrow(run_stitch, SCHEMA), "trie-stitched")
    nodes = swept.where("kind = 'node'").unionByName(stitched)
    plain = ["key", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved"]
    # digests of ids that ranges share: at most two nodes a range
    shared = F.broadcast(stitched.where("ends is null").select("key"))
    late = digests(swept.where("kind = 'ids'").join(shared, "key", "left_semi").select("key", "conv_id", "ids"))
    done = stitched.where("ends is null").select(*plain).join(F.broadcast(late), "key").unionByName(nodes.where("ends is not null").select(*plain, "ends"))
    done = cut(done, "trie-nodes")
    uncut(swept)
    uncut(stitched)
    parents = done.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = lookup(done.where("depth > 0"), parents, ["parent"]).select(*done.columns, "parent_conv_id")
    root = done.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.unionByName(root).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def digests(blocks: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the ids of each key, from blocks (key, conv_id, ids) in the order of their first id.

    A digest of a sequence is made by one task; it reads a block at a time and
    keeps none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if k != key:
                    if h is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], names=["key", "ends"])
                    key, h = k, hashlib.sha256(ids.as_py().encode())
                else:
                    h.update(b"," + ids.as_py().encode())
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], names=["key", "ends"])

    return blocks.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends string")


def prefix_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """The trie of all rebuilt conversations of ``turns``; see ``turn_arrays``, ``rebuilt`` and ``trie``.

    Null turns come first, null roles and texts count as empty, rows of a null id
    are left out; repeated rows are turns of their own, and ties go by role, then
    key. A conversation all of whose turns are replaced by none ends in the root.
    Texts of any length move as a hash and a length. An empty table has no node.
    Further columns, whatever their names, are not read.
    """
    return trie(rebuilt(turn_arrays(turns, id_col, turn_col, role_col, text_col)), partitions)
