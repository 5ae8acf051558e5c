"""Prefix trie of conversations: which first turns they share, and what sharing saves.

1. Turns go to the task of their block of ``FAMILY`` conversations, sorted by conversation and turn.
   A conversation is rebuilt there and becomes its chain of digests: entry d hashes entry d - 1 and
   the d-th turn, so equal entries mean equal prefixes. Texts stay behind.
2. Equal conversations collapse into one class by their last entry. Classes are dealt to tasks by
   ranges of their chains, so conversations with common first turns are neighbours.
3. Every task inserts its classes in batches into a Z-fast trie (``ZFast``) of at most ``TRIE_TURNS``
   turns. Compacted nodes are hashed at the handle of two-fattest depth on their edge; a fat binary
   search over handles finds the exit node in the logarithm of the depth. Edges are then expanded:
   one row per depth.
4. Counts of tries add up by the digest of the node. Tries next to each other share one path only,
   that of the prefix common to the last class of one and the first of the other; what both would
   count there is subtracted once, from the borders inside a task as it goes, between tasks by
   correction rows.
5. The ids that end at a node are hashed in numeric order: ranges of (node, id) are joined to texts
   of up to ``CHUNK_IDS`` ids in parallel, and one pass over these texts makes the digest of a node.

No key is a hot one: a first turn that a third of all conversations share is a node, not a group of
rows; copies are pre-aggregated. A block holds few conversations; one conversation alone is held by
a task as 24 bytes a turn.

Rows without conv_id take no part. A null role or text is empty; a null turn comes first. Turns of
equal number are ordered by role and text, repeated rows are turns of their own. Long texts are
hashed whole, in the JVM. A conversation without turns ends at the root. An empty table has no nodes.
For negative ids the remainder has the sign of the id. Other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxstats.operators.joins import lookup_join
from boxstats.storage import materialize

FAMILY, HEAD_TURNS = 20, 4
WIDTH = 16
ROOT = bytes(WIDTH)
#: Turns inserted into one trie, and per range of classes on average.
TRIE_TURNS, RANGE_TURNS = 100_000, 400_000
CHUNK_IDS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


def head_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % HEAD_TURNS


class Node:
    """A compacted node: the prefixes of ``chain`` with depths in (above, depth]."""

    __slots__ = ("above", "depth", "chain", "words", "children", "parent", "count", "least")

    def __init__(self, above, depth, chain, words, parent):
        self.above, self.depth, self.chain, self.words, self.parent = above, depth, chain, words, parent
        self.children: dict[bytes, Node] = {}
        self.count, self.least = 0, 2**63 - 1

    def key(self, depth: int) -> bytes:
        return _entry(self.chain, depth) if depth else ROOT

    def agrees(self, chain: bytes, depth: int) -> bool:
        return len(chain) >= WIDTH * depth and self.key(depth) == (_entry(chain, depth) if depth else ROOT)


class ZFast:
    """A compacted trie whose nodes are found by the hash of one prefix on their edge, the handle."""

    def __init__(self):
        self.root = Node(-1, 0, b"", np.zeros(0, np.int64), None)
        self.handles: dict[bytes, Node] = {}

    def _place(self, node: Node) -> None:
        self.handles[node.key(two_fattest(node.above, node.depth))] = node

    def locate(self, chain: bytes, start: Node) -> Node:
        """The exit node of ``chain``: the node on whose edge it ends or leaves the trie, or at whose end it
        does. ``start`` is a node whose end the chain passes. Fat binary search over depths."""
        found, low, high = start, start.depth, len(chain) // WIDTH
        while low < high:
            middle = two_fattest(low, high)
            node = self.handles.get(_entry(chain, middle))
            if node is None:
                high = middle - 1
            elif not node.agrees(chain, node.depth):
                return node
            else:
                found, low = node, node.depth
        # No node below ends on the chain. It may still leave on the edge of a child, above its handle.
        if low * WIDTH < len(chain):
            found = found.children.get(_entry(chain, low + 1), found)
        return found

    @staticmethod
    def common(node: Node, chain: bytes) -> int:
        """The depth at which ``chain`` leaves the edge of its exit node, by halving."""
        low, high = max(node.above, 0), min(node.depth, len(chain) // WIDTH)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if node.agrees(chain, middle) else (low, middle - 1)
        return low

    def insert(self, batch: list[tuple[bytes, np.ndarray, int, int]]) -> None:
        """(chain, words, conversations, smallest id) of distinct chains. All exits are located first; an
        insertion then goes on from there, since earlier ones of the batch only cut the edge of its exit or
        hang new nodes below it."""
        exits = [self.locate(chain, self.root) for chain, *_ in batch]
        for (chain, words, count, least), node in zip(batch, exits):
            while node.parent is not None and not node.agrees(chain, node.above + 1):
                node = node.parent
            at = self.common(node, chain)
            if at == node.depth:
                node = self.locate(chain, node)
                at = self.common(node, chain)
            if at < node.depth:
                node = self._cut(node, at)
            if at < len(chain) // WIDTH:
                leaf = Node(at, len(chain) // WIDTH, chain, words, node)
                node.children[leaf.key(at + 1)] = leaf
                self._place(leaf)
                node = leaf
            node.count += count
            node.least = min(node.least, least)

    def _cut(self, node: Node, at: int) -> Node:
        """Cuts the edge of ``node`` at a depth inside; its new upper part. The old handle stays with the part
        that holds its depth, the other part gets its own."""
        upper = Node(node.above, at, node.chain, node.words, node.parent)
        upper.children[node.key(at + 1)] = node
        node.parent.children[node.key(node.above + 1)] = upper
        node.above, node.parent = at, upper
        self._place(upper)
        self._place(node)
        return upper

    def expand(self, before: bytes | None, first: bytes) -> pa.RecordBatch:
        """One row per prefix. ``before`` is the chain of the class just before the trie's ``first`` one in the
        order of chains: what that class counted on their common path is not counted as new again."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children.values())
        n = len(order)
        place = {id(x): i for i, x in enumerate(order)}
        up = np.array([-1] + [place[id(x.parent)] for x in order[1:]])
        above, depth = np.array([x.above for x in order]), np.array([x.depth for x in order])
        count, least = np.array([x.count for x in order], np.int64), np.array([x.least for x in order], np.int64)
        leaves = np.array([not x.children for x in order], np.int64)
        seen = -1 if before is None else shared(before, first)
        # Rows at the start of each edge that the class before has too.
        old = np.array([int(seen >= 0)] + [min(seen, x.depth) - x.above if x.above < seen and x.agrees(first, x.above + 1) else 0 for x in order[1:]])
        length = depth - above
        start = np.cumsum(length) - length
        words = np.concatenate([np.zeros(1, np.int64)] + [x.words[x.above : x.depth] for x in order[1:]])
        total, fresh = int(length.sum()), np.zeros(n, np.int64)
        below, saved = np.zeros(n, np.int64), np.zeros(total, np.int64)
        # Children come after their parents in the order.
        for i in range(n - 1, -1, -1):
            part = slice(start[i], start[i] + length[i])
            own = count[i] * words[part]
            own[old[i] :] -= words[part][old[i] :]
            saved[part] = below[i] + np.cumsum(own[::-1])[::-1]
            if i:
                p = up[i]
                below[p] += saved[start[i]]
                count[p] += count[i]
                least[p] = min(least[p], least[i])
                leaves[p] += leaves[i]
                fresh[p] += old[i] == 0
        owner = np.repeat(np.arange(n), length)
        step = np.arange(total) - start[owner]
        known = step < old[owner]
        deep = above[owner] + 1 + step
        children = np.where(deep == depth[owner], fresh[owner], (step + 1 >= old[owner]).astype(np.int64))
        # The class before was a leaf where it ended; if the first class goes on from there, it is none.
        extends = seen >= 0 and seen * WIDTH == len(before)
        raw = ROOT + b"".join(x.chain[WIDTH * x.above : WIDTH * x.depth] for x in order[1:])
        keys = [raw[WIDTH * i : WIDTH * (i + 1)] for i in range(total)]
        parents, parent_conv = [None, *keys[:-1]], least[owner]
        for i in range(1, n):
            parents[start[i]] = order[i].parent.key(order[i].above)
            parent_conv[start[i]] = least[up[i]]
        return _rows(
            key=keys, depth=deep, parent=parents, conv_id=least[owner], parent_conv_id=pa.array(parent_conv, mask=np.arange(total) == 0),
            n_convs=count[owner], n_children=children, n_leaves=leaves[owner] - (known & extends), saved_tokens=saved,
        )


def _entry(chain: bytes, depth: int) -> bytes:
    return chain[WIDTH * (depth - 1) : WIDTH * depth]


def shared(a: bytes, b: bytes) -> int:
    """Entries at the start that two chains have in common."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if _entry(a, middle) == _entry(b, middle) else (low, middle - 1)
    return low


_FIELDS = {
    "key": pa.binary(), "depth": pa.int64(), "parent": pa.binary(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(),
    "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "part": pa.int32(), "first": pa.binary(), "words": pa.binary(), "last": pa.binary(),
}
_SCHEMA = ", ".join(f"{k} {({pa.int64(): 'long', pa.int32(): 'int', pa.binary(): 'binary'})[t]}" for k, t in _FIELDS.items())


def _rows(**columns) -> pa.RecordBatch:
    """Rows of node counts, or of the border of a task; absent columns are null."""
    n = len(next(iter(columns.values())))
    arrays = [columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in _FIELDS.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(_FIELDS))


def chains(conversations: DataFrame, family: int | None = None) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, chain (digests of its prefixes), words (of each turn), tail (last digest).

    With a ``family`` F, conversation c starts with the first h turns of conversation c - c % F and goes on with
    its own after its first h, where h is the crc32 of c in decimals modulo HEAD_TURNS.
    """
    empty = F.lit("")
    conv = F.col("conv_id").cast("long")
    rows = conversations.select(
        conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"), (conv - conv % family if family else conv).alias("block"),
    ).filter("conv_id IS NOT NULL")
    rows = rows.repartition("block").sortWithinPartitions("block", F.col("conv_id") != F.col("block"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    symbol = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)), 1, WIDTH)
    turns = rows.select("conv_id", "block", symbol.alias("symbol"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n"))

    def work(batches):
        from array import array

        conv_id = block = None
        head: list[tuple[bytes, int]] = []
        done: list[tuple] = []

        def close():
            if conv_id is not None:
                done.append((conv_id, bytes(chain), words.tobytes(), bytes(chain[-WIDTH:]) or ROOT))

        def push(digest, n):
            chain.extend(hashlib.blake2b(chain[-WIDTH:] + digest, digest_size=WIDTH).digest())
            words.append(n)

        for batch in batches:
            for c, b, digest, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c != conv_id:
                    close()
                    if b != block:
                        block, head = b, []
                    conv_id, chain, words, at = c, bytearray(), array("q"), 0
                    h = head_turns(c) if family else 0
                    if c != b:
                        for turn in head[:h]:
                            push(*turn)
                if c == b:
                    if at < HEAD_TURNS - 1:
                        head.append((digest, n))
                    push(digest, n)
                elif at >= h:
                    push(digest, n)
                at += 1
            yield _sequences(done)
            done = []
        close()
        yield _sequences(done)

    return turns.mapInArrow(work, "conv_id long, chain binary, words binary, tail binary")


def _sequences(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(x, pa.binary()) for x in columns[1:])], names=["conv_id", "chain", "words", "tail"])


def trie(conversations: DataFrame, family: int | None = None, trie_turns: int = TRIE_TURNS) -> DataFrame:
    """One row per distinct sequence of first turns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256 (of the ids of the conversations that end there)."""
    known = materialize(chains(conversations, family))
    turns = known.agg(F.sum(F.length("chain") / WIDTH)).first()[0] or 0
    n = max(int(turns) // RANGE_TURNS + 1, known.sparkSession.sparkContext.defaultParallelism)
    classes = known.groupBy("tail").agg(F.first("chain").alias("chain"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    dealt = classes.repartitionByRange(n, "chain").sortWithinPartitions("chain").select("chain", "words", "n", "least")
    counted = materialize(dealt.mapInArrow(_grow(trie_turns), _SCHEMA))
    parts = counted.filter("part IS NOT NULL").select("part", "first", "words", "last")
    # Neighbouring tasks meet once: one row a task.
    borders = parts.withColumn("before", F.lag("last").over(Window.orderBy("part"))).filter("before IS NOT NULL")
    fixes = borders.select("before", "first", "words").mapInArrow(_mend, _SCHEMA)
    sums = counted.filter("part IS NULL").unionByName(fixes)
    nodes = sums.groupBy("key").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("parent_conv_id").alias("parent_conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.count("depth").alias("tries"),
    )
    nodes = materialize(nodes)
    # Only a node of several tries can have a member below that the trie of its child doesn't know.
    wide = nodes.filter("tries > 1").select(F.col("key").alias("parent"), F.col("conv_id").alias("_least"))
    nodes = lookup_join(nodes, wide, ["parent"], "left", table_rows=wide.count())
    ends = _ends(known).withColumnRenamed("tail", "key")
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.join(ends, "key", "left").select(
        "conv_id", "depth", F.coalesce("_least", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def _grow(trie_turns: int):
    """Inserts sorted classes into tries and yields their nodes, then the border of the task."""

    def work(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tree, held, before, first, last = ZFast(), 0, None, None, None
        border = None
        for batch in batches:
            found = []
            for chain, words, n, least in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = np.frombuffer(words, np.int64)
                border = border or (chain, words)
                first = chain if first is None else first
                found.append((chain, words, n, least))
                held += len(words) + 1
                last = chain
                if held >= trie_turns:
                    tree.insert(found)
                    yield tree.expand(before, first)
                    tree, held, before, first, found = ZFast(), 0, last, None, []
            tree.insert(found)
        if held:
            yield tree.expand(before, first)
        if border:
            yield _rows(part=[part], first=[border[0]], words=[border[1].tobytes()], last=[last])

    return work


def _mend(batches):
    """What the first trie of a task counted again of the path it shares with the task before."""
    for batch in batches:
        for before, first, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
            depth = shared(before, first)
            words = np.frombuffer(words, np.int64)[:depth]
            again = np.concatenate([np.cumsum(words[::-1])[::-1], [0]])
            leaf = -int(depth * WIDTH == len(before))
            yield _rows(
                key=[_entry(first, d) if d else ROOT for d in range(depth + 1)], n_convs=np.zeros(depth + 1, np.int64),
                n_children=[-1] * depth + [0], n_leaves=[leaf] * (depth + 1), saved_tokens=[int(again[max(d - 1, 0)]) for d in range(depth + 1)],
            )


def _ends(known: DataFrame) -> DataFrame:
    """tail -> ends_sha256. The ids of one node lie in many tasks, which write them down; only the texts meet."""

    def write(batches):
        for batch in batches:
            tails, ids = batch.column(0), np.asarray(batch.column(1))
            codes = tails.dictionary_encode()
            codes = np.asarray(codes.indices)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(ids)]])
            begins = [b for a, e in zip(edges[:-1].tolist(), edges[1:].tolist()) for b in range(a, e, CHUNK_IDS)]
            edges = np.union1d(edges, begins)
            pairs = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [tails.take(pa.array([a for a, _ in pairs], pa.int64())), pa.array(ids[edges[:-1]]), pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in pairs])],
                names=["tail", "least", "ids"],
            )

    def digest(batches):
        tail, state = None, None
        for batch in batches:
            done = []
            for t, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t == tail:
                    state.update(b",")
                else:
                    if state:
                        done.append((tail, state.hexdigest()))
                    tail, state = t, hashlib.sha256()
                state.update(ids.encode())
            yield _digests(done)
        if state:
            yield _digests([(tail, state.hexdigest())])

    ordered = known.select("tail", "conv_id").repartitionByRange("tail", "conv_id").sortWithinPartitions("tail", "conv_id")
    texts = ordered.mapInArrow(write, "tail binary, least long, ids string")
    return texts.repartition("tail").sortWithinPartitions("tail", "least").select("tail", "ids").mapInArrow(digest, "tail binary, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["tail", "ends_sha256"])
