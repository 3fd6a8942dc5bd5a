"""Operator 13. Prefix trie of conversations, by adaptive radix trees over turn ids.

A turn (role and text) has an id of 16 bytes, the digest of both; the key of a conversation is the
ids of its turns one after the other, so keys compare as their big-endian ids do. Equal keys are one
row, with the number of conversations, the least id, and the digest of all ids.

Distinct keys are dealt out by ranges, sorted, and every task builds an adaptive radix tree of its
range: nodes grow from 4 to 16, 48 and 256 children, a path without branches is part of the node below
it, and a key that others go on from ends inside a node. Branches can lie anywhere inside an id; only
byte depths at the end of a whole turn are nodes of the trie.

A node lies in several ranges only if it is a prefix of the first or last key of one. These few are
given out as parts and summed. Sums over a subtree count what two neighbouring ranges share twice;
that is known from the last key of one and the first of the next, and is taken off. So a first turn that
a third of all conversations share costs one row a range.

Null roles and texts are empty. Turns are ordered by turn, nulls first, then by role and text; equal rows
are all kept. Rows without ``conv_id`` belong to no conversation and are left out. A table without
conversations has no node, not even the root. Columns other than conv_id, turn, role and text are
not read. A task holds one conversation's ids at a time (24 bytes a turn) and the tree of its range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.common import staged, table, text_of

#: Bytes of the id of a turn.
WIDTH = 16
#: Conversations of a block share the first turns of its first conversation, fewer than ``SHARED``.
BLOCK, SHARED = 20, 4
#: Bytes of keys of a range, and what a key costs besides.
RANGE_BYTES, KEY_BYTES = 4 << 20, 64
#: Rows with a parent in several ranges are spread over so many keys for the look-up.
SALTS = 64
#: Bytes and rows that a task hands on at a time.
GIVEN_BYTES, GIVEN_ROWS = 8 << 20, 20_000

NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, its id and its number of words."""
    c = conversations
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].alias("turn"),
                    text_of(c["role"]).alias("role"), text_of(c["text"]).alias("text"))
    named = F.concat_ws("\n", F.octet_length("role").cast("string"), "role", "text")
    return rows.where("conv_id IS NOT NULL").withColumns({
        "id": F.unhex(F.md5(named)),
        "n_words": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
    })


def rebuilt_keys(turns: DataFrame, block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """Key and word counts of every conversation: conv_id, key, words (8 bytes a turn).

    The first h turns come from the conversation that starts the block (none if it is absent), the
    others are the conversation's own after its first h; h is the checksum of the id modulo ``shared``.
    With ``shared=1`` conversations are kept as they are. Rows of a block meet in one task.
    """
    first = F.col("conv_id") - F.col("conv_id") % block
    rows = turns.withColumns({
        "base": first, "later": first != F.col("conv_id"),
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared,
    })
    order = ["base", "later", "conv_id", F.col("turn").asc_nulls_first(), "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = base = None
        h, ids, counts = 0, [], []
        head_ids, head_counts = [], []
        done, size = [], 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([
                pa.array([d[0] for d in done], pa.int64()),
                pa.array([d[1] for d in done], pa.binary()),
                pa.array([d[2] for d in done], pa.binary())], ["conv_id", "key", "words"])
            done.clear()
            return out

        def close() -> int:
            nonlocal head_ids, head_counts
            if now == base:
                head_ids, head_counts = ids[:shared], counts[:shared]
            key = b"".join(head_ids[:h] + ids[h:])
            done.append((now, key, b"".join(
                n.to_bytes(8, "little") for n in head_counts[:h] + counts[h:])))
            return 2 * len(key)

        for b in batches:
            for to, conv, n_head, turn_id, n in zip(*(b.column(i).to_pylist() for i in range(5))):
                if conv != now:
                    if now is not None:
                        size += close()
                    if to != base:
                        head_ids, head_counts = [], []
                    now, base, h, ids, counts = conv, to, n_head, [], []
                ids.append(turn_id)
                counts.append(n)
            if size > GIVEN_BYTES:
                yield flush()
                size = 0
        if now is not None:
            close()
        if done:
            yield flush()

    return (rows.repartition("base").sortWithinPartitions(*order)
            .select("base", "conv_id", "h", "id", "n_words")
            .mapInArrow(run, "conv_id long, key binary, words binary"))


def distinct_keys(keys: DataFrame) -> DataFrame:
    """One row per distinct key: conv_id (least), n, key, words, ends_sha256.

    A digest of ids in order cannot be put together from parts, so the ids of one key are read by one
    task, as a stream.
    """
    marked = keys.select(F.unhex(F.md5("key")).alias("mark"), "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least, n, digest = None, 0, 0, None
        kinds = [pa.int64(), pa.int64(), pa.string()]

        def given(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                ["least", "n", "ends_sha256"])

        for b in batches:
            rows = []
            for mark, run_ in groupby(zip(b.column(0).to_pylist(), b.column(1).to_pylist()),
                                      key=lambda r: r[0]):
                ids = [r[1] for r in run_]
                if mark != now:
                    if now is not None:
                        rows.append((least, n, digest.hexdigest()))
                    now, least, n, digest = mark, ids[0], 0, hashlib.sha256()
                digest.update(("," * (n > 0) + ",".join(map(str, ids))).encode())
                n += len(ids)
            yield given(rows)
        if now is not None:
            yield given([(least, n, digest.hexdigest())])

    ends = (marked.repartition("mark").sortWithinPartitions("mark", "conv_id")
            .mapInArrow(run, "least long, n long, ends_sha256 string"))
    return keys.join(ends, keys["conv_id"] == ends["least"]).select(
        "conv_id", "n", "key", "words", "ends_sha256")


class Sorted:
    """Children of a node by their byte, in order: up to 4, then up to 16."""

    __slots__ = ("room", "marks", "children")

    def __init__(self, room: int = 4):
        self.room, self.marks, self.children = room, bytearray(), []

    def get(self, mark: int):
        at = self.marks.find(mark)
        return self.children[at] if at >= 0 else None

    def put(self, mark: int, child):
        """Sets a child; returns the layout that holds it, a larger one when this one is full."""
        at = self.marks.find(mark)
        if at >= 0:
            self.children[at] = child
            return self
        if len(self.marks) < self.room:
            at = sum(m < mark for m in self.marks)
            self.marks.insert(at, mark)
            self.children.insert(at, child)
            return self
        larger = Sorted(16) if self.room == 4 else Indexed()
        for m, c in zip(self.marks, self.children):
            larger.put(m, c)
        return larger.put(mark, child)

    def in_order(self) -> list:
        return self.children


class Indexed:
    """Up to 48 children, found by an index of 256 bytes."""

    __slots__ = ("index", "children")

    def __init__(self):
        self.index, self.children = bytearray(256), []

    def get(self, mark: int):
        at = self.index[mark]
        return self.children[at - 1] if at else None

    def put(self, mark: int, child):
        if self.index[mark]:
            self.children[self.index[mark] - 1] = child
        elif len(self.children) < 48:
            self.children.append(child)
            self.index[mark] = len(self.children)
        else:
            larger = Direct()
            for m, at in enumerate(self.index):
                if at:
                    larger.children[m] = self.children[at - 1]
            return larger.put(mark, child)
        return self

    def in_order(self) -> list:
        return [self.children[at - 1] for at in self.index if at]


class Direct:
    """A place for each of 256 bytes."""

    __slots__ = ("children",)

    def __init__(self):
        self.children = [None] * 256

    def get(self, mark: int):
        return self.children[mark]

    def put(self, mark: int, child):
        self.children[mark] = child
        return self

    def in_order(self) -> list:
        return [c for c in self.children if c is not None]


class Node:
    """All keys that agree in the first ``depth`` bytes of ``key``.

    The bytes between the parent's depth and this one are the compressed path. ``layout`` is none
    for a single key; ``row`` is what belongs to the key that ends here.
    """

    __slots__ = ("key", "depth", "layout", "row")

    def __init__(self, key: bytes, depth: int, row=None):
        self.key, self.depth, self.layout, self.row = key, depth, None, row

    def add(self, child: Node) -> None:
        self.layout = (self.layout or Sorted()).put(child.key[self.depth], child)


def agree(a: bytes, b: bytes, start: int, end: int) -> int:
    """Length up to which two keys agree, at most ``end``; they agree before ``start``."""
    end = min(end, len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    differ = int.from_bytes(a[start:end], "big") ^ int.from_bytes(b[start:end], "big")
    return end - (differ.bit_length() + 7) // 8


class RadixTree:
    """Adaptive radix tree; keys may be prefixes of each other."""

    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, row) -> None:
        """Adds a key with what belongs to it; an equal key is replaced."""
        above, node, depth = None, self.root, 0
        while node is not None:
            same = agree(node.key, key, depth, node.depth)
            if same < node.depth:  # the path branches, or the key ends inside it
                fork = Node(key, same)
                fork.add(node)
                if same == len(key):
                    fork.row = row
                else:
                    fork.add(Node(key, len(key), row))
                self._hang(above, fork)
                return
            if len(key) == node.depth:
                node.row = row
                return
            above, depth = node, node.depth
            node = node.layout.get(key[depth]) if node.layout else None
        self._hang(above, Node(key, len(key), row))

    def _hang(self, above: Node | None, node: Node) -> None:
        if above is None:
            self.root = node
        else:
            above.add(node)


class TurnNodes:
    """Nodes at the ends of turns of a tree, with sums over their subtrees.

    Rows of the tree are (conv_id, n, words, ends). ``first`` and ``last`` are the range's outer keys:
    their prefixes may lie in other ranges too. Lists by node: conv (least id), depth (turns), n, children,
    leaves, spent (turns' words of all conversations), own (words of distinct turns), ends, parent
    (place in the lists, or none), outer (its key where it may lie in other ranges, or none).
    """

    def __init__(self, tree: RadixTree, first: bytes, last: bytes):
        (self.conv, self.depth, self.n, self.children, self.leaves, self.spent, self.own,
         self.ends, self.parent, self.outer) = ([] for _ in range(10))
        # each part of the tree: node, place of the part above, its depth, length shared with an
        # outer key
        order = [(tree.root, -1, -1, self._shared(tree.root, 0, first, last))]
        walk = [0]
        while walk:
            at = walk.pop()
            node, _, _, shared = order[at]
            for child in node.layout.in_order() if node.layout else ():
                order.append((child, at, node.depth, self._shared(child, node.depth, first, last)
                              if shared >= node.depth else -1))
                walk.append(len(order) - 1)
        sums = [[0, None, 0, 0, 0, [], None] for _ in order]
        # a part comes after the one above it, so backwards all that lies below is summed
        for at in range(len(order) - 1, -1, -1):
            node, above, start, shared = order[at]
            n, conv, leaves, spent, own, tops, words = sums[at]
            sums[at] = None
            if node.row is not None:
                n += node.row[1]
                conv = node.row[0] if conv is None else min(conv, node.row[0])
                words = memoryview(node.row[2]).cast("q")
            for turns in range(node.depth // WIDTH, start // WIDTH if start >= 0 else -1, -1):
                w = words[turns - 1] if turns else 0
                spent, own = spent + n * w, own + w
                place = len(self.conv)
                for below in tops:
                    self.parent[below] = place
                if not tops:
                    leaves = 1
                self.conv.append(conv)
                self.depth.append(turns)
                self.n.append(n)
                self.children.append(len(tops))
                self.leaves.append(leaves)
                self.spent.append(spent)
                self.own.append(own)
                ended = node.row is not None and turns * WIDTH == node.depth
                self.ends.append(node.row[3] if ended else None)
                self.parent.append(None)
                self.outer.append(node.key[:turns * WIDTH] if turns * WIDTH <= shared else None)
                tops = [place]
            if above >= 0:
                up = sums[above]
                up[0] += n
                up[1] = conv if up[1] is None else min(up[1], conv)
                up[2] += leaves
                up[3] += spent
                up[4] += own
                up[5] += tops
                up[6] = words

    @staticmethod
    def _shared(node: Node, start: int, first: bytes, last: bytes) -> int:
        """How long the prefix is that all keys of a node share with one of the outer keys."""
        return max(agree(node.key, outer, 0, node.depth) for outer in (first, last))


_OUT = ("kind string, node binary, parent binary, conv_id long, depth long, parent_conv_id long, "
        "n_convs long, n_children long, n_leaves long, spent long, own long, ends string, part int, "
        "first binary, last binary, words binary")
_KINDS = [pa.string(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string(), pa.int32(),
          *[pa.binary()] * 3]
_NAMES = [field.split()[0] for field in _OUT.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)], _NAMES)


def _mark(prefix: bytes) -> bytes:
    return hashlib.md5(prefix).digest()


def _range_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a sorted range of keys: whole ones, parts of outer ones, and the range's outer keys."""
    tree, first, last, last_words = RadixTree(), None, b"", b""
    for b in batches:
        for conv, n, key, words, ends in zip(*(b.column(i).to_pylist() for i in range(5))):
            tree.insert(key, (conv, n, words, ends))
            first = key if first is None else first
            last, last_words = key, words
    if first is None:
        return
    t = TurnNodes(tree, first, last)
    rows = [("range", *[None] * 11, TaskContext.get().partitionId(), first, last, last_words)]
    for i, parent in enumerate(t.parent):
        outer = t.outer[i] is not None
        up = t.outer[parent] if parent is not None else None
        rows.append((
            "part" if outer else "node", _mark(t.outer[i]) if outer else None,
            _mark(up) if up is not None else None, t.conv[i], t.depth[i],
            t.conv[parent] if parent is not None and up is None else None, t.n[i], t.children[i],
            t.leaves[i], t.spent[i], t.own[i], t.ends[i], None, None, None, None))
        if len(rows) >= GIVEN_ROWS:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def _counted_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is to be taken off the sums, from the outer keys of neighbouring ranges."""
    for b in batches:
        for last, words, following in zip(*(b.column(i).to_pylist() for i in range(3))):
            shared = agree(last, following, 0, len(last)) // WIDTH
            counts = memoryview(words).cast("q")
            inside = shared * WIDTH == len(last)  # the last key goes on in the next range
            rows, own = [], 0
            for turns in range(shared, -1, -1):
                own += counts[turns - 1] if turns else 0
                rows.append(("part", _mark(last[:turns * WIDTH]), None, None, None, None, 0,
                             -1 if turns < shared else 0, -1 if inside else 0, 0, -own,
                             *[None] * 5))
            yield _batch(rows)


def prefix_nodes(keys: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All nodes of the prefix trie of ``keys`` (conv_id, key, words; one row a conversation).

    Columns: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.
    """
    once = staged(distinct_keys(staged(keys, "conversation-keys")), "distinct-keys")
    size = once.agg(F.sum(F.octet_length("key") + KEY_BYTES)).first()[0] or 0
    found = staged(
        once.repartitionByRange(max(1, -(-size // range_bytes)), "key").sortWithinPartitions("key")
        .select("conv_id", "n", "key", "words", "ends_sha256").mapInArrow(_range_nodes, _OUT),
        "trie-nodes")
    following = F.lead("first").over(Window.orderBy("part"))  # one row a range
    twice = (found.where("kind = 'range'").select("last", "words", following.alias("following"))
             .where("following IS NOT NULL").mapInArrow(_counted_twice, _OUT))
    sums = ["n_convs", "n_children", "n_leaves", "spent", "own"]
    outer = staged(
        found.where("kind = 'part'").unionByName(twice).groupBy("node").agg(
            F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"),
            F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in sums],
            F.max("ends").alias("ends")), "outer-nodes")
    columns = ["conv_id", "depth", *sums, "ends"]
    whole = found.where("kind = 'node'")
    salt = F.pmod(F.hash("conv_id", "depth"), F.lit(SALTS))
    waiting = whole.where("parent IS NOT NULL").select("parent", *columns).unionByName(
        outer.select("parent", *columns)).withColumn("salt", salt)
    above = outer.select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    linked = waiting.join(above, ["parent", "salt"], "left").select("parent_conv_id", *columns)
    return whole.where("parent IS NULL").select("parent_conv_id", *columns).unionByName(
        linked).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("spent") - F.col("own")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all conversations, rebuilt with the first turns of their block."""
    return prefix_nodes(rebuilt_keys(turn_rows(table(spark, sf_dir, "conversations"))))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {
    "op13_prefix_trie": r"""
WITH crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''),
      lambda x: ascii(x)::BIGINT),
    lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM turns) CROSS JOIN crc_table
), rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, place) AS d, role, text
  FROM (
    SELECT c, 0 AS own, place, role, text FROM convs JOIN turns ON conv_id = c - c % 20 AND place <= h
    UNION ALL
    SELECT c, 1, place, role, text FROM convs JOIN turns ON conv_id = c AND place > h)
), paths AS (
  SELECT c, d, string_agg(md5(length(role) || ':' || role || text), '/') OVER (
      PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS node,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
    d = max(d) OVER (PARTITION BY c) AS ends
  FROM rebuilt
  UNION ALL
  SELECT c, 0, '', 0, c NOT IN (SELECT c FROM rebuilt) FROM convs
), nodes AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, min(w) AS w,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY node, d
), linked AS (
  SELECT n.node, n.d, n.conv_id, n.n_convs, n.w, n.ends_sha256, u.node AS up, u.conv_id AS up_conv
  FROM nodes n LEFT JOIN paths p ON p.c = n.conv_id AND p.d = n.d - 1
  LEFT JOIN nodes u ON u.node = p.node AND u.d = p.d
), children AS (
  SELECT up AS node, count(*) AS n_children FROM linked WHERE up IS NOT NULL GROUP BY up
), below AS (
  SELECT p.node, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves,
    sum((n.n_convs - 1) * n.w) AS saved_tokens
  FROM nodes n JOIN paths p ON p.c = n.conv_id AND p.d <= n.d
  LEFT JOIN children k ON k.node = n.node
  GROUP BY p.node
)
SELECT l.conv_id, l.d::BIGINT AS depth, l.up_conv AS parent_conv_id, l.n_convs::BIGINT AS n_convs,
  coalesce(k.n_children, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
  b.saved_tokens::BIGINT AS saved_tokens, l.ends_sha256
FROM linked l JOIN below b ON b.node = l.node LEFT JOIN children k ON k.node = l.node
""",
}
