import hashlib
import random
import zlib

import duckdb
import pytest
from compare import connect, difference
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.llm import prefix_trie
from holdfast.llm.prefix_trie import WIDTH, Direct, Indexed, RadixTree, Sorted, TurnNodes

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
         "saved_tokens", "ends_sha256"]


def brute_force(rows):
    """Nodes from rows (conv_id, turn, role, text), by all prefixes of all conversations."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])
        rebuilt[c] = tuple(base[:h] + turns[h:])
    members, ends = {}, {}
    for c, turns in rebuilt.items():
        ends.setdefault(turns, []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len("".join(" " if x in " \t\n\x0b\x0c\r" else x for x in path[-1][1]).split(" ")) - \
            sum(not w for w in "".join(" " if x in " \t\n\x0b\x0c\r" else x for x in path[-1][1])
                .split(" ")) if path else 0
        below = children.get(path, [])
        leaves[path] = sum(leaves[p] for p in below) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[p] for p in below)
    return sorted((
        min(m), len(path), min(members[path[:-1]]) if path else None, len(m),
        len(children.get(path, [])), leaves[path], saved[path],
        hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest())
        for path, m in members.items())


def rows_of(frame):
    assert frame.columns == NAMES
    return sorted(tuple(r) for r in frame.collect())


SCHEMA = "conv_id long, turn long, role string, text string"


def write(spark, rows, folder, more=()):
    schema = SCHEMA + "".join(f", `{c}` string" for c in more)
    spark.createDataFrame([(*r, *["x"] * len(more)) for r in rows], schema).repartition(3) \
        .write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def drawn(seed, n=400):
    """Conversations with shared starts, copies, and odd rows."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 2000), n):
        if rng.random() < 0.3:  # the very same conversation
            rows += [(c, t, "user", f"hot text {t}") for t in range(4)]
            continue
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]),
                         rng.choice(["a", "a b", "", None, " \n x y\tz ", "b", "long " * 50])))
    rows += [(5000, None, "user", "no turn"), (5000, None, "user", "no turn"), (5000, 0, None, "y"),
             (5001, 3, "b", "tie"), (5001, 3, "a", "tie"), (None, 1, "user", "lost"),
             (None, None, None, None), (5020, 0, "", ""), (5021, 0, "user\n", "a"),
             (5022, 0, "user", "\na")]
    rows += [(6000, t, "user", f"turn {t}") for t in range(1200)]
    return rows


@pytest.mark.parametrize("range_bytes", [prefix_trie.RANGE_BYTES, 3000])
def test_all_nodes(spark, tmp_path, monkeypatch, range_bytes):
    rows = drawn(range_bytes)
    folder = write(spark, rows, tmp_path, ["node", "depth", "kind", "n", "key", "words", "salt"])
    keys = prefix_trie.rebuilt_keys(prefix_trie.turn_rows(
        spark.read.parquet(f"{folder}/conversations.parquet")))
    assert rows_of(prefix_trie.prefix_nodes(keys, range_bytes)) == brute_force(rows)


def test_one_range_for_each_key(spark):
    """Every node may lie in several ranges then."""
    rows = [(20 * i, t, "user", "same" if t < 2 + i % 3 else f"{i % 5}")
            for i in range(60) for t in range(1 + i % 6)]
    keys = prefix_trie.rebuilt_keys(prefix_trie.turn_rows(spark.createDataFrame(rows, SCHEMA)))
    assert rows_of(prefix_trie.prefix_nodes(keys, 1)) == brute_force(rows)


def test_conversations_as_they_are(spark):
    rows = [(c, t, "user", "hello") for c in (1, 2) for t in range(c)]
    keys = prefix_trie.rebuilt_keys(prefix_trie.turn_rows(spark.createDataFrame(rows, SCHEMA)),
                                    shared=1)
    found = rows_of(prefix_trie.prefix_nodes(keys))
    assert [r[:7] for r in found] == [
        (1, 0, None, 2, 1, 1, 1), (1, 1, 1, 2, 1, 1, 1), (2, 2, 1, 1, 0, 1, 0)]


def test_registered_query_equals_sql(spark, sf):
    con = connect(sf)
    assert difference(prefix_trie.op13_prefix_trie(spark, sf), con,
                      prefix_trie.ORACLES["op13_prefix_trie"]) is None


def test_sql_on_odd_rows():
    rows = [r for r in drawn(8, 60) if r[0] != 6000]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role TEXT, text TEXT)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute("SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, "
                      f"saved_tokens, ends_sha256 FROM ({prefix_trie.ORACLES['op13_prefix_trie']})")
    assert sorted(got.fetchall()) == brute_force(rows)


def test_no_rows(spark, no_rows):
    assert prefix_trie.op13_prefix_trie(spark, no_rows).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.sets(st.lists(st.integers(0, 3), max_size=5).map(tuple), min_size=1))
def test_tree_of_any_keys(paths):
    """Ids that differ in their first, middle or last byte only."""
    ids = [bytes(16), b"\x01" + bytes(15), bytes(7) + b"\x05" + bytes(8), bytes(15) + b"\xff"]
    keys = {b"".join(ids[t] for t in p): p for p in paths}
    tree = RadixTree()
    for i, (key, p) in enumerate(sorted(keys.items())):
        tree.insert(key, (i, 1, b"".join((t + 1).to_bytes(8, "little") for t in p), "e"))
    t = TurnNodes(tree, min(keys), max(keys))
    prefixes = {p[:d] for p in paths for d in range(len(p) + 1)}
    assert len(t.conv) == len(prefixes)
    assert sorted(t.n) == sorted(sum(q[:len(p)] == p for q in paths) for p in prefixes)
    assert sorted(t.own) == sorted(sum(q[-1] + 1 for q in prefixes if q and q[:len(p)] == p)
                                   for p in prefixes)
    assert sum(e is not None for e in t.ends) == len(paths)
    assert sorted(t.children) == sorted(
        sum(len(q) == len(p) + 1 and q[:-1] == p for q in prefixes) for p in prefixes)


def test_layouts_grow():
    sizes = {4: Sorted, 5: Sorted, 16: Sorted, 17: Indexed, 48: Indexed, 49: Direct, 256: Direct}
    rng = random.Random(1)
    marks = rng.sample(range(256), 256)
    layout = Sorted()
    for i, mark in enumerate(marks, 1):
        layout = layout.put(mark, mark)
        assert layout.in_order() == sorted(marks[:i])
        if i in sizes:
            assert type(layout) is sizes[i]
        assert layout.get(mark) == mark and (i == 256 or layout.get(marks[i]) is None)
    assert WIDTH % 8 == 0
