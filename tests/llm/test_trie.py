"""The prefix trie against a brute-force trie of nested dictionaries."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from relyard.llm import prefix_trie
from relyard.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute_nodes(rebuilt):
    """conv_id -> list of (role, text), to {(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends)}."""
    members = {}
    for conv_id, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv_id)
    rows = set()
    for prefix, convs in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(prefix))
        children = sum(len(q) == len(prefix) + 1 for q in below)
        parent = min(members[prefix[:-1]]) if prefix else None
        rows.add((min(convs), len(prefix), parent, len(convs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    assert len(rows) == len(members)
    return rows


def brute_lists(rows):
    lists = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            lists.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in lists.items()}


def brute_spliced(lists):
    out = {}
    for c, turns in lists.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = lists.get(c - c % 5, [])[:h] + turns[h:]
    return out


def nodes_of(df):
    rows = df.select(prefix_trie.NODE_COLUMNS).collect()
    assert len(set(rows)) == len(rows)
    return set(map(tuple, rows))


def random_rows(seed, n):
    rnd = random.Random(seed)
    words = ["", "a", "b", "ä", "long " * 20]
    rows = []
    for c in range(n):
        if rnd.random() < 0.9:
            rows += [(c, t if rnd.random() < 0.95 or t else None, rnd.choice(["user", "user", None]), rnd.choice(words[: 2 + c % 4])) for t in range(rnd.randint(1, 12))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions, fan", [(1, 64), (7, 64), (23, 2)])
def test_spliced_trie(spark, partitions, fan):
    """Partitions end inside hot nodes, and contracted forests are merged over several levels."""
    rows = random_rows(partitions, 150) + [(c, t, "user", f"hot {t}") for c in range(1000, 1150) for t in range(3)]
    convs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "turn as depth", "text as key", "1 as seg")
    set_before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert nodes_of(prefix_trie.prefix_trie(prefix_trie.spliced(convs), fan)) == brute_nodes(brute_spliced(brute_lists(rows)))
        if partitions > 1:
            assert nodes_of(prefix_trie.prefix_trie(prefix_trie.turn_lists(convs), fan)) == brute_nodes(brute_lists(rows))
    finally:
        for k, v in set_before.items():
            spark.conf.set(k, v)


def test_awkward_conversations(spark, monkeypatch):
    """Null ids, turns, roles and texts; repeated rows; a conversation whose splice leaves nothing; a very long one."""
    alone = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(None, 0, "user", "no id"), (alone, 0, "user", "x"), (500, 1, "user", "b"), (500, None, None, "a"), (505, None, "", "a"), (505, 1, "user", "b")]
    rows += [(510, 0, "user", "x"), (510, 0, "user", "x"), (515, 3, "", None), (515, 2, None, ""), (-5, 0, "user", "x")]
    rows += [(520, t, "user", "y" * (t % 7)) for t in range(400)] + [(525, t, "user", "y" * (t % 7)) for t in range(300)]
    monkeypatch.setattr(prefix_trie, "RUN", 1)
    got = nodes_of(prefix_trie.prefix_trie(prefix_trie.spliced(spark.createDataFrame(rows, SCHEMA))))
    want = brute_spliced(brute_lists(rows))
    assert want[alone] == [] and got == brute_nodes(want)


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(prefix_trie.spliced(spark.createDataFrame([], SCHEMA))).collect() == []


def test_turn_digest_names_the_last_turn(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi")]
    got = {r.depth: r.turn_digest for r in prefix_trie.prefix_trie(prefix_trie.turn_lists(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {0: None, 1: hashlib.sha256(b"4:userhi").hexdigest()[:32], 2: hashlib.sha256(b"3:botyo").hexdigest()[:32]}


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=5), min_size=1, max_size=30), st.data())
@settings(max_examples=300, deadline=None)
def test_union_find_over_any_cut(lists, data):
    """Sorted rows cut anywhere: what the pieces finish and what their contracted rows finish together is the whole trie."""
    keys = sorted(b"".join(x.encode() * prefix_trie.WIDTH for x in chars) for chars in lists)
    sizes = [[1] * (len(k) // prefix_trie.WIDTH) for k in keys]
    slots = lambda: [{len(k) // prefix_trie.WIDTH: (1, i, 0, 0, 0)} for i, k in enumerate(keys)]
    whole, _, _ = prefix_trie.grow(keys, sizes, slots(), True)
    cuts = sorted(data.draw(st.lists(st.integers(0, len(keys)), max_size=5)))
    nodes, rows = [], []
    for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
        if lo < hi:
            part, paths, _ = prefix_trie.grow(keys[lo:hi], sizes[lo:hi], slots()[lo:hi], False)
            nodes += part
            rows += [(keys[lo], dict(paths[0])), (keys[hi - 1], dict(paths[1]))]
    top, _, _ = prefix_trie.grow([k for k, _ in rows], [[1] * (len(k) // prefix_trie.WIDTH) for k, _ in rows], [s for _, s in rows], True)
    pick = lambda ns: sorted((n[0], n[1], *n[4:8]) for n in ns)
    assert pick(nodes + top) == pick(whole)


def test_query_runs_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes_of(QUERIES["op12_prefix_trie"].build(spark, sf)) == brute_nodes(brute_spliced(brute_lists(rows)))
