"""Prefix trie of conversations: which beginnings are shared, by how many, and what computing each only once would save.

1. A conversation becomes one row: 16-byte digests of its turns, joined to one key, and the size of each text. Texts don't travel.
2. Rows are range-partitioned and sorted by (key, conv_id), so the members of every node are neighbours, equal conversations by id.
3. In each partition the longest common prefix (LCP) of neighbours gives an edge per pair. A union-find takes the edges in descending
   depth; components are runs of rows, and every merge is a branching node, at the depth of the edge. On its way up to the merge a
   component passes the nodes with one child.
4. A node that reaches neither end of its partition is finished. The others lie on the paths of the first and of the last row: the
   partition is contracted to these two rows, each with what hangs on every node of its path. Up to ``FAN`` neighbouring partitions are
   merged by the same union-find over their contracted rows, level by level, until one is left. A group of copies over many partitions
   meets again as two rows from each.
5. Ids of the conversations that end in a node are hashed where they lie; for unfinished nodes in runs of ``RUN`` ids, streamed in order.

``prefix_trie(lists)`` takes (conv_id, turns: array of (digest, size)) and returns one row per node: conv_id (smallest member), depth,
parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and turn_digest (of its last turn, null for the root).

Defined results: null roles and texts are empty; rows without a conv_id are no conversation; turns of one number (and null, which comes
first) are ordered by their digests, repeated rows are turns of their own; a conversation without turns ends in the root; an empty table
gives no nodes, not even a root; other columns are ignored. The digests of one conversation fit in a task (16 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from relyard.llm.common import stored

#: Neighbouring partitions merged in one task, and ids hashed or stored as one text.
FAN, RUN = 64, 65_536
#: Conversations of one family share the beginning of its first one in ``spliced``; the longest beginning is under SPLICE turns.
FAMILY, SPLICE = 5, 9

WIDTH = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
LIST = "array<struct<digest:binary,size:bigint>>"

_SLOT = pa.struct([("depth", pa.int32()), ("node_key", pa.binary())] + [(c, pa.int64()) for c in ("n", "low", "kids", "leaves", "saved")])
_NODE = pa.struct(
    [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.binary())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("turn_digest", pa.binary()), ("node_key", pa.binary())]
)
_PATH = pa.struct([("place", pa.int32()), ("key", pa.binary()), ("sizes", pa.list_(pa.int64())), ("slots", pa.list_(_SLOT))])
_ENDS = pa.struct([("node_key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_OUT = pa.schema([("seg", pa.int32()), ("node", _NODE), ("path", _PATH), ("ends", _ENDS)])
_SLOT_SQL = "struct<depth:int,node_key:binary,n:bigint,low:bigint,kids:bigint,leaves:bigint,saved:bigint>"
_OUT_SQL = (
    "seg int, node struct<conv_id:bigint,depth:bigint,parent_conv_id:bigint,parent_key:binary,n_convs:bigint,n_children:bigint,n_leaves:bigint,"
    "saved_tokens:bigint,ends_sha256:string,turn_digest:binary,node_key:binary>, "
    f"path struct<place:int,key:binary,sizes:array<bigint>,slots:array<{_SLOT_SQL}>>, ends struct<node_key:binary,first:bigint,ids:string>"
)
NODE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_lists(conversations: DataFrame, by=None) -> DataFrame:
    """(conv_id, turns) with turns in order; ``by``, a function of the conv_id column, names families that are kept together."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))
    conv_id = conversations["conv_id"].cast("bigint")
    family = by(conv_id) if by else conv_id
    turns = conversations.where(conv_id.isNotNull()).select(
        family.alias("family"), conv_id.alias("conv_id"), F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("bigint").alias("size")).alias("turn")
    )
    in_order = F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    return turns.repartition("family").groupBy("family", "conv_id").agg(in_order.alias("turns"))


def spliced(conversations: DataFrame) -> DataFrame:
    """Every conversation with the first h turns of its family's first one in place of its own; h is a hash of its id.

    The family is conv_id - conv_id % FAMILY; its few members meet by one shuffle.
    """
    lists = turn_lists(conversations, lambda conv_id: conv_id - conv_id % FAMILY)
    none = F.array().cast(LIST)
    families = lists.groupBy("family").agg(
        F.max(F.when(F.col("conv_id") == F.col("family"), F.col("turns"))).alias("head"), F.collect_list(F.struct("conv_id", "turns")).alias("members")
    )
    members = families.select("head", F.inline("members"))
    h = (F.crc32(F.col("conv_id").cast("string")) % SPLICE).cast("int")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return members.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), rest).alias("turns"))


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    low, high = 0, n - 1  # the first `low` turns agree, the first `high` + 1 don't
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


def node_keys(key: bytes) -> list[bytes]:
    """A name for every node on the path of a key, from the root down."""
    state, names = hashlib.sha256(), []
    for depth in range(len(key) // WIDTH + 1):
        state.update(key[(depth - 1) * WIDTH : depth * WIDTH] if depth else b"")
        names.append(state.digest()[:WIDTH])
    return names


class _Run:
    """A component: neighbouring rows lo to hi, with the node at ``depth`` above them still open to further rows."""

    __slots__ = ("lo", "hi", "depth", "slots", "total", "waiting")

    def __init__(self, row: int, depth: int, slots: dict):
        self.lo = self.hi = row
        self.depth, self.slots = depth, slots
        self.total, self.waiting = None, []  # of what is below ``depth`` and finished; those finished nodes that lack their parent


def _add(a, b):
    """Sums of two parts of a node (n, low, kids, leaves, saved); low is the smallest id."""
    if a is None or b is None:
        return a or b
    return a[0] + b[0], min(a[1], b[1]), a[2] + b[2], a[3] + b[3], a[4] + b[4]


def grow(keys, sizes, slots, whole: bool):
    """Union-find over sorted rows. ``slots[i]``: depth -> what hangs on that node of row i's path (n, low, kids, leaves, saved).

    Returns (nodes, paths, opened). Nodes are [low, depth, parent low, parent place, n, kids, leaves, saved, row]; a node whose parent is
    unfinished has that parent's place (path, depth) instead. Paths are the slots of the first and the last row; ``opened`` lists
    (place, row) of unfinished nodes. With ``whole`` nothing lies outside these rows and every node is finished.
    """
    m = len(keys)
    nodes, paths, opened = [], ({}, {}), []
    edges = [common_turns(keys[i], keys[i + 1]) for i in range(m - 1)]
    of = list(range(m))
    runs = [_Run(i, len(keys[i]) // WIDTH, slots[i]) for i in range(m)]

    def find(i):
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    def lift(run: _Run, depth: int) -> None:
        """Finish the nodes of a run that lie deeper than ``depth``."""
        while run.depth > depth:
            x = run.depth
            total = _add(run.total, run.slots.pop(x, None))
            if not whole and (run.lo == 0 or run.hi == m - 1):
                place = (0 if run.lo == 0 else 1, x)
                if total is not None:
                    paths[place[0]][x] = total
                opened.append((place, run.lo))
                for k in run.waiting:
                    nodes[k][3] = place
                run.total, run.waiting = None, []
            else:
                n, low, kids, leaves, saved = total
                leaves = leaves if kids else 1
                saved += (n - 1) * int(sizes[run.lo][x - 1]) if x else 0
                for k in run.waiting:
                    nodes[k][2] = low
                run.waiting = [len(nodes)]
                nodes.append([low, x, None, None, n, kids, leaves, saved, run.lo])
                run.total = n, low, 1, leaves, saved
            run.depth = x - 1

    for i in sorted(range(m - 1), key=edges.__getitem__, reverse=True):
        left, right = find(i), find(i + 1)
        a, b = runs[left], runs[right]
        lift(a, edges[i])
        lift(b, edges[i])
        small, large = sorted((a.slots, b.slots), key=len)
        for depth, part in small.items():
            large[depth] = _add(large.get(depth), part)
        a.hi, a.slots, a.total = b.hi, large, _add(a.total, b.total)
        few, many = sorted((a.waiting, b.waiting), key=len)
        many.extend(few)
        a.waiting = many
        of[right], runs[right] = left, None
    if m:
        lift(runs[find(0)], -1)
    return nodes, paths, opened


def _ends_text(ids) -> str:
    return ",".join(map(str, ids))


def _table(seg: int, nodes=(), paths=(), ends=()) -> Iterator[pa.RecordBatch]:
    """Record batches of one kind of output after the other."""
    for column, kind, rows in (("node", _NODE, nodes), ("path", _PATH, paths), ("ends", _ENDS, ends)):
        for at in range(0, len(rows), 20_000):
            part = rows[at : at + 20_000]
            columns = [pa.array([seg] * len(part), pa.int32())]
            columns += [pa.array(part, kind) if f.name == column else pa.nulls(len(part), f.type) for f in list(_OUT)[1:]]
            yield pa.RecordBatch.from_arrays(columns, schema=_OUT)


def _path_rows(keys, sizes, paths) -> list[dict]:
    """The two contracted rows of a segment."""
    rows = []
    for place, row in ((0, 0), (1, len(keys) - 1)):
        names = node_keys(keys[row])
        slots = [dict(zip(("depth", "node_key", "n", "low", "kids", "leaves", "saved"), (x, names[x], *part))) for x, part in sorted(paths[place].items())]
        rows.append({"place": place, "key": keys[row], "sizes": [int(s) for s in sizes[row]], "slots": slots})
    return rows


def _node_rows(nodes, keys, names_of_path, ends_of=None, names_of_row=None) -> list[tuple]:
    rows = []
    for low, depth, parent_low, parent_place, n, kids, leaves, saved, row in nodes:
        parent_key = names_of_path[parent_place[0]][parent_place[1]] if parent_place is not None else None
        digest = keys[row][(depth - 1) * WIDTH : depth * WIDTH] if depth else None
        rows.append(
            (low, depth, parent_low, parent_key, n, kids, leaves, saved, ends_of(row, depth) if ends_of else None, digest, names_of_row(row, depth) if names_of_row else None)
        )
    return [dict(zip([f.name for f in _NODE], row)) for row in rows]


def _partition_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, key, sizes) of one partition to finished nodes, its two contracted rows, and ids that end in unfinished nodes."""
    ids, keys, sizes = [], [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        keys += batch.column(1).to_pylist()
        values, offsets = batch.column(2).flatten().to_numpy(), batch.column(2).offsets.to_numpy()
        start = offsets[0] if len(offsets) else 0
        sizes += [values[a - start : b - start] for a, b in zip(offsets, offsets[1:])]
    if not ids:
        return
    m = len(ids)

    def ending(row: int, depth: int) -> range:
        """Rows that end in the node: they come first among its members."""
        end = row
        while end < m and len(keys[end]) == depth * WIDTH and keys[end] == keys[row]:
            end += 1
        return range(row, end)

    def ends_of(row: int, depth: int) -> str:
        rows = ending(row, depth)
        return hashlib.sha256(_ends_text(ids[rows.start : rows.stop]).encode()).hexdigest() if rows else NO_ENDS

    nodes, paths, opened = grow(keys, sizes, [{len(k) // WIDTH: (1, i, 0, 0, 0)} for i, k in zip(ids, keys)], whole=False)
    names = node_keys(keys[0]), node_keys(keys[-1])
    ends = []
    for (path, depth), row in opened:
        rows = ending(row, depth)
        for at in range(rows.start, rows.stop, RUN):
            ends.append({"node_key": names[path][depth], "first": ids[at], "ids": _ends_text(ids[at : min(at + RUN, rows.stop)])})
    yield from _table(TaskContext.get().partitionId(), _node_rows(nodes, keys, names, ends_of), _path_rows(keys, sizes, paths), ends)


def _merge_segments(whole: bool):
    """Contracted rows of neighbouring segments to the nodes that are finished among them, and the contracted rows of their union."""

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["seg"], r["path"]["place"]))
        keys, sizes = [r["path"]["key"] for r in rows], [r["path"]["sizes"] for r in rows]
        slots = [{s["depth"]: tuple(s[c] for c in ("n", "low", "kids", "leaves", "saved")) for s in r["path"]["slots"]} for r in rows]
        nodes, paths, _ = grow(keys, sizes, slots, whole)
        names = [node_keys(k) for k in keys]
        out = _node_rows(nodes, keys, (names[0], names[-1]), None, lambda row, depth: names[row][depth])
        batches = _table(key[0].as_py(), out, () if whole else _path_rows(keys, sizes, paths))
        return pa.Table.from_batches(list(batches), schema=_OUT)

    return merge


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its runs of ids, streamed in order: a task holds one run at a time."""
    now, state = None, None

    def done():
        return pa.RecordBatch.from_pydict({"node_key": pa.array([now], pa.binary()), "sha": pa.array([state.hexdigest()])})

    for batch in batches:
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != now:
                if now is not None:
                    yield done()
                now, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if now is not None:
        yield done()


def prefix_trie(lists: DataFrame, fan: int = FAN) -> DataFrame:
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    rows = stored(lists.select(F.col("conv_id").cast("bigint").alias("conv_id"), key.alias("key"), F.col("turns.size").alias("sizes")), "trie-rows")
    in_order = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select("conv_id", "key", "sizes")
    first = stored(in_order.mapInArrow(_partition_forest, _OUT_SQL), "trie-forests")

    segments, above = first, None
    n = (first.where("path is not null").agg(F.max("seg")).first()[0] or 0) + 1
    while True:
        level = segments.where("path is not null").select("seg", "path")
        grouped = level.groupBy(F.floor(F.col("seg") / fan).cast("int").alias("group"))
        segments = stored(grouped.applyInArrow(_merge_segments(n <= fan), _OUT_SQL), "trie-forests")
        finished = segments.where("node is not null").select("node.*")
        above = finished if above is None else above.union(finished)
        if n <= fan:
            break
        n = -(-n // fan)

    runs = first.where("ends is not null").select("ends.*")
    digests = runs.repartition("node_key").sortWithinPartitions("node_key", "first").select("node_key", "ids").mapInArrow(_hashed_ends, "node_key binary, sha string")
    lows = above.select(F.col("node_key").alias("name"), F.col("conv_id").alias("low"))
    finished = above.join(digests, "node_key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS)))
    finished = finished.join(lows, finished["parent_key"] == lows["name"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "low"))

    # Nodes finished in a partition below an unfinished one: the parent is found by (partition, name), so a root's many children don't meet.
    own = first.where("node is not null").select("seg", "node.*")
    known = own.where("parent_key is null")
    slots = first.where("path is not null").select(F.col("seg").alias("of_seg"), F.explode("path.slots").alias("slot"))
    named = slots.select("of_seg", F.col("slot.node_key").alias("of_node")).join(lows, F.col("of_node") == lows["name"])
    open_parent = own.where("parent_key is not null").join(named, (own["seg"] == named["of_seg"]) & (own["parent_key"] == named["of_node"]))
    open_parent = open_parent.withColumn("parent_conv_id", F.col("low"))
    columns = [*NODE_COLUMNS, F.lower(F.hex("turn_digest")).alias("turn_digest")]
    return known.select(columns).union(open_parent.select(columns)).union(finished.select(columns))


def oracle() -> str:
    """The trie of the spliced conversations by prefixes as keys; crc32 is written out bit by bit."""
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
lists AS (
  SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST) AS turns FROM turns GROUP BY conv_id),
hashed AS (
  SELECT conv_id, turns, conv_id - conv_id % {FAMILY} AS family,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % {SPLICE} AS h
  FROM lists),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM hashed a LEFT JOIN lists b ON b.conv_id = a.family),
prefixes AS (
  SELECT conv_id, d AS depth, len(turns) AS n_turns, sha256(turns[1:d]::JSON::VARCHAR) AS node,
    CASE WHEN d > 0 THEN sha256(turns[1:d - 1]::JSON::VARCHAR) END AS parent, CASE WHEN d > 0 THEN octet_length(encode(turns[d].t)) ELSE 0 END AS bytes
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n_turns = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth),
children AS (SELECT parent, count(*) AS n FROM nodes GROUP BY parent),
below AS (
  SELECT p.node, p.depth, sum(n.saved) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN children c ON c.parent = n.node
  GROUP BY p.node, p.depth)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node AND b.depth = n.depth LEFT JOIN children c ON c.parent = n.node LEFT JOIN nodes p ON p.node = n.parent
"""
