"""SimHash near-duplicates: 64-bit fingerprints, links within a Hamming radius found by BK-trees, components.

Distinct fingerprints are the nodes; exact copies and equal fingerprints collapse before any search.

Shards: two fingerprints that differ in at most r = 3 bits agree in at least one of r + 1 blocks of bits. Each fingerprint goes to
one shard per block (the shard holds those with the same value there), each shard becomes a BK-tree, and its members search it with
radius r. No tree is broadcast: together they grow with the corpus, so the shuffle brings each shard to one task.
A shard over ``SHARD`` members is divided once more by the same argument on the bits not yet fixed, level by level; after four levels at
least 43 bits are fixed, so a shard can hold at most 2 ** 21 fingerprints. A shard returns a spanning forest of its links (at most
one row per member), never its pairs.

``near_duplicates(docs)`` returns one row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over
links, itself included). Null and empty texts and texts of white space have fingerprint zero and link like any other. A null doc_id never names
a component unless all its members are null. Repeated rows are equal rows. An empty table gives no rows. Other columns are ignored.

``keep_first(docs)`` keeps one document of each component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from relyard.llm.bk_trees import BKForest
from relyard.llm.common import KEYS_SENT, few_rows, row_key, same_row, stored, texts, within_reach
from relyard.llm.components import star_components

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
BITS = 64
#: Fingerprints in one tree.
SHARD = 32_768
#: Rows of whole shards searched together.
TOGETHER = 65_536
#: Levels of division.
DEPTH = 4
#: Of many prints, one member in so many is counted to find large shards. Dividing a shard never loses a link, so an estimate will do.
SAMPLED = 16


def shingle_hashes(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """A hash for every shingle, repeats included. Only A-Z are lower-cased; words end at ASCII white space."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(join(tokens), seed)] if tokens else [], "<u8")
    windows = zip(*[tokens[k:] for k in range(words)])
    return np.fromiter((digest(join(s), seed) for s in windows), "<u8", len(tokens) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """Bit k is 1 if more than half of the hashes have it; zero without hashes."""
    ones = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 100_000):
        part = hashes[first : first + 100_000].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, words, seed))


def remixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Other hashes of the same shingles, for a further print: an odd multiplier and a shift spread all bits anew."""
    factor = np.uint64((0x9E3779B97F4A7C15 * (2 * number + 1)) % (1 << 64))
    mixed = (hashes ^ (hashes >> np.uint64(29))) * factor
    return mixed ^ (mixed >> np.uint64(32))


def prints(text: str, words: int, count: int) -> list[int]:
    hashes = shingle_hashes(text, words)
    return [majority(hashes if k == 0 else remixed(hashes, k)) for k in range(count)]


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, count: int = 1) -> DataFrame:
    """doc_id, row_key (names the row's id and text), fp (the 64 bits as a signed bigint) and further prints fp1, fp2 ... of every row."""
    names = ["fp", *(f"fp{k}" for k in range(1, count))]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            given = batch.column(2).to_pylist()
            values = np.array([prints(t, words, count) for t in given], "<u8").reshape(-1, count).view("<i8")
            columns = [batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in values.T)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", *names])

    keyed = texts(docs).select("doc_id", row_key("doc_id", "text"), "text")
    return keyed.mapInArrow(compute, "doc_id bigint, row_key bigint, " + ", ".join(f"{n} bigint" for n in names))


def prints_linked(rows: DataFrame, radius: int, count: int) -> DataFrame:
    """Links (u, v) between values of ``fp`` whose rows are near in any of their prints; one search serves all prints.

    The name ``fp`` travels with each print, so that equal prints meet in a shard too and nothing is joined back to all the prints.
    """
    names = ["fp", *(f"fp{k}" for k in range(1, count))]
    every = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(n).alias("print")) for k, n in enumerate(names)])
    distinct = stored(rows.select(*names).distinct(), "distinct-prints")
    nodes = distinct.select(F.col("fp").alias("name"), F.inline(every)).select("kind", F.col("print").alias("fp"), "name")
    return near_links(nodes, radius, sampled=SAMPLED).select("u", "v").where("u <> v").distinct()


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """``width`` bits cut into equal blocks, as (shift, width)."""
    at = [width * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def search_shards(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(shard, kind, fp, name) sorted by shard and fp; whole shards are searched as soon as enough rows are there. Gives (kind, u, v) links
    between names; equal fingerprints are one member of the tree."""
    held = [np.zeros(0, np.int64)] * 4

    def links(shard, kind, fp, name):
        same = shard[1:] == shard[:-1]
        company = np.r_[False, same] | np.r_[same, False]
        shard, kind, fp, name = shard[company], kind[company], fp[company], name[company]
        if not len(fp):
            return
        opens = np.r_[True, (shard[1:] != shard[:-1]) | (fp[1:] != fp[:-1])]
        first = np.flatnonzero(opens)
        numbers = np.cumsum(np.r_[True, shard[first][1:] != shard[first][:-1]])
        roots = BKForest(fp[first].view(np.uint64), numbers).roots(radius)
        rooted = first[roots[np.cumsum(opens) - 1]]
        members = np.flatnonzero(rooted != np.arange(len(fp)))
        columns = [pa.array(kind[members], pa.int32()), pa.array(name[members]), pa.array(name[rooted[members]])]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "u", "v"])

    for batch in batches:
        held = [np.r_[old, batch.column(k).to_numpy(zero_copy_only=False)] for k, old in enumerate(held)]
        if len(held[0]) >= TOGETHER:
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last shard may go on
            if cut:
                yield from links(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
    yield from links(*held)


def divided(level: DataFrame, width: int, parts: int) -> list[tuple[DataFrame, int]]:
    """Each shard divided by the value of each of ``parts`` blocks of its ``width`` free bits.

    ``rest`` holds the free bits side by side; blocks that leave equally many free are one table.
    """
    by_width: dict[int, list] = {}
    for number, (shift, size) in enumerate(cuts(width, parts)):
        bits = F.shiftrightunsigned("rest", shift).bitwiseAND(F.lit((1 << size) - 1))
        rest = F.col("rest").bitwiseAND(F.lit((1 << shift) - 1))
        if shift + size < width:
            rest = rest.bitwiseOR(F.shiftleft(F.shiftrightunsigned("rest", shift + size), shift))
        cell = F.struct(F.xxhash64("shard", F.lit(number), bits).alias("shard"), rest.alias("rest"))
        by_width.setdefault(width - size, []).append(cell)
    return [(level.select("kind", "fp", *(["name"] if "name" in level.columns else []), F.inline(F.array(*cells))), free) for free, cells in by_width.items()]


def near_links(nodes: DataFrame, radius: int = RADIUS, shard_size: int = SHARD, sampled: int = 1) -> DataFrame:
    """A spanning set of links (kind, u, v) between fingerprints (kind, fp) of one kind at most ``radius`` bits apart.

    Without a column ``name`` fingerprints are distinct and links name them; with it, links are between names.
    """
    named = "name" in nodes.columns
    columns = ["kind", "fp", *(["name"] if named else [])]
    whole = nodes.select(*columns, F.col("kind").cast("bigint").alias("shard"), F.col("fp").alias("rest"))
    name = F.col("name" if named else "fp")
    found = []
    todo = [(table, free, 1) for table, free in divided(whole, BITS, radius + 1)]
    while todo:
        level, free, depth = todo.pop()
        if depth < DEPTH:
            counted = level.where(F.pmod(F.xxhash64(name), F.lit(sampled)) == 0) if sampled > 1 else level
            sizes = counted.groupBy("shard").agg(F.count(F.lit(1)).alias("members"))
            large = stored(sizes.where(F.col("members") * sampled > shard_size).select("shard"), "large-shards")
            if not large.isEmpty():
                hot = stored(level.join(large, "shard", "left_semi"), "hot-shards")
                todo += [(table, rest, depth + 1) for table, rest in divided(hot, free, radius + 1)]
                level = level.join(large, "shard", "left_anti")
        shards = level.select("shard", "kind", "fp", name.alias("name")) if named else level.select("shard", "kind", "fp")
        shards = shards.repartition("shard").sortWithinPartitions("shard", "fp")
        shards = shards if named else shards.withColumn("name", F.col("fp"))
        found.append(shards.mapInArrow(lambda batches: search_shards(batches, radius), "kind int, u bigint, v bigint"))
    return reduce(DataFrame.union, found)


def grouped_rows(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, count: int = 1) -> DataFrame:
    """doc_id, row_key, fp, root (the smallest fingerprint of the component), component_id of every row.

    With more prints than one, rows are linked if any of their prints are near: a pair that one print just misses is found by another.
    """
    rows = stored(fingerprints(docs, words, count), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    if count == 1:
        links = near_links(nodes.select(F.lit(0).alias("kind"), "fp"), radius).select("u", "v")
    else:
        links = prints_linked(rows, radius, count)
    stars = stored(star_components(links), "fingerprint-stars")
    # The stars cover linked fingerprints only; every other one is a component of its own.
    grouped = nodes.join(stars, nodes["fp"] == stars["node"]).select("fp", "root", "first_id")
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = grouped.select("fp", "root").join(smallest, "root")
    named = nodes.join(linked, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return rows.select("doc_id", "row_key", "fp").join(named, "fp")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    fingerprint_text = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return grouped_rows(docs, words, radius).select("doc_id", fingerprint_text, "component_id")


def keep_first(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, count: int = 1, sent: int = KEYS_SENT) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: the smallest id of each group stays.

    Repeated rows of that document leave one; where several texts of a group share the smallest id, a hash of the text decides. A group in
    which every id is null keeps one row too. Only the keys of rows that go, or that are repeated, are sent to the rows; while they are at
    most ``sent``, rows stay where they are.
    """
    groups = stored(grouped_rows(docs, words, radius, count).select("doc_id", "row_key", "root"), "near-duplicate-groups")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    first = groups.groupBy("root").agg(F.min(rank).alias("first")).select("first.doc_id", "first.row_key", F.lit(True).alias("stays"))
    keyed = groups.groupBy("row_key", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    judged = keyed.join(first, same_row(keyed, first), "left").select(keyed["row_key"], keyed["doc_id"], "copies", F.coalesce("stays", F.lit(False)).alias("stays"))
    named = stored(judged.where("copies > 1 OR NOT stays"), "near-duplicate-keys")
    doc_id = docs["doc_id"].cast("bigint")
    packed = docs.select(doc_id.alias("doc_id"), row_key(doc_id, F.coalesce(docs["text"], F.lit(""))), F.struct("*").alias("row"))
    keys = F.broadcast(named) if within_reach(named, sent) else named
    marked = packed.join(keys, same_row(packed, keys), "left").where("coalesce(stays, true)").select(packed["doc_id"], packed["row_key"], "row", "copies")
    kept = marked.where("copies IS NULL").select("row.*")
    if named.where("stays").isEmpty():
        return kept
    copies = Window.partitionBy("row_key", "doc_id").orderBy(F.xxhash64("row"))
    once = marked.where("copies > 1").withColumn("copy", F.row_number().over(copies)).where("copy = 1")
    return kept.union(once.select("row.*"))
