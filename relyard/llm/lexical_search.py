r"""Ranked lexical search by dual trees: the k best documents of every item, exactly.

A document's score for an item is the sum, over the item's terms, of integer impacts that depend on the term, its occurrences and the
document's length. So it is a product of two sparse vectors, and the largest value of every coordinate bounds a whole batch:

1. One pass over the documents keeps, of each, its length and its counts of the items' terms (``vectors``); counts over all of them follow.
2. Both sides get a hierarchy whose nodes hold the maxima of their coordinates: items on the driver (bounded blocks), documents in
   each task, in batches of bounded size, halved again and again along two unlike members.
3. A pair (item node, document node) is dropped if its bound, the product of the maxima, can't beat the weakest k-th score among the
   items of the node; at a tie the smallest document id of the node decides. What is left is refined on both sides down to single
   items and document leaves, which are scored exactly.
4. Tasks start from the k-th scores of one document in ``SAMPLE`` (by a hash): true lower bounds, so they only prune, and
   what tasks hand on doesn't grow with their number.

Items are searched in blocks of about ``BLOCK_BYTES`` of text, each a pass over the documents. ``search(docs, items, k)`` returns item_id,
rank (from 1), doc_id, score. Terms are maximal matches of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` with A-Z lower-cased. Null and empty texts
have no terms: such items have no rows, such documents are in no row and no count. Rows of one item id (null too) are one item with all
their terms; rows of one document id are documents of their own, each with its rank. Equal scores go by ascending doc_id, null
first. Fewer than k documents above 0 are all returned. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from relyard.llm.common import stored

K = 50
SAMPLE = 64
BLOCK_BYTES = 4 << 20
#: Most documents and most counts in one tree of a task; members of a leaf.
TREE_DOCS, TREE_COUNTS = 16_384, 2_000_000
DOC_LEAF, ITEM_LEAF = 32, 8
NULL_ID = -(2**63)

#: Bytes of UTF-8 text: A-Z become a-z, what is in no term becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

VECTORS = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
FOUND = "item int, doc_id bigint, score bigint"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Rows:
    """Sparse rows: row i has the coordinates terms[at[i]:at[i+1]] with these values, and an id."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.ids, self.at, self.terms, self.values = ids, at, terms, values

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.at[rows + 1] - self.at[rows]
        at = np.concatenate(([0], np.cumsum(sizes)))
        places = np.arange(at[-1]) + np.repeat(self.at[rows] - at[:-1], sizes)
        return Rows(self.ids[rows], at, self.terms[places], self.values[places])

    def sums(self, dense: np.ndarray) -> np.ndarray:
        """Product of every row with a dense vector."""
        running = np.concatenate(([0], np.cumsum(dense[self.terms] * self.values)))
        return running[self.at[1:]] - running[self.at[:-1]]


def _joined(parts: list[Rows]) -> Rows:
    at = np.concatenate([[0], *[np.diff(p.at) for p in parts]]).cumsum()
    return Rows(*(np.concatenate(x) for x in ([p.ids for p in parts], [at], [p.terms for p in parts], [p.values for p in parts])))


class Node:
    """Rows lo to hi of a tree with the maxima of their coordinates and their smallest id."""

    __slots__ = ("lo", "hi", "terms", "top", "low_id", "below")

    def __init__(self, lo: int, hi: int, terms: np.ndarray, top: np.ndarray, low_id: int, below: tuple):
        self.lo, self.hi, self.terms, self.top, self.low_id, self.below = lo, hi, terms, top, low_id, below


def _maxima(terms: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(terms, kind="stable")
    terms, values = terms[order], values[order]
    starts = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.array([], int)
    return terms[starts], np.maximum.reduceat(values, starts) if len(starts) else values


class Tree:
    """Rows in tree order, and the root of their nodes. Similar rows come together: a node is halved by its likeness to two of its rows."""

    def __init__(self, rows: Rows, n_terms: int, leaf: int):
        self.leaf, self.dense = leaf, np.zeros(n_terms, np.float64)
        parts: list[Rows] = []
        self.root = self._grow(rows, 0, parts)
        self.rows, self.dense = _joined(parts), None

    def _likeness(self, rows: Rows, row: int) -> np.ndarray:
        own = slice(rows.at[row], rows.at[row + 1])
        self.dense[rows.terms[own]] = rows.values[own]
        sums = rows.sums(self.dense)
        self.dense[rows.terms[own]] = 0
        return sums

    def _grow(self, rows: Rows, lo: int, parts: list[Rows]) -> Node:
        n = len(rows.ids)
        if n <= self.leaf:
            parts.append(rows)
            terms, top = _maxima(rows.terms, rows.values)
            return Node(lo, lo + n, terms, top, int(rows.ids.min()), ())
        one = self._likeness(rows, int(np.argmax(np.diff(rows.at))))
        other = self._likeness(rows, int(np.argmin(one)))
        order = np.argsort(one - other, kind="stable")
        below = self._grow(rows.take(order[: n // 2]), lo, parts), self._grow(rows.take(order[n // 2 :]), lo + n // 2, parts)
        terms, top = _maxima(*(np.concatenate([getattr(b, c) for b in below]) for c in ("terms", "top")))
        return Node(lo, lo + n, terms, top, min(b.low_id for b in below), below)


class Search:
    """The k best documents so far of every item, and the walk over pairs of nodes that finds them."""

    def __init__(self, items: Tree, k: int, floor_scores: np.ndarray, floor_ids: np.ndarray, n_terms: int):
        self.items, self.k = items, k
        #: A document must not be worse than (score, id) of the item's floor; floors rise with the k-th best.
        self.scores, self.low_ids = floor_scores.copy(), floor_ids.copy()
        self.best: list[list[tuple[int, int]]] = [[] for _ in floor_scores]
        self.dense = np.zeros(n_terms, np.int64)
        self.column = np.full(n_terms, -1, np.int32)
        self.scored = 0

    def _hopeless(self, bound: int, item: Node, low_id: int) -> bool:
        if bound <= 0:
            return True
        own = slice(item.lo, item.hi)
        weakest = self.scores[own].min()
        return bound < weakest or bound == weakest and low_id > self.low_ids[own][self.scores[own] == weakest].max()

    def add(self, docs: Tree) -> None:
        """Search one tree of documents."""
        stack = [(docs.root, [self.items.root])]
        while stack:
            node, frontier = stack.pop()
            self.dense[node.terms] = node.top
            left: list[Node] = []
            for item in frontier:
                for part in item.below or (item,):
                    if not self._hopeless(int(self.dense[part.terms].sum()), part, node.low_id):
                        left.append(part)
            if left and node.below:
                stack += [(part, left) for part in node.below]
            elif left:
                self._score(docs.rows, node, self._down(left, node.low_id))
            self.dense[node.terms] = 0

    def _down(self, frontier: list[Node], low_id: int) -> Iterator[Node]:
        """Leaves of the item tree below a frontier that still have a chance."""
        stack = list(frontier)
        while stack:
            item = stack.pop()
            if not item.below:
                yield item
            else:
                stack += [part for part in item.below if not self._hopeless(int(self.dense[part.terms].sum()), part, low_id)]

    def _score(self, docs: Rows, node: Node, leaves: Iterator[Node]) -> None:
        """Exact scores of one document leaf for the items of the leaves, each item behind its own bound."""
        block = None
        items = self.items.rows
        for leaf in leaves:
            for i in range(leaf.lo, leaf.hi):
                terms = items.terms[items.at[i] : items.at[i + 1]]
                bound = int(self.dense[terms].sum())
                if bound <= 0 or bound < self.scores[i] or bound == self.scores[i] and node.low_id > self.low_ids[i]:
                    continue
                if block is None:
                    own = slice(docs.at[node.lo], docs.at[node.hi])
                    self.column[node.terms] = np.arange(len(node.terms))
                    block = np.zeros((len(node.terms) + 1, node.hi - node.lo), np.int64)
                    block[self.column[docs.terms[own]], np.repeat(np.arange(node.hi - node.lo), np.diff(docs.at[node.lo : node.hi + 1]))] = docs.values[own]
                scores = block[self.column[terms]].sum(axis=0)  # a term that no document of the leaf has takes the last, empty row
                self.scored += len(scores)
                for j in np.flatnonzero((scores > 0) & (scores >= self.scores[i])):
                    self._offer(i, int(scores[j]), int(docs.ids[node.lo + j]))
        if block is not None:
            self.column[node.terms] = -1

    def _offer(self, i: int, score: int, doc_id: int) -> None:
        if score < self.scores[i] or score == self.scores[i] and doc_id > self.low_ids[i]:
            return
        best = self.best[i]
        if len(best) < self.k:
            heappush(best, (score, -doc_id))
        else:
            heapreplace(best, (score, -doc_id))
        if len(best) == self.k:
            self.scores[i], self.low_ids[i] = best[0][0], -best[0][1]


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: its number of terms, and its counts of those in the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    counted = Counter(map(number.get, words))
                    counted.pop(None, None)
                    rows.append((doc_id.as_py(), len(words), list(counted.keys()), list(counted.values())))
            ids, n, terms, counts = zip(*rows) if rows else ((), (), (), ())
            numbers = pa.list_(pa.int32())
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, numbers), pa.array(counts, numbers)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("binary").alias("text")).mapInArrow(run, VECTORS)


def item_terms(items: DataFrame) -> tuple[list, list[set[bytes]]]:
    """Ids of a block of items, and the terms of each."""
    found: dict = {}
    for row in items.collect():
        found.setdefault(row.item_id, set()).update(terms_of(bytes(row.text) if row.text is not None else None))
    found = {i: terms for i, terms in found.items() if terms}
    return list(found), list(found.values())


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([[0], *[[len(r)] for r in rows]]).cumsum(), np.concatenate(rows)


def _batches(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_words: int) -> Iterator[Rows]:
    """Vectors to impacts, as many documents at a time as a tree may hold."""
    parts: list[Rows] = []
    docs = counts = 0
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            sizes = part.column(2).value_lengths().to_numpy()
            terms, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64)
            # Python integers: the product outgrows 64 bits before the quotient does.
            norm = np.array([20 * (50 + 50 * n * n_docs // n_words) for n in part.column(1).to_pylist()], np.int64)
            impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + np.repeat(norm, sizes)))
            at = np.concatenate(([0], np.cumsum(sizes)))
            parts.append(Rows(part.column(0).fill_null(NULL_ID).to_numpy(), at, terms, impact))
            docs, counts = docs + len(sizes), counts + len(terms)
            if docs >= TREE_DOCS or counts >= TREE_COUNTS:
                yield _joined(parts)
                parts, docs, counts = [], 0, 0
    if docs:
        yield _joined(parts)


def _found(vecs: DataFrame, tree: Tree, weights: np.ndarray, n_docs: int, n_words: int, k: int, floors) -> DataFrame:
    """(item, doc_id, score): the k best of each task that are not below the floors; items by their place in the tree."""
    sent = vecs.sparkSession.sparkContext.broadcast((tree, weights, *floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, weights, scores, ids = sent.value
        search = Search(tree, k, scores, ids, len(weights))
        for rows in _batches(batches, weights, n_docs, n_words):
            search.add(Tree(rows, len(weights), DOC_LEAF))
        out = [(i, None if -d == NULL_ID else -d, s) for i, best in enumerate(search.best) for s, d in best]
        for at in range(0, len(out), 20_000):
            item, doc_id, score = zip(*out[at : at + 20_000])
            columns = [pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return vecs.select("doc_id", "n", "terms", "counts").mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame | None:
    ids, terms = item_terms(items)
    if not ids:
        return None
    vocabulary = {term: number for number, term in enumerate(sorted(set().union(*terms)))}
    vecs = stored(vectors(docs, vocabulary), "search-vectors")
    totals = vecs.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
    if not totals.docs:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in vecs.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = math.floor(1000 * math.log((2 * totals.docs + 2) / (2 * df + 1)))
    at, flat = _flat([np.array(sorted(vocabulary[t] for t in own), np.int32) for own in terms])
    tree = Tree(Rows(np.arange(len(ids)), at, flat, np.ones(len(flat), np.int64)), len(vocabulary), ITEM_LEAF)
    floors = np.zeros(len(ids), np.int64), np.full(len(ids), 2**63 - 1)
    sample = vecs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    for row in _ranked(_found(sample, tree, weights, totals.docs, totals.words, k, floors), k).where(F.col("rank") == k).collect():
        floors[0][row["item"]], floors[1][row["item"]] = row.score, NULL_ID if row.doc_id is None else row.doc_id
    ranked = _ranked(_found(vecs, tree, weights, totals.docs, totals.words, k, floors), k)
    names = docs.sparkSession.createDataFrame([(place, ids[i]) for place, i in enumerate(tree.rows.ids.tolist())], "item int, item_id bigint")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    own = items.select(items["item_id"].cast("bigint").alias("item_id"), items["text"].cast("binary").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        found = _search_block(docs, own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block), k)
        out = out if found is None else out.union(found)
    return out


def oracle(k: int = K) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = rf"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH item_terms AS (SELECT DISTINCT item_id, unnest({split}) AS term FROM benchmark),
docs AS (SELECT row, doc_id, terms, len(terms) AS n FROM (
  SELECT row_number() OVER () AS row, doc_id, {split} AS terms FROM documents) WHERE len(terms) > 0),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM docs),
counts AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY row, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
impacts AS (
  SELECT c.row, c.term, w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (100 - 50 + (50 * d.n * t.big_n) // t.big_l))) AS impact
  FROM counts c JOIN docs d USING (row) JOIN weights w USING (term), totals t),
scores AS (
  SELECT i.item_id, p.row, sum(p.impact)::BIGINT AS score FROM item_terms i JOIN impacts p ON p.term = i.term GROUP BY i.item_id, p.row),
ranked AS (
  SELECT s.item_id, d.doc_id, s.score, row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, d.doc_id NULLS FIRST) AS rank
  FROM scores s JOIN docs d USING (row) WHERE s.score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {k}
"""
