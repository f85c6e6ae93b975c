"""Ranked lexical search by dual trees against scores of every pair."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from relyard.llm import lexical_search as ls
from relyard.llm.queries import QUERIES
from tests.llm.helpers import AWKWARD, DOC_SCHEMA, doc_table, prose

ITEM_SCHEMA = "item_id bigint, text string"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_terms(text):
    return [t.translate(LOWER) for t in PATTERN.findall(text or "")]


def brute_search(docs, items, k):
    """[(doc_id, text)], [(item_id, text)] to sorted (item_id, rank, doc_id, score)."""
    counted = [(i, Counter(brute_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_words = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(brute_terms(text))
    out = []
    for item, own in terms.items():
        scored = []
        for i, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // n_words
            hits = (t for t in own if t in c)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in hits)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i, score))
        out += [(str(item), rank, str(i), score) for rank, (*_, i, score) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in df.collect())


@given(st.text(max_size=60) | st.lists(st.sampled_from(["Ab", "É", "9z", "_", "`", "{", "\x7f", "\x80", "@", "[", "/", ":", "\n", "中"]), max_size=20).map("".join))
@settings(max_examples=800, deadline=None)
def test_terms(text):
    assert [t.decode() for t in ls.terms_of(text.encode())] == brute_terms(text)


def test_search_of_awkward_tables(spark):
    """Nulls, empty and long texts, repeated rows and ids, ties over the k-th place, items without terms or with several rows, several blocks."""
    texts = list(enumerate(AWKWARD)) + [(20 + k, prose(k % 7, 5 + k)) for k in range(60)] + [(200 - k, prose(3, 12)) for k in range(30)]
    texts += [(21, prose(1, 6)), (21, prose(1, 6)), (None, prose(3, 12)), (-4, prose(3, 12)), (300, prose(2, 4000))]
    items = [(0, prose(3, 9)), (1, prose(1, 400)), (2, None), (3, " .- "), (4, "one WORD É"), (5, prose(2, 3)), (5, prose(4, 3)), (None, "x y"), (6, "nowhere"), (0, prose(3, 9))]
    docs = doc_table(spark, texts).selectExpr("*", "1 as item_id", "2 as score", "3 as n", "4 as terms").repartition(5)
    table = spark.createDataFrame(items, ITEM_SCHEMA).selectExpr("*", "item_id as doc_id", "7 as rank")
    for k in (1, 7, 50):
        assert found(ls.search(docs, table, k)) == brute_search(texts, items, k)
    assert found(ls.search(docs, table, 7, block_bytes=900)) == brute_search(texts, items, 7)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, " ")], [(1, "a")]), ([(1, "a")], [(1, None)])])
def test_nothing_to_find(spark, docs, items):
    assert ls.search(spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOC_SCHEMA), spark.createDataFrame(items, ITEM_SCHEMA)).collect() == []


def sparse(rows, ids=None):
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(int)
    flat = [(t, v) for r in rows for t, v in sorted(r.items())]
    return ls.Rows(np.array(range(len(rows)) if ids is None else ids), at, np.array([t for t, _ in flat], np.int32), np.array([v for _, v in flat], np.int64))


def walk(docs, items, n_terms, k, trees=1, floors=None):
    tree = ls.Tree(sparse(items), n_terms, 2)
    floors = (np.zeros(len(items), np.int64), np.full(len(items), 2**63 - 1)) if floors is None else tuple(f[tree.rows.ids] for f in floors)
    search = ls.Search(tree, k, *floors, n_terms)
    for part in range(trees):
        own = [i for i in range(len(docs)) if i % trees == part]
        if own:
            search.add(ls.Tree(sparse([docs[i] for i in own], own), n_terms, 4))
    return {int(item): sorted((-s, -d) for s, d in best) for item, best in zip(tree.rows.ids, search.best)}, search


def every_pair(docs, items, k):
    out = {}
    for i, item in enumerate(items):
        scores = [(-sum(doc.get(t, 0) for t in item), d) for d, doc in enumerate(docs)]
        out[i] = sorted(s for s in scores if s[0] < 0)[:k]
    return out


rows_of = lambda most: st.lists(st.dictionaries(st.integers(0, 11), st.integers(0, 6), max_size=6), min_size=1, max_size=most)


@given(rows_of(40), st.lists(st.sets(st.integers(0, 11), min_size=1, max_size=5), min_size=1, max_size=9), st.integers(1, 6), st.integers(1, 3))
@settings(max_examples=400, deadline=None)
def test_walk_equals_every_pair(docs, items, k, trees):
    """Also with the k-th of any part of the documents as floor, at ties too."""
    items = [dict.fromkeys(i, 1) for i in items]
    want = every_pair(docs, items, k)
    assert walk(docs, items, 12, k, trees)[0] == want
    part = every_pair(docs[::2], items, k)
    floors = np.zeros(len(items), np.int64), np.full(len(items), 2**63 - 1)
    for i, best in part.items():
        if len(best) == k:
            floors[0][i], floors[1][i] = -best[-1][0], 2 * best[-1][1]
    assert walk(docs, items, 12, k, trees, floors)[0] == want


def test_bounds_prune_whole_batches():
    """Documents of eight subjects, items of one each: most pairs are never scored."""
    rnd = random.Random(5)
    docs = [{t: rnd.randint(1, 9) for t in rnd.sample(range(s * 20, s * 20 + 20), 8)} for s in range(8) for _ in range(200)]
    items = [dict.fromkeys(rnd.sample(range(s * 20, s * 20 + 20), 4), 1) for s in range(8) for _ in range(5)]
    got, search = walk(docs, items, 160, 3)
    assert got == every_pair(docs, items, 3) and search.scored < len(docs) * len(items) / 6


def test_query_runs_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(QUERIES["op11_ranked_search"].build(spark, sf)) == brute_search(docs, items, 50)
