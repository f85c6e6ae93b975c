"""Quality votes, URL verdicts and decontamination against brute force."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from relyard.llm import decontaminate, quality_rules, text_stats, url_filter
from tests.llm.helpers import AWKWARD, DOC_SCHEMA, doc_table, prose


def slow_counts(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)


@given(st.lists(st.sampled_from(["a b c ", "a ", "É# ", "\n", "x\x0b", "\u00a0", "a b\n", "<>\t", "\x85"]), max_size=20).map("".join) | st.text(max_size=50))
@settings(max_examples=200, deadline=None)
def test_counts(text):
    assert text_stats.text_counts(text)[:5] == slow_counts(text)


def corpus():
    good = [prose(k, 120) for k in range(30)]
    bad = [" ".join(w + "***" for w in prose(40 + k, 120).split()) for k in range(8)] + ["BUY NOW!! " * 40] * 4
    return list(enumerate(good + bad + AWKWARD)) + [(0, good[0]), (None, good[1])]


def slow_votes(patterns, steps=100):
    """Expectation-maximisation over single documents, written out."""
    rules = range(len(patterns[0]))
    prior, on_good, on_bad = 0.7, [0.95 for _ in rules], [0.3 for _ in rules]
    for _ in range(steps):
        good = []
        for votes in patterns:
            yes, no = prior, 1 - prior
            for r in rules:
                if votes[r]:
                    yes *= on_good[r] if votes[r] == 1 else 1 - on_good[r]
                    no *= on_bad[r] if votes[r] == -1 else 1 - on_bad[r]
            good.append(yes / (yes + no))
        prior = min(0.95, max(0.05, sum(good) / len(good)))
        for r in rules:
            cast = [(g, v[r]) for g, v in zip(good, patterns) if v[r]]
            on_good[r] = min(0.995, max(0.6, (sum(g for g, v in cast if v == 1) + 19) / (sum(g for g, _ in cast) + 20)))
            right = (sum(1 - g for g, v in cast if v == -1) + 6) / (sum(1 - g for g, _ in cast) + 20)
            on_bad[r] = min(0.99, max(0.05, 1.05 - on_good[r], right))
    yes_no = []
    for votes in patterns:
        yes, no = prior, 1 - prior
        for r in rules:
            if votes[r]:
                yes *= on_good[r] if votes[r] == 1 else 1 - on_good[r]
                no *= on_bad[r] if votes[r] == -1 else 1 - on_bad[r]
        yes_no.append(yes / (yes + no))
    return yes_no


def test_votes(spark):
    rows = corpus()
    docs = doc_table(spark, rows)
    judged = quality_rules.judge(docs.withColumn("kept", docs.doc_id).withColumn("n_words", docs.doc_id))
    got = judged.select("doc_id", "n_words", "n_repeat_words", "base_failed", "posterior", "kept").collect()
    votes = [tuple(r) for r in text_stats.text_stats(docs).select(*[r.vote for r in quality_rules.RULES]).collect()]
    want = sorted(round(p, 6) for p in slow_votes(votes))
    assert sorted(round(r.posterior, 6) for r in got) == want
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.posterior >= 0.5)
    kept = Counter(r.doc_id for r in got if r.kept)
    assert set(range(30)) <= set(kept) and not set(range(30, 42)) & set(kept) and kept[0] == 2
    clash = docs.selectExpr("*", "1 AS counts", "2 AS n_words", "3 AS `row`")
    stay = quality_rules.keep_good(clash)
    assert stay.columns == clash.columns and Counter(r.doc_id for r in stay.collect()) == kept
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0


def test_votes_without_rows_or_with_silent_rules():
    model = quality_rules.fit_votes(np.zeros((0, 3), int), np.zeros(0))
    assert model.prior == 0.7
    model = quality_rules.fit_votes(np.array([[1, 0], [-1, 0]]), np.array([5.0, 1.0]))
    assert all(g + b >= 1.05 - 1e-12 for g, b in zip(model.on_good, model.on_bad))


def url_case(spark, *urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "1 AS host", "'x' AS verdict")
    return [tuple(r)[1:] for r in url_filter.judge(pages).orderBy("page_id").collect()]


def test_urls(spark):
    got = url_case(
        spark,
        "https://WWW.Example.COM/en/a?x#y", "http://m.example.com/en/", "http://example.com", "http://a.net/es/1", "http://net/fr/", "http://notnet/es/",
        None, "", "no scheme casino", "https://spam-farm.org/x", "https://spamfarm.org/", "http://x.org/cheap-pills", "http://x.org/cheap/cheap",
        "http://x.org/?q=free#loan", "http://h.org?a://b/c", "https://x.org/EN/Casino" + "a" * 9000, "://", "http://casino.example.com/en/", "http://É.org/écasino",
    )
    assert got == [
        ("www.example.com", "/en/a", "www.example.com/en/", "allow", 0, 0),
        ("m.example.com", "/en/", "example.com/en/", "block", 0, 0),
        ("example.com", "", None, "allow", 0, 0),
        ("a.net", "/es/1", "net/es/", "block", 0, 0),
        ("net", "/fr/", "net/fr/", "block", 0, 0),
        ("notnet", "/es/", None, "allow", 0, 0),
        ("", "", None, "allow", 0, 0),
        ("", "", None, "allow", 0, 0),
        ("", "", None, "block", 1, 0),
        ("spam-farm.org", "/x", None, "block", 1, 1),
        ("spamfarm.org", "/", None, "allow", 0, 0),
        ("x.org", "/cheap-pills", None, "block", 0, 2),
        ("x.org", "/cheap/cheap", None, "allow", 0, 1),
        ("x.org", "/", None, "block", 0, 2),
        ("h.org", "", None, "allow", 0, 0),
        ("x.org", "/EN/Casino" + "a" * 9000, None, "allow", 0, 0),
        ("", "", None, "allow", 0, 0),
        ("casino.example.com", "/en/", "example.com/en/", "block", 1, 0),
        ("É.org", "/écasino", None, "block", 1, 0),
    ]
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def slow_leaks(docs, items):
    """The rule: every window of an item at every alignment."""

    def words(t):
        return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]

    found = {}
    for doc_id, text in set(docs):
        d = words(text)
        for item_id, item in set(items):
            w = words(item)
            size = min(len(w), decontaminate.WINDOW)
            if not w or len(w) < decontaminate.LEAST_WORDS and d != w:
                continue
            for diagonal in range(-len(w) + 1, len(d)):
                same = [0 <= diagonal + j < len(d) and d[diagonal + j] == w[j] for j in range(len(w))]
                for s in range(len(w) - size + 1):
                    matched = sum(same[s : s + size])
                    if matched >= math.ceil(decontaminate.SHARE * size):
                        one = found.setdefault((doc_id, item_id), [0, diagonal + s, (0, 0)])
                        one[0] += 1
                        one[1] = min(one[1], diagonal + s)
                        one[2] = max(one[2], (matched, size))
    return {(d, i, n, first, *best) for (d, i), (n, first, best) in found.items()}


def test_leaks(spark, monkeypatch):
    items = [(1, prose(1, 40)), (2, prose(2, 25)), (3, "Just seven words stand in this item"), (4, "too short"), (None, prose(7, 15)), (5, None), (6, ""), (1, prose(1, 40))]
    one = items[0][1].split()
    swapped = " ".join(w if k % 9 != 4 else "other" for k, w in enumerate(one))
    texts = [
        (10, prose(30, 20) + " " + items[0][1].upper() + ", " + prose(31, 20)),
        (11, prose(32, 30) + " " + swapped),
        (12, " ".join(one[:22]) + " " + prose(33, 40)),
        (13, " ".join(one[:8]) + " " + prose(34, 40)),
        (14, "x just, SEVEN words\nstand in this item y"),
        (15, "just seven words stand there in this item too short"),
        (16, prose(35, 50)),
        (17, prose(7, 15)),
        (10, prose(2, 25)),
        (18, " ".join(one[30:])),
    ] + [(20 + k, t) for k, t in enumerate(AWKWARD)]
    docs = doc_table(spark, texts).selectExpr("*", "1 AS at", "2 AS n", "3 AS words", "4 AS seed", "5 AS item_id")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (200_000, 10):
        monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", block)
        pairs = decontaminate.contaminated(docs, benchmark)
        got = {tuple(r) for r in pairs.collect()}
        assert got == slow_leaks(texts, items)
    caught = {g[0] for g in got}
    assert caught == {10, 11, 12, 14, 17}
    left = decontaminate.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in texts if i not in caught)
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(docs, empty).count() == 0 and decontaminate.drop_contaminated(docs, empty).count() == len(texts)
    assert decontaminate.contaminated(spark.createDataFrame([], DOC_SCHEMA), benchmark).count() == 0


def test_every_allowed_pattern_meets_a_seed():
    """By enumeration for every size of window; longer items are windows of the largest size."""
    for size in range(1, decontaminate.WINDOW + 1):
        allowed = size - math.ceil(size * decontaminate.SHARE)
        places = [{q + o for o in m} for m in decontaminate.masks_of(size) for q in range(size - m[-1])]
        for pattern in itertools.combinations(range(size), allowed):
            assert any(place.isdisjoint(pattern) for place in places), (size, pattern)


def duck_leaks(docs, items):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    return set(con.execute(decontaminate.oracle()).fetchall())


def test_items_of_all_lengths_with_random_substitutions(spark):
    """3 to 60 words, up to a fifth of every window substituted: all are found, as the rule in SQL and in plain Python says."""
    rnd = random.Random(8)
    items = [(n, prose(800 + n, n)) for n in (1, 2, 3, 4, 5, 6, 7, 9, 12, 15, 19, 20, 24, 25, 26, 28, 30, 35, 38, 45, 60)]
    texts = []
    for n, item in items:
        for trial in range(6):
            words, changed = item.split(), set()
            for p in rnd.sample(range(n), n):
                size = min(n, decontaminate.WINDOW)
                if all(len({c for c in changed | {p} if s <= c < s + size}) <= size - math.ceil(size * 0.8) for s in range(n - size + 1)):
                    changed.add(p)
            body = " ".join("other" if p in changed else w for p, w in enumerate(words))
            around = n >= decontaminate.LEAST_WORDS
            texts.append((n * 10 + trial, f"{prose(2000 + n, 7)} {body} {prose(3000 + trial, 5)}" if around else body))
    texts += [(9000, "before " + items[2][1]), (9001, items[10][1].split(" ", 1)[1]), (9002, " ".join(items[20][1].split()[4:30])), (9003, " ".join(items[20][1].split()[5:20]))]
    docs, benchmark = doc_table(spark, texts).repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(r) for r in decontaminate.contaminated(docs, benchmark).collect()}
    want = slow_leaks(texts, items)
    assert got == want == duck_leaks(texts, items)
    assert {(d, i) for d, i, *_ in got} >= {(n * 10 + t, n) for n, _ in items for t in range(6)}
    assert {d for d, *_ in got} & set(range(9000, 9004)) == {9001, 9002}
    rows = lambda df: sorted(r.doc_id for r in df.collect())
    assert rows(decontaminate.drop_contaminated(docs, benchmark)) == rows(decontaminate.drop_contaminated(docs, benchmark, sent=0)) == [9000, 9003]


def test_short_items_with_substituted_words(spark):
    """Also where the two spaced masks, or all words in a row, are hidden by the substitutions."""
    cases = [(5, [1]), (7, [3]), (10, [2, 7]), (12, [5, 8]), (14, [4, 9]), (15, [3, 7, 11]), (20, [3, 7, 11, 15]), (24, [0, 1, 5, 9, 13, 17, 22, 23])]
    items = [(k, prose(100 + k, n)) for k, (n, _) in enumerate(cases)]
    texts = []
    for k, (n, at) in enumerate(cases):
        words = items[k][1].split()
        texts.append((k, " ".join([prose(200 + k, 9), *("other" if p in at else w for p, w in enumerate(words)), prose(300 + k, 9)])))
        over = [*at, next(p for p in range(2, n) if p not in at)]
        texts.append((50 + k, " ".join([prose(400 + k, 9), *("other" if p in over else w for p, w in enumerate(words)), prose(500 + k, 9)])))
    docs, benchmark = doc_table(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.compared) for r in decontaminate.contaminated(docs, benchmark).collect()}
    sizes = [min(n, decontaminate.WINDOW) for n, _ in cases]
    # One more substituted word is one too many.
    assert got == {(k, k): (math.ceil(n * decontaminate.SHARE), n) for k, n in enumerate(sizes)}
    left = {r.doc_id for r in decontaminate.drop_contaminated(docs, benchmark).collect()}
    assert left == {i for i, _ in texts} - {k[0] for k in got}
