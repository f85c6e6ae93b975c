"""SimHash groups, BK-trees, components and substring spans against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from relyard.llm import simhash, substring_dedup
from relyard.llm.bk_trees import BKForest
from relyard.llm.components import star_components
from tests.llm.helpers import AWKWARD, DOC_SCHEMA, doc_table, prose


def slow_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(values, radius):
    """value -> smallest value reachable."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(set(values))
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@given(st.text(max_size=60) | st.lists(st.sampled_from(["a", "B", "É", "c d", "\n", "\x0b"]), max_size=12).map(" ".join))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def near_values(n=300, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    out = set()
    while len(out) < n:
        v = int(rng.choice(centres))
        for _ in range(rng.integers(0, 5)):
            v ^= 1 << int(rng.integers(0, 64))
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("radius", [0, 1, 3, 8])
def test_bk_forest_finds_every_pair(radius, monkeypatch):
    monkeypatch.setattr("relyard.llm.bk_trees.FRONTIER", 500)
    values = near_values()
    numbers = np.sort(np.arange(len(values)) % 3)
    forest = BKForest(np.array(values, np.uint64), numbers)
    got = {(int(a), int(b)) for q, n in forest.hits(radius) for a, b in zip(q, n)}
    want = {
        (i, j)
        for i in range(len(values))
        for j in range(i)
        if numbers[i] == numbers[j] and (values[i] ^ values[j]).bit_count() <= radius
    }
    assert got == want


@pytest.mark.parametrize("shard_size", [32_768, 20])
def test_links_keep_components(spark, shard_size):
    """Also when shards are divided down to the last level."""
    values = near_values(400, 2)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    nodes = spark.createDataFrame([(0, v) for v in signed] + [(1, v ^ 1) for v in signed[:9]], "kind int, fp bigint")
    links = simhash.near_links(nodes, 3, shard_size).where("kind = 0").select("u", "v")
    stars = {r.node % (1 << 64): r.root for r in star_components(links).collect()}
    want = slow_groups(values, 3)
    members = {}
    for v, root in want.items():
        members.setdefault(root, []).append(v)
    for group in members.values():
        roots = {stars.get(v) for v in group}
        assert len(roots) == 1 and (roots == {None}) == (len(group) == 1)
    assert len({r for r in stars.values()}) == sum(len(g) > 1 for g in members.values())


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(200)] + [(900, 901), (7, 7)], "u bigint, v bigint")
    got = {r.node: r.root for r in star_components(links).collect()}
    assert got == {k: 0 for k in range(201)} | {900: 900, 901: 900}


def documents(spark):
    base = prose(1, 300)
    near = base.replace("alpha1x", "changed", 1)
    texts = list(enumerate([base, prose(2, 80), base, near, base.upper(), prose(3, 40)] + AWKWARD)) + [(0, base), (None, base), (None, prose(9, 30))]
    return doc_table(spark, texts), texts


def test_near_duplicates_by_brute_force(spark):
    docs, texts = documents(spark)
    prints = {t: slow_fingerprint(t or "") for _, t in texts}
    roots = slow_groups(prints.values(), 3)
    smallest = {}
    for i, t in texts:
        if i is not None:
            r = roots[prints[t]]
            smallest[r] = min(smallest.get(r, i), i)
    want = sorted((i if i is not None else -1, f"{prints[t]:016x}", smallest.get(roots[prints[t]])) for i, t in texts)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and got == want
    kept = simhash.keep_first(docs, count=1)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(roots.values())) and 0 in ids and 2 not in ids and 3 not in ids


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0
    assert substring_dedup.repeated_spans(empty).count() == 0 and substring_dedup.remove_spans(empty).count() == 0
    docs, _ = documents(spark)
    clash = docs.selectExpr("*", "1 AS row_key", "'f' AS fp", "2 AS spans", "3 AS body", "4 AS `row`", "5 AS component_id", "6 AS copy")
    assert simhash.keep_first(clash).columns == clash.columns
    assert substring_dedup.remove_spans(clash).columns == clash.columns
    assert simhash.keep_first(clash).count() == simhash.keep_first(docs).count()


def slow_rows(texts, count):
    """Groups of row numbers linked by any print."""
    rows = [simhash.prints(t or "", 3, count) for t in texts]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if any((a ^ b).bit_count() <= 3 for a, b in zip(rows[i], rows[j])):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]


def test_several_prints_link_rows_near_in_any(spark):
    base = [prose(k, 120).split() for k in range(6)]
    texts = [" ".join(w) for w in base]
    for k, words in enumerate(base):
        for at in range(5, 100, 17):
            texts.append(" ".join(words[:at] + [f"changed{k}"] + words[at + 1 :]))
    groups = {n: slow_rows(texts, n) for n in (1, 4)}
    assert len(set(groups[4])) < len(set(groups[1]))
    docs = doc_table(spark, list(enumerate(texts)))
    for n, roots in groups.items():
        assert sorted(r.doc_id for r in simhash.keep_first(docs, count=n).collect()) == sorted(set(roots))
    assert simhash.prints("", 3, 2) == [0, 0] and simhash.prints("a b c d", 3, 2)[0] == slow_fingerprint("a b c d")


def slow_spans(texts, min_words, runs=False):
    seen, found = {}, set()
    ranked = sorted(set(texts), key=lambda x: (x[0] is None, x[0] or 0))
    for doc_id, text in ranked:
        for start, length, n_words, normal in sorted(substring_dedup.all_units(text or "", min_words, runs)):
            if normal in seen:
                found.add((doc_id, start, length, n_words, *seen[normal]))
            else:
                seen[normal] = (doc_id, start)
    return found


def test_spans_and_cut(spark):
    passage = prose(50, 60)
    sentence = "This sentence has more than eight words in it."
    texts = [
        (5, f"{prose(1, 20)}\n{passage}\n{prose(2, 20)}"),
        (6, f"Intro text here.\n{passage.upper()}\ntail"),
        (7, passage),
        (8, f"Other start of line. {sentence} Other end of this line."),
        (9, f"{sentence}\nshort line\nshort line"),
        (None, passage + "\n" + prose(4, 9)),
        (10, None),
        (11, ""),
        (12, "short line"),
        (5, f"{prose(1, 20)}\n{passage}\n{prose(2, 20)}"),
    ]
    docs = doc_table(spark, texts)
    got = {tuple(r) for r in substring_dedup.repeated_spans(docs).select("doc_id", "start", "length", "n_words", "kept_doc_id", "kept_start").collect()}
    assert got == slow_spans(texts, 8)
    left = {}
    for r in substring_dedup.remove_spans(docs).collect():
        left.setdefault(r.doc_id, []).append((r.text, r.n_chars))
    assert left[5] == [(texts[0][1], len(texts[0][1]))] * 2
    assert left[6] == [("Intro text here.\ntail", 21)]
    assert 7 not in left and left[None] == [(prose(4, 9), len(prose(4, 9)))]
    assert left[9] == [("short line\nshort line", 21)] and left[10] == [(None, None)] and left[11] == [("", 0)]


def test_units_of_a_line():
    text = "short one\nIntro. A b c d. E f! G. H i j k l? M n\nA b c d."
    got = substring_dedup.units(text, 4)
    line = "Intro. A b c d. E f! G. H i j k l? M n"
    want = [line, "A b c d.", "A b c d. E f! G.", "H i j k l?", "H i j k l? M n", "A b c d."]
    assert [text[s : s + n] for s, n, _, _ in got] == [line, "A b c d.", "A b c d. E f! G.", "H i j k l?", "H i j k l? M n", "A b c d."]
    assert [x[3] for x in got] == [w.lower() for w in want] and [x[2] for x in got] == [len(w.split()) for w in want]
    assert [x[:3] for x in substring_dedup.units("A b c d. E", 4)] == [(0, 10, 5), (0, 8, 4)]


def test_passage_inside_other_text_is_cut(spark):
    passage = "Le premier mot de la phrase est ici. Oui. La seconde phrase du passage est un peu plus longue. Non. Fin de la troisième phrase de ce passage."
    texts = [(1, f"host words before {passage} and after it"), (2, f"other host text. {passage} Then more."), (3, prose(1, 40))]
    left = {r.doc_id: r.text for r in substring_dedup.remove_spans(doc_table(spark, texts)).collect()}
    assert left[1] == texts[0][1] and left[3] == texts[2][1]
    # The sentence that has other words before it in the first text differs; what follows is cut, short sentences too.
    assert left[2] == "other host text. Le premier mot de la phrase est ici. Oui. Then more."


@given(st.lists(st.sampled_from(["one two three. ", "four five! ", "six\n", " ", "seven ", "É. ", "\n\n"]), max_size=14).map("".join))
@settings(max_examples=100, deadline=None)
def test_units_name_places_of_the_text(text):
    for start, length, n_words, normal in substring_dedup.units(text, 2):
        piece = text[start : start + length]
        assert " ".join(piece.lower().split()) == normal and len(normal.split()) == n_words and "\n" not in piece


def test_negative_ids_and_every_way_of_filtering(spark):
    """The earliest place of a negative id; results with the filter, without it, and with rows moved or not are the same."""
    line = prose(900, 12)
    texts = [(-5, f"intro\n{line}"), (3, f"{line}\n{prose(901, 9)}"), (None, f"{prose(902, 9)}\n{line}"), (-9, prose(903, 12)), (-5, f"intro\n{line}")]
    docs = doc_table(spark, texts)
    got = {tuple(r) for r in substring_dedup.repeated_spans(docs).collect()}
    assert got == {(3, 0, len(line), 12, -5, 6), (None, len(texts[2][1]) - len(line), len(line), 12, -5, 6)} == slow_spans(texts, 8)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(substring_dedup.later_occurrences(docs, filtered=0)) == rows(substring_dedup.later_occurrences(docs))
    assert rows(substring_dedup.remove_spans(docs, sent=0)) == rows(substring_dedup.remove_spans(docs))
    assert rows(simhash.keep_first(docs, sent=0)) == rows(simhash.keep_first(docs))


def test_filter_loses_no_digest(spark):
    rng = np.random.default_rng(1)
    low = rng.integers(-(2**63), 2**63, 5000)
    words = substring_dedup.digest_filter(spark.createDataFrame([(int(x),) for x in low], "low bigint").repartition(3), len(low))
    assert substring_dedup.in_filter(words, low).all()
    assert substring_dedup.in_filter(words, rng.integers(-(2**63), 2**63, 20_000)).mean() < 0.03
    docs = doc_table(spark, [(k, "\n".join(prose(k % 3 + j, 9) for j in range(4))) for k in range(5)] + [(9, None), (10, "")])
    units = [u[3] for k in range(5) for u in substring_dedup.units("\n".join(prose(k % 3 + j, 9) for j in range(4)))]
    want = {int.from_bytes(substring_dedup._digest(u)[8:], "big", signed=True) for u in units if units.count(u) > 1}
    assert {r.low for r in substring_dedup.repeated_digests(docs, 8).collect()} == want


def test_runs_of_clauses_are_cut(spark):
    """Host words on both sides, no sentence end, and lines too short to be units."""
    clauses = [prose(600 + k, 5) for k in range(8)]
    verse = "\n".join(prose(700 + k, 4) for k in range(10))
    passage = ", ".join(clauses)
    texts = [(1, f"one host before {passage}, and after"), (2, f"another host, {passage}, then more"), (3, f"Poem\n{verse}\nend"), (4, f"Other words\n{verse}\nlast line")]
    docs = doc_table(spark, texts)
    left = {r.doc_id: r.text for r in substring_dedup.remove_spans(docs, runs=True).collect()}
    assert left[1] == texts[0][1] and left[3] == texts[2][1]
    # The first clause has host words before it in the first text.
    assert left[2] == f"another host, {clauses[0]}, then more"
    assert left[4] == "Other words\nlast line"
    # Op6 has the units of its SQL.
    assert substring_dedup.repeated_spans(docs).count() == 0


@given(st.lists(st.sampled_from(["one two three. ", "four, five! ", "six\n", " ", "seven ", "É; ", "\n\n"]), max_size=14).map("".join))
@settings(max_examples=100, deadline=None)
def test_runs_name_places_of_the_text(text):
    for start, length, n_words, normal in substring_dedup.clause_runs(text, 3):
        assert " ".join(text[start : start + length].lower().split()) == normal and len(normal.split()) == n_words >= 3


def test_counting_digests_holds_few_rows_at_a_time():
    def most(rows):
        batch = pa.record_batch({"text": [prose(k, 60).replace(" ", ", ") for k in range(rows)]})
        tracemalloc.start()
        found = sum(out.num_rows for out in substring_dedup.digest_counts(iter([batch]), 8, True))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found, peak

    (small, _), (few, little), (many, much) = most(10), most(500), most(4000)
    assert few == 50 * small and many == 400 * small
    assert much < 2 * little
