"""The pipeline stage by stage, and against brute force on a small corpus."""

import re

import corpus_pipeline
from relyard.llm import decontaminate, quality_rules, substring_dedup, text_stats, tokens
from relyard.llm.common import stored
from tests.llm.helpers import AWKWARD, DOC_SCHEMA, doc_table, prose
from tests.llm.test_dedup import slow_fingerprint, slow_rows, slow_spans
from tests.llm.test_filters import slow_leaks, slow_votes
from tests.llm.test_tokens import ids, sound

SHARED = prose(90, 55)
BENCH = [(1, prose(70, 30)), (2, prose(71, 30))]


def corpus():
    clean = [(k, prose(k, 150)) for k in range(20)]
    junk = [(30 + k, " ".join(w + "***" for w in prose(40 + k, 100).split())) for k in range(6)]
    words = clean[4][1].split()
    changed = (" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in range(150))
    near = next(t for t in changed if 1 <= (slow_fingerprint(t) ^ slow_fingerprint(clean[4][1])).bit_count() <= 3)
    copies = [(40, clean[3][1]), (41, near), (42, clean[3][1].upper())]
    passages = [(50 + k, f"{prose(50 + k, 60)}\n{SHARED}\n{prose(80 + k, 40)}") for k in range(4)]
    leaks = [(60, prose(60, 60) + " " + BENCH[0][1] + " " + prose(61, 20))]
    return clean + junk + copies + passages + leaks + [(100 + k, t) for k, t in enumerate(AWKWARD)]


def brute_force(texts, table):
    """(doc_id, text) that reach packing."""
    votes = [tuple(r) for r in table.collect()]
    keep = []
    for (i, t), p in zip(texts, slow_votes(votes)):
        n, *_, repeated = text_stats.text_counts(t or "")[:5]
        if n >= 50 and 100 * repeated <= 50 * n and p >= 0.5:
            keep.append((i, t))
    keep.sort()
    keep = [keep[k] for k in sorted(set(slow_rows([t for _, t in keep], 1)))]
    spans = slow_spans(keep, substring_dedup.MIN_WORDS, runs=True)
    keep = [(i, substring_dedup.cut_out(t, [(s[1], s[2]) for s in spans if s[0] == i]) if any(s[0] == i for s in spans) else t) for i, t in keep]
    dirty = {pair[0] for pair in slow_leaks(keep, BENCH)}
    return [(i, t) for i, t in keep if i not in dirty]


def test_stages_on_a_small_corpus(spark, location):
    texts = corpus()
    docs = doc_table(spark, texts)
    spark.createDataFrame(BENCH, "item_id bigint, text string").write.parquet(f"{location}/benchmark.parquet")
    docs.repartition(3).write.parquet(f"{location}/documents.parquet")
    sizes = []
    now = spark.read.parquet(f"{location}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = stored(stage(spark, now, location), "test-stage")
        assert now.columns == before.columns
        sizes.append(now.count())
    votes = text_stats.text_stats(docs.coalesce(1)).select(*[r.vote for r in quality_rules.RULES])
    want = brute_force(texts, votes)
    got = sorted((r.doc_id, r.text, r.n_chars) for r in now.collect())
    assert got == sorted((i, t, len(t)) for i, t in want)
    assert sizes == sorted(sizes, reverse=True)
    kept = {i for i, _ in want}
    assert set(range(20)) <= kept and not kept & {*range(30, 36), 40, 41, 42, 60} and {50, 51, 52, 53} <= kept
    rows = corpus_pipeline.run(spark, location).collect()
    sound(rows, 4096)
    path = tokens.vocabulary_path(tokens.WORD_FILE)
    assert sorted((r.doc_id, r.length) for r in rows) == sorted((i, len(ids(path, t)) + 1) for i, t in want)


def test_stages_take_awkward_tables(spark, location):
    spark.createDataFrame(BENCH, "item_id bigint, text string").write.parquet(f"{location}/benchmark.parquet")
    empty = spark.createDataFrame([], DOC_SCHEMA)
    odd = doc_table(spark, [(None, prose(1, 90)), (None, prose(1, 90)), (1, None), (1, ""), (2, prose(2, 90) + "\n" + prose(1, 90)), (2, prose(2, 90) + "\n" + prose(1, 90))])
    odd = odd.selectExpr("*", "1 AS `row`", "'a' AS spans", "2 AS item_id", "3 AS component_id", "4 AS counts")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (empty, odd):
            out = stage(spark, docs, location)
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            assert out.count() == 0 if docs is empty else out.count() >= 1


def test_query_is_whole(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    known = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()}
    assert rows and {r.doc_id for r in rows} <= known and sound(rows, 4096) > 0
    assert not re.search("limit|sample", " ".join(s for s, _ in corpus_pipeline.STAGES))
    assert decontaminate.SHARE >= 0.8
