"""Token counts, the token store and packing against the library itself."""

import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from relyard.llm import bin_packing, packing, token_counts, token_store, tokens
from relyard.llm.common import few_bytes
from relyard.llm.queries import QUERIES
from relyard.llm.wavelet import WaveletMatrix
from relyard.session import new_location
from tests.llm.helpers import AWKWARD, DOC_SCHEMA, doc_table, prose

WORD, BYTE = tokens.vocabulary_path(tokens.WORD_FILE), tokens.vocabulary_path(tokens.BYTE_FILE)
SF = "/root/testdata/sf0.001"
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
CACHED = {WORD: tokens.WordIds(WORD), BYTE: tokens.ByteLengths(BYTE)}

pieces = st.sampled_from(
    ["a", "Abc", "l'été", "don't", "'s", "'RE", "12", " ", "  ", "\n", "\n\n", "\t", "\r\n", ".", "...", "“x”", "…", "ß", "İ", "ŉ", "e\u0301", "²", "µ", "\u00a0",
     "\x1c", "<|endoftext|>", "<|startoftext|>", "<|", "日本", "_", "-", "!!", "Wörter,", "ǅ"]
)


def ids(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


@given(st.lists(pieces, max_size=12).map("".join) | st.text(max_size=40))
@settings(max_examples=600, deadline=None)
def test_cached_tokens_are_those_of_the_library(text):
    assert np.frombuffer(CACHED[WORD](text), "<u4").tolist() == ids(WORD, text)
    assert CACHED[BYTE](text) == len(ids(BYTE, text))


def test_every_character_of_the_short_cut():
    for c in filter(tokens.SAFE.fullmatch, map(chr, range(0x3000))):
        text = f"a{c}b {c} {c}'s{c}{c}1"
        assert np.frombuffer(CACHED[WORD](text), "<u4").tolist() == ids(WORD, text), c
        assert CACHED[BYTE](text) == len(ids(BYTE, text)), c


@given(st.lists(st.lists(pieces, max_size=12).map("".join) | st.text(max_size=40), max_size=6))
@settings(max_examples=300, deadline=None)
def test_many_texts_are_as_one_by_one(texts):
    every = [f"a{c}b {c}'s{c}1" for c in filter(tokens.SAFE.fullmatch, map(chr, range(0x3000)))]
    for some in (texts, texts + every):
        got = CACHED[WORD].many(pa.array(["x", *some], pa.string()).slice(1))
        assert [np.frombuffer(i, "<u4").tolist() for i in got] == [ids(WORD, t) for t in some]


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_many_merges_a_piece_once_however_full_the_cache(monkeypatch, most):
    encoder, merged = tokens.WordIds(WORD), []
    encoder.kept.most = most
    one = encoder._merged
    monkeypatch.setattr(encoder, "_merged", lambda pieces: merged.extend(pieces) or one(pieces))
    texts = [f"{w}, {w}... ({w}) l'{w} {w.title()}" for w in prose(3, 300).split()] * 2
    got = encoder.many(pa.array(texts))
    assert [np.frombuffer(i, "<u4").tolist() for i in got] == [ids(WORD, t) for t in texts]
    assert len(merged) == len(set(merged)) and set(merged) == {p for t in texts for p in tokens.WORD_PATTERN.findall(t.lower())}
    assert len(encoder.kept) == min(most, len(merged))


def test_slices_by_bytes_leave_no_row_out():
    texts = ["a" * n for n in (0, 3, 4, 0, 50, 0, 1, 1, 9, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], ["doc_id", "text"])
    parts = list(few_bytes(iter([batch, batch.slice(2, 0), batch.slice(4, 1)]), most=8))
    assert [d for p in parts for d in p.column(0).to_pylist()] == [*range(10), 4]
    assert all(sum(map(len, p.column(1).to_pylist()[:-1])) < 8 for p in parts) and len(parts) > 4


def test_full_cache_changes_nothing():
    encoder = tokens.WordIds(WORD)
    encoder.kept.most = 3
    text = prose(3, 50)
    assert encoder(text) == encoder(text) == CACHED[WORD](text) and len(encoder.kept) == 3


def rows_of(spark):
    texts = list(enumerate(AWKWARD)) + [(20, prose(1, 3000)), (21, prose(2, 10)), (21, prose(2, 10)), (21, "other"), (None, prose(5, 30))]
    return doc_table(spark, texts), [(i, t or "") for i, t in texts]


def test_counts(spark):
    docs, texts = rows_of(spark)
    want = sorted((str(i), len(t.encode()), len(ids(BYTE, t)), len(ids(BYTE, t)) > 20) for i, t in texts)
    for frequent in (0, 5, 20_000):
        got = token_counts.count_tokens(docs.withColumn("n_tokens", docs.doc_id), BYTE, limit=20, frequent=frequent)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert token_counts.count_tokens(spark.createDataFrame([], DOC_SCHEMA), BYTE).count() == 0


def test_count_query_on_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op10_token_counts"].build(spark, SF).collect()
    assert len(got) == len(texts)
    assert all(r.n_tokens == len(ids(BYTE, texts[r.doc_id])) and r.n_bytes == len(texts[r.doc_id].encode()) for r in got)


def test_lossy_counter_keeps_the_frequent(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_counts, "COUNTED_UNITS", 50)
    texts = ["the " * 10 + f"rare{k}" for k in range(200)]
    (batch,) = token_counts.task_counts([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])
    top = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    assert top["the"] == 200 * 9 and len(top) <= 51


@given(st.lists(st.integers(0, 300) | st.sampled_from([7, 65535, 65536, 2**32 - 1]), max_size=1200), st.integers(0, 310))
@settings(max_examples=60, deadline=None)
def test_wavelet_matrix(values, token):
    ends = [len(values) // 3, len(values) - len(values) // 3]
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.of(np.array(values, np.uint32), [None, 5], ends).to_bytes())
    assert matrix.decode().tolist() == values and matrix.doc_ids == [None, 5] and matrix.lengths.tolist() == ends
    assert [matrix.access(i) for i in range(0, len(values), 37)] == values[::37]
    for wanted in {token, *values[:2]}:
        places = [i for i, v in enumerate(values) if v == wanted]
        assert matrix.count(wanted) == len(places) and matrix.occurrences(wanted) == places
        assert matrix.rank(wanted, len(values) // 2) == sum(p < len(values) // 2 for p in places)


def test_token_store(spark, monkeypatch):
    docs, texts = rows_of(spark)
    path = new_location(spark, "test-store")
    token_store.write_tokens(docs, WORD, path, shard_tokens=50)
    rows = sorted(token_store.read_documents(spark, path).collect(), key=lambda r: r.start)
    sequence, want = [], []
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        own = ids(WORD, t) + [2]
        want.append((i, len(sequence), len(own), crc(own)))
        sequence += own
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in rows] == want
    token = ids(WORD, "word")[0]
    assert sorted(r.place for r in token_store.lookup(spark, path, token).collect()) == [k for k, v in enumerate(sequence) if v == token]
    empty = new_location(spark, "test-store")
    token_store.write_tokens(spark.createDataFrame([], DOC_SCHEMA), WORD, empty)
    assert token_store.read_documents(spark, empty).count() == 0


def test_store_query_on_whole_table(spark):
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = sorted(QUERIES["op2_token_store"].build(spark, SF).collect(), key=lambda r: r.doc_id)
    start = 0
    for (doc_id, text), r in zip(texts, rows, strict=True):
        own = ids(WORD, text) + [2]
        assert tuple(r) == (doc_id, start, len(own), crc(own))
        start += len(own)


def sound(rows, capacity):
    """No sequence is too full, and its pieces lie side by side."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark):
    docs, texts = rows_of(spark)
    rows = packing.pack(docs.withColumn("piece", docs.doc_id), WORD, capacity=256, shard_pieces=4).collect()
    sound(rows, 256)
    want = []
    for i, t in texts:
        own = ids(WORD, t) + [1]
        want += [(str(i), k // 256, k, len(own[k : k + 256]), crc(own[k : k + 256])) for k in range(0, len(own), 256)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows) == sorted(want)
    assert packing.pack(spark.createDataFrame([], DOC_SCHEMA), WORD).count() == 0


def test_packing_merges_a_piece_once_however_full_the_cache(monkeypatch):
    encoder, merged = tokens.WordIds(WORD), []
    encoder.kept.most = 0
    one, some = encoder.merged, encoder._merged
    monkeypatch.setattr(encoder, "merged", lambda piece: merged.append(piece) or one(piece))
    monkeypatch.setattr(encoder, "_merged", lambda pieces: merged.extend(pieces) or some(pieces))
    monkeypatch.setattr(tokens, "word_ids", lambda path: encoder)
    monkeypatch.setattr(packing, "texts", lambda docs: SimpleNamespace(mapInArrow=lambda cut, schema: cut))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    texts = [prose(3, 90), "", "日本 " + prose(4, 5), prose(3, 90).title()] * 2
    batch = pa.RecordBatch.from_arrays([pa.array([*range(7), None]), pa.array(texts)], ["doc_id", "text"])
    rows = pa.Table.from_batches(packing.pieces(None, WORD, capacity=64)(iter([batch]))).to_pylist()
    want = []
    for doc_id, text in zip([*range(7), None], texts):
        own = np.array(ids(WORD, text) + [1], "<u4")
        want += [(doc_id, k // 64, k, len(own[k : k + 64]), own[k : k + 64].tobytes()) for k in range(0, len(own), 64)]
    assert [tuple(r.values()) for r in rows] == [((3 << 36) + k, *w) for k, w in enumerate(want)]
    assert set(merged) == set(tokens.WORD_PATTERN.findall(prose(3, 90).lower())) and len(merged) == len(set(merged))


def test_packing_query_is_dense(spark):
    rows = QUERIES["op3_genetic_packing"].build(spark, "/root/testdata/sf0.01").collect()
    used = sound(rows, 4096)
    assert used <= 1.01 * (-(-sum(r.length for r in rows) // 4096)) + 1


@pytest.mark.parametrize("seed", range(4))
def test_genetic_operators_keep_every_piece(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 7, 64, 99, 100, rng.randint(1, 100)]) for _ in range(150)]
    people = bin_packing.first_population(lengths, 100, 4, rng)
    before = len(people[0])
    for child in [*people, bin_packing.crossover(people[1], people[2], lengths, 100, rng), bin_packing.mutated(people[0], lengths, 100, rng)]:
        assert sorted(p for b in child for p in b) == list(range(150))
        assert all(bin_packing.fill(b, lengths) <= 100 for b in child)
    grown = bin_packing.evolve(people, lengths, 100, 10, rng)
    assert len(grown[0]) <= before and sorted(p for b in grown[0] for p in b) == list(range(150))
