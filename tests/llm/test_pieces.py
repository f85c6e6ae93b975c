"""SentencePiece encoding by backtracking against the library itself."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from relyard.llm import piece_bpe
from relyard.llm.queries import QUERIES
from tests.llm.helpers import AWKWARD, DOC_SCHEMA, doc_table, prose

PATH = piece_bpe.located(piece_bpe.PIECE_FILE)
MODEL = piece_bpe.model(PATH)
SF = "/root/testdata/sf0.001"

parts = st.sampled_from(
    ["the", " ", "  ", "\n", "\t", "ing", "tion", "▁", "é", "日本", "<s>", "<unk>", "<0x0A>", "不", "0", "12", "...", "//", "==", "def ", "\x00", "er", "st", " of", "😀", "é"]
) | st.sampled_from(sorted(MODEL.ids)).map(lambda piece: piece.replace("▁", " "))


def own(text):
    return np.frombuffer(MODEL.encode(text), "i4").tolist()


@given(st.lists(parts, max_size=14).map("".join) | st.text(max_size=40) | st.text("abdeghinorst", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_ids_are_those_of_the_library(text):
    assert own(text) == MODEL.library.encode(text)


def test_runs_and_long_units():
    for n in range(0, 70):
        for text in (" " * n, "x" + " " * n + "the", "=" * n, "-" * n + "a", "\n" * n):
            assert own(text) == MODEL.library.encode(text)
    text = "a" * 30_000 + "theing" * 3_000 + "不" * 500
    assert own(text) == MODEL.library.encode(text)


def test_backtracking_gives_up_places_and_full_caches_change_nothing(monkeypatch):
    """Longest pieces alone would go wrong; bounds of the caches only cost time."""
    words = [piece for piece in sorted(MODEL.ids) if piece.isalpha()][::40]
    texts = [a + b for a, b in zip(words, words[7:])]
    greedy = 0
    for text in texts:
        place, longest = 0, []
        while place < len(text):
            longest.append(max((text[place:end] for end in range(place + 1, len(text) + 1) if text[place:end] in MODEL.ids), key=len))
            place += len(longest[-1])
        greedy += [MODEL.ids[piece] for piece in longest] != MODEL.tokens(text)
    assert greedy > 20
    monkeypatch.setattr(piece_bpe, "CACHED_PAIRS", 3)
    monkeypatch.setattr(piece_bpe, "CACHED_UNITS", 3)
    small = piece_bpe.PieceModel(PATH)
    assert all(small.encode(text) == MODEL.encode(text) for text in texts) and len(small.kept) == len(small.fits) == 3


def test_encode_and_decode(spark):
    texts = list(enumerate(AWKWARD)) + [(20, prose(1, 3000)), (21, prose(2, 10)), (21, prose(2, 10)), (21, "other"), (None, prose(5, 30))]
    docs = doc_table(spark, texts).selectExpr("*", "doc_id as ids", "lang as length")
    encoded = piece_bpe.encode(docs)
    library = MODEL.library
    assert sorted((str(r.doc_id), r.ids) for r in encoded.collect()) == sorted((str(i), library.encode(t or "")) for i, t in texts)
    decoded = piece_bpe.decode(encoded.selectExpr("*", "1 as text")).collect()
    assert sorted((str(r.doc_id), r.text) for r in decoded) == sorted((str(i), library.decode(library.encode(t or ""))) for i, t in texts)
    nothing = spark.createDataFrame([(1, None), (None, [])], "doc_id bigint, ids array<int>")
    assert sorted((str(r.doc_id), r.text) for r in piece_bpe.decode(nothing).collect()) == [("1", None), ("None", "")]


def test_empty_table(spark):
    encoded = piece_bpe.encode(spark.createDataFrame([], DOC_SCHEMA))
    assert piece_bpe.digests(piece_bpe.decode(encoded)).collect() == []


def test_whole_table_against_the_library(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_piece_ids"].build(spark, SF).collect()}
    want = {}
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = MODEL.library.encode(row.text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[row.doc_id] = len(ids), digest, hashlib.sha256(MODEL.library.decode(ids).encode()).hexdigest()
    assert got == want


def test_other_kinds_of_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        piece_bpe.PieceModel(str(tmp_path / "none.model"))
