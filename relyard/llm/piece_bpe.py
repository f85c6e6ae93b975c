"""SentencePiece encoding (merge type) by backtracking, and decoding.

A merge-type model joins, again and again, the neighbours whose joined piece has the best score, the leftmost first. Its result is the
one sequence of pieces in which every two neighbours are *compatible*: merging their joined characters anew gives these two pieces back.
So no merge has to be simulated over a text:

1. One Aho-Corasick pass over the reversed unit gives the longest piece that starts at each place.
2. From left to right the longest piece is taken if it is compatible with the one before; otherwise the next shorter piece that is
   its prefix. Compatibility of two pieces is decided by re-merging their characters, once per pair and worker.
3. Where none fits, the place is marked in a bitfield as failed, and the piece before it gives way to a shorter one. No failed place is
   entered again, so the work grows with the text.

Pieces never reach over the start of a run of word marks, nor over a newline, unless a piece of the model does; units between such
places are encoded once and kept by the worker up to a bound. A whole text is one unit for a model with pieces across them.

``encode(docs)`` returns one row per input row: doc_id, ids. Null and empty texts have no ids; null ids and repeated rows are kept as they
are; an empty table gives no rows; other columns are ignored. Characters without a piece become the ids of their UTF-8 bytes; texts that
spell a control piece (``<s>``) are ordinary text. ``decode(encoded)`` adds the text of the ids; null ids give a null text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from relyard.llm.common import texts
from relyard.llm.tokens import CACHED_UNITS, vocabulary_path

PIECE_FILE = "piece_bpe_32k.model"
MARK = "▁"

#: Bounds of what one worker keeps; what lies beyond is worked out again each time.
CACHED_PAIRS, CACHED_CHARS = 400_000, 64
#: Rows handed on at a time.
ROWS = 256


def located(name: str) -> str:
    """A vocabulary file by its path, or by its public name on the machine that asks."""
    return name if os.path.isabs(name) else vocabulary_path(name)


class PieceModel:
    """Encoder and decoder of one model file. A token is the id of a piece, or ``size`` + code point for a character without one."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        self.size = lib.get_piece_size()
        kinds = {i: lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i) for i in range(self.size)}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(lib.is_byte, self.bytes)) or any(map(lib.is_unused, kinds)):
            raise ValueError("only models with byte fallback and without unused pieces are supported")
        self.texts = {i: lib.id_to_piece(i) for i, special in kinds.items() if not special}
        self.ids = {piece: i for i, piece in self.texts.items()}
        self.scores = {piece: lib.get_score(i) for piece, i in self.ids.items()}
        # A piece that merging never makes cannot be taken.
        self.lengths = {i: len(piece) for i, piece in self.texts.items() if len(piece) == 1 or self.merged(piece) == [piece]}
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}
        letters = set("".join(self.ids))
        self.longest_at = ahocorasick.Automaton()
        for token, length in self.lengths.items():
            self.longest_at.add_word(self.texts[token][::-1], length * self.size + token)
        self.longest_at.make_automaton()
        crossing = any(MARK in piece.lstrip(MARK) for piece in self.ids) or "\n" in letters
        self.units = re.compile(r"(?s).+" if crossing else rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+")

    def merged(self, chars: str) -> list[str]:
        """The plain definition, for one or two pieces: join the best-scored neighbours, leftmost first, while any joined piece exists."""
        parts = list(chars)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def single(self, char: str) -> int:
        return self.ids.get(char, self.size + ord(char))

    def text_of(self, token: int) -> str:
        return self.texts[token] if token < self.size else chr(token - self.size)

    def next_shorter(self, token: int) -> int:
        """The longest shorter piece that starts this one; -1 if there is none. One character always stands for itself."""
        if token not in self.shorter:
            piece = self.text_of(token)
            starts = (self.ids[piece[:k]] for k in range(len(piece) - 1, 1, -1) if self.ids.get(piece[:k]) in self.lengths)
            self.shorter[token] = next(starts, self.single(piece[0]) if len(piece) > 1 else -1)
        return self.shorter[token]

    def compatible(self, left: int, right: int) -> bool:
        parts = [self.text_of(left), self.text_of(right)]
        fits = self.merged("".join(parts)) == parts
        if len(self.fits) < CACHED_PAIRS:
            self.fits[left << 32 | right] = fits
        return fits

    def tokens(self, unit: str) -> list[int]:
        n, size = len(unit), self.size
        longest = [0] * n  # of the piece that starts at n - 1 - k, as length * size + token
        for k, found in self.longest_at.iter(unit[::-1]):
            if found > longest[k]:
                longest[k] = found
        lengths, kept_fits = self.lengths, self.fits
        failed = bytearray(n // 8 + 1)
        taken: list[int] = []
        place, last, token = 0, -1, -1
        while place < n:
            if token < 0:
                token = longest[n - 1 - place] % size or self.single(unit[place])
            end = place + lengths.get(token, 1)
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = last < 0 or kept_fits.get(last << 32 | token)
                if fits or fits is None and self.compatible(last, token):
                    taken.append(token)
                    place, last, token = end, token, -1
                    continue
            token = self.next_shorter(token)
            while token < 0:
                failed[place >> 3] |= 1 << (place & 7)
                taken.pop()
                place -= lengths.get(last, 1)
                token, last = self.next_shorter(last), taken[-1] if taken else -1
        return taken

    def unit_ids(self, unit: str) -> bytes:
        ids = array("i", self.tokens(unit))
        if max(ids) >= self.size:
            ids = array("i", [i for t in ids for i in ([t] if t < self.size else map(self.bytes.__getitem__, self.text_of(t).encode()))])
        packed = ids.tobytes()
        if len(unit) <= CACHED_CHARS and len(self.kept) < CACHED_UNITS:
            self.kept[unit] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        kept = self.kept
        return b"".join([kept.get(unit) or self.unit_ids(unit) for unit in self.units.findall(self.library.normalize(text))])


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model with its caches for each worker and file."""
    return PieceModel(path)


@lru_cache(maxsize=2)
def library(path: str) -> sentencepiece.SentencePieceProcessor:
    """All that decoding needs."""
    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode(docs: DataFrame, name: str = PIECE_FILE) -> DataFrame:
    """(doc_id, ids); the file is found on the machine of each worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(located(name))
        for batch in _small(batches):
            packed = [own.encode(text.as_py()) for text in batch.column(1)]
            ends = np.cumsum([0] + [len(ids) // 4 for ids in packed]).astype("int32")
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, name: str = PIECE_FILE) -> DataFrame:
    """(doc_id, ids, text) of a table with doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library(located(name))
        for batch in _small(batches):
            text = [own.decode(ids.values.to_numpy().tolist()) if ids.is_valid else None for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    rows = encoded.select(encoded["doc_id"].cast("bigint").alias("doc_id"), encoded["ids"].cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, text string")


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: what one document needs as Python values is gone before the next few come."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def digests(decoded: DataFrame) -> DataFrame:
    """One row per document: number of ids, and digests of ids and decoded text."""
    ids_text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids_text, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
