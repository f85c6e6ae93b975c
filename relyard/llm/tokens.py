"""Token ids and token counts of the tokenizers library, with caches over text units that never influence each other.

Encoding a text from scratch costs microseconds per word. Both vocabularies split a text at fixed places before merging,
so a unit between two such places always gives the same ids and can be kept. A unit that is not kept goes through the
library's own merge model. The short cut is only taken for texts whose every character has the same class in Python and
in the library (``SAFE``) and that hold no special token; every other text goes through the library as a whole.
"""

from __future__ import annotations

import codecs
import json
import re
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

WORD_FILE = "word_bpe_49k.json"
BYTE_FILE = "byte_bpe_50k.json"

#: Units kept by one Python worker (some 60 to 100 MB); beyond it units are encoded again each time.
CACHED_UNITS = 400_000

#: Pieces that one call of the merge model takes.
MERGED_PIECES = 256

# Character classes on which Python and the library agree, as fixed values.
LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ɏ"
MARKS = "¡«»¿–—‘’“”…€"
SAFE = re.compile(rf"[\t\n\r\x20-\x7e{LETTERS}{MARKS}]*")
# A vocabulary that lower-cases leaves out capitals whose small letter lies outside these classes (Ə, Ɓ and 21 more).
WORD_SAFE = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x2100)) if SAFE.fullmatch(c) and SAFE.fullmatch(c.lower())) + "]*")

# Patterns by which the two vocabulary files split a text, as fixed values restricted to the classes above.
WORD_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
BYTE_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
# ``WORD_PATTERN`` as Arrow's RE2 reads it: with spaces around all pieces but runs of letters, a text splits into the same pieces.
WORD_CUTS = rf"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\s{LETTERS}0-9]+)"
ODD_SPACES = re.compile(r"[ \n]{2}|[\t\r]|[ \n]$")


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


ALPHABET = str.maketrans({chr(b): c for b, c in byte_letters().items()})
# The same by byte, but a space stays: it parts pieces.
BYTES_BUT_SPACE = "".join(" " if b == 0x20 else c for b, c in sorted(byte_letters().items()))


class _Kept(dict):
    """unit -> value; misses are computed and kept up to a bound."""

    def __init__(self, compute, most: int = CACHED_UNITS):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, unit):
        value = self.compute(unit)
        if len(self) < self.most:
            self[unit] = value
        return value


class _Encoder:
    safe = SAFE

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        self.specials = tuple(t["content"] for t in layout["added_tokens"])
        self.layout = json.dumps([layout["normalizer"], layout["pre_tokenizer"], layout["post_processor"]])

    def plain(self, text: str) -> bool:
        return self.safe.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def merged(self, piece: str) -> list[int]:
        """Ids of one pre-token by the library's merge model."""
        mapped = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(ALPHABET)
        return [token.id for token in self.model.tokenize(mapped)]

    def library_ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids


class WordIds(_Encoder):
    """Ids of whole texts as little-endian unsigned 32-bit bytes; the vocabulary drops white space, so units are words."""

    safe = WORD_SAFE

    def __init__(self, path: str):
        super().__init__(path)
        self.units = "Lowercase" in self.layout and '"Removed"' in self.layout
        self.kept = _Kept(self._unit)
        self.merger = Tokenizer(self.model)
        self.merger.pre_tokenizer = WhitespaceSplit()
        vocabulary, suffix = self.merger.get_vocab(with_added_tokens=False), self.model.end_of_word_suffix
        # Every byte has a letter with and one without the suffix, so a piece's last id, and no other, has it.
        self.marked = bool(suffix) and all(c in vocabulary and c + suffix in vocabulary for c in byte_letters().values())
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def _unit(self, unit: str) -> bytes:
        ids = [i for piece in WORD_PATTERN.findall(unit) for i in self.merged(piece)]
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.units and self.plain(text):
            return b"".join(map(self.kept.__getitem__, text.lower().split()))
        return np.array(self.library_ids(text), "<u4").tobytes()

    def many(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, as one by one. Arrow numbers the pieces of all texts, so a piece is looked up, and merged if it is not kept, once a call."""
        values = texts.to_pylist()
        if not (self.units and self.marked):
            return list(map(self, values))
        plain = list(map(self.plain, values))
        together = iter(self._together(texts.filter(pa.array(plain, pa.bool_()))))
        return [next(together) if p else self(text) for p, text in zip(plain, values)]

    def _together(self, texts: pa.Array) -> list[bytes]:
        """Ids of plain texts."""
        spaced = pc.replace_substring_regex(pc.utf8_lower(texts), pattern=WORD_CUTS, replacement=r" \1 ")
        pieces = pc.utf8_split_whitespace(spaced)
        numbered = pieces.flatten().dictionary_encode()
        ids, codes = self._pieces(numbered.dictionary.to_pylist()), numbered.indices.to_numpy()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        counts, starts = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
        ends = np.cumsum(counts)
        places = np.repeat(starts - (ends - counts), counts)
        places += np.arange(len(places))
        flat = np.frombuffer(b"".join(ids), "<u4")[places].tobytes()
        bounds = 4 * np.concatenate([np.zeros(1, np.int64), ends])[pieces.offsets.to_numpy()]
        return [flat[a:b] for a, b in pairwise(bounds.tolist())]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces. A piece is a unit too, so the cache and its bound are those of ``kept``."""
        ids = [self.kept.get(p) if p else b"" for p in pieces]
        new = [k for k, i in enumerate(ids) if i is None]
        for first in range(0, len(new), MERGED_PIECES):
            some = new[first : first + MERGED_PIECES]
            for k, i in zip(some, self._merged([pieces[k] for k in some]), strict=True):
                ids[k] = i
                if len(self.kept) < self.kept.most:
                    self.kept[pieces[k]] = i
        return ids

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces by one call of the library's merge model."""
        letters, _ = codecs.charmap_decode(" ".join(pieces).encode(), "strict", BYTES_BUT_SPACE)
        ids = np.array(self.merger.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<u4")
        flat, ends = ids.tobytes(), 4 * (np.flatnonzero(self.last[ids]) + 1)
        return [flat[a:b] for a, b in pairwise([0, *ends.tolist()])]


class ByteLengths(_Encoder):
    """Token counts of whole texts; a unit is a word with the space or the newline before it."""

    def __init__(self, path: str):
        super().__init__(path)
        self.units = "ByteLevel" in self.layout and "Split" not in self.layout and "Lowercase" not in self.layout
        self.newline = len(self.merged("\n"))
        self.kept = _Kept(self._unit)

    def _unit(self, unit: str) -> int:
        text = unit if unit[:1] == "\n" else " " + unit
        return sum(len(self.merged(piece)) for piece in BYTE_PATTERN.findall(text))

    @staticmethod
    def split(text: str) -> list[str]:
        """Units of a text without odd spaces; as if a newline stood before it."""
        return ("\n" + text.replace("\n", " \n")).split(" ")

    def regular(self, text: str) -> bool:
        return self.units and text[:1] not in ("", " ", "\n") and ODD_SPACES.search(text) is None and self.plain(text)

    def __call__(self, text: str) -> int:
        if self.regular(text):
            return sum(map(self.kept.__getitem__, self.split(text))) - self.newline
        return len(self.library_ids(text))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One encoder with its cache for each worker and vocabulary."""
    return WordIds(path)
