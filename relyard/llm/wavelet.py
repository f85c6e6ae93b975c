"""Wavelet matrix: a token sequence as bit-planes, most significant first, with rank and select.

Each plane holds one bit per token; after a plane the tokens are dealt stably into zeros and ones. Token access, counting and the place of
the k-th occurrence each take one step per plane. The file form is one block of bytes:
``WVM1``, token count, planes, document count (little-endian 64-bit), the zeros of each plane, then a zstd frame each for
document ids, their null marks, document lengths, every plane's bits, and every plane's rank directory (ones before each block of
512 bits).
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import zstandard

MAGIC = b"WVM1"
BLOCK_BITS = 512


class Plane:
    """One bit-plane with a rank directory."""

    def __init__(self, packed: np.ndarray, n: int, ones: np.ndarray | None = None):
        self.packed, self.n = packed, n
        if ones is None:
            per_block = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK_BITS // 8), dtype=np.int64) if n else np.zeros(0, np.int64)
            ones = np.cumsum(per_block) - per_block
        self.ones = ones

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n, bitorder="little").view(bool)

    def bit(self, i: int) -> int:
        return int(self.packed[i >> 3]) >> (i & 7) & 1

    def rank1(self, i: int) -> int:
        """Ones before position i."""
        if i <= 0:
            return 0
        block = min(i // BLOCK_BITS, len(self.ones) - 1)
        first = block * BLOCK_BITS // 8
        whole = int(np.bitwise_count(self.packed[first : i >> 3]).sum())
        rest = int(self.packed[i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0
        return int(self.ones[block]) + whole + rest

    def rank(self, bit: int, i: int) -> int:
        return self.rank1(i) if bit else i - self.rank1(i)

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit."""
        starts = np.arange(len(self.ones)) * BLOCK_BITS
        before = self.ones if bit else starts - self.ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        first = block * BLOCK_BITS
        part = np.unpackbits(self.packed[first >> 3 : (first + BLOCK_BITS) >> 3], bitorder="little")[: self.n - first]
        return first + int(np.flatnonzero(part == bit)[k - int(before[block])])


class WaveletMatrix:
    def __init__(self, planes: Sequence[Plane], zeros: Sequence[int], n: int, doc_ids: Sequence[int | None], lengths: np.ndarray):
        self.planes, self.zeros, self.n = list(planes), list(zeros), n
        self.doc_ids, self.lengths = list(doc_ids), np.asarray(lengths, np.int64)

    @classmethod
    def of(cls, ids: np.ndarray, doc_ids: Sequence[int | None] = (), lengths: Sequence[int] = ()) -> WaveletMatrix:
        n, top = len(ids), int(ids.max()) if len(ids) else 0
        now = ids.astype(np.uint16 if top < 1 << 16 else np.uint32)
        planes, zeros = [], []
        for shift in range(max(1, top.bit_length()) - 1, -1, -1):
            bit = (now >> shift & 1).astype(bool)
            planes.append(Plane(np.packbits(bit, bitorder="little"), n))
            low = now.compress(~bit)
            zeros.append(len(low))
            if shift:
                now = np.concatenate([low, now.compress(bit)])
        return cls(planes, zeros, n, doc_ids, np.asarray(lengths, np.int64))

    def decode(self) -> np.ndarray:
        """All tokens in order: the planes' dealing undone from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for shift, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            bit = plane.bits()
            before = np.empty_like(now)
            before[np.flatnonzero(~bit)] = now[:zeros]
            before[np.flatnonzero(bit)] = now[zeros:] | kind(1 << shift)
            now = before
        return now.astype("<u4")

    def access(self, i: int) -> int:
        value = 0
        for plane, zeros in zip(self.planes, self.zeros):
            bit = plane.bit(i)
            value = value << 1 | bit
            i = zeros + plane.rank1(i) if bit else i - plane.rank1(i)
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Places on the last level of the occurrences of a token before ``end``."""
        low, high = 0, end
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            bit = token >> len(self.planes) - 1 - level & 1
            shift = zeros if bit else 0
            low, high = shift + plane.rank(bit, low), shift + plane.rank(bit, high)
        return low, high

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token before position ``end``."""
        if token >> len(self.planes):
            return 0
        low, high = self._range(token, end)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, self.n)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> len(self.planes) - 1 - level & 1
            at = self.planes[level].select(bit, at - (self.zeros[level] if bit else 0))
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def to_bytes(self) -> bytes:
        press = zstandard.ZstdCompressor(level=1).compress
        marks = np.array([d is None for d in self.doc_ids], bool)
        ids = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        frames = [ids.tobytes(), marks.tobytes(), self.lengths.astype("<i8").tobytes()]
        frames += [p.packed.tobytes() for p in self.planes] + [p.ones.astype("<u4").tobytes() for p in self.planes]
        head = MAGIC + struct.pack("<3Q", self.n, len(self.planes), len(self.doc_ids)) + struct.pack(f"<{len(self.zeros)}Q", *self.zeros)
        return head + b"".join(struct.pack("<Q", len(f)) + f for f in map(press, frames))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, n_planes, n_docs = struct.unpack_from("<3Q", data, 4)
        zeros = struct.unpack_from(f"<{n_planes}Q", data, 28)
        at, frames, expand = 28 + 8 * n_planes, [], zstandard.ZstdDecompressor().decompress
        while at < len(data):
            (size,) = struct.unpack_from("<Q", data, at)
            frames.append(expand(data[at + 8 : at + 8 + size]))
            at += 8 + size
        ids, marks = np.frombuffer(frames[0], "<i8"), np.frombuffer(frames[1], bool)
        doc_ids = [None if gone else int(i) for i, gone in zip(ids[:n_docs], marks)]
        bits = [np.frombuffer(f, np.uint8) for f in frames[3 : 3 + n_planes]]
        ones = [np.frombuffer(f, "<u4").astype(np.int64) for f in frames[3 + n_planes :]]
        return cls([Plane(b, n, o) for b, o in zip(bits, ones)], zeros, n, doc_ids, np.frombuffer(frames[2], "<i8"))
