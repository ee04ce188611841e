"""Rows that hold many documents as packed arrays, and the keys that several documents share.

A blob is named once, when its table is written. Its distinct keys are dealt to parts by hash, as short as the number of all keys
allows and in the coding of sorted numbers below; a part answers with bits, in the order of the keys that it was sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

#: Bytes of text for each part that keys are dealt to, at every size.
PART_BYTES = 24 << 20
#: Bits of a key beyond those that number all bytes of text: keys that are equal by chance are few, and bytes or sets decide later.
SPARE_BITS = 8
REPLY = "blob long, part long, data binary"
DEALT = "part long, blob long, data binary"


@dataclass(frozen=True)
class Parts:
    """How many parts there are and how many bits of a key are sent, by the bytes of all texts."""

    n: int
    bits: int

    @classmethod
    def of(cls, n_bytes: int | None) -> Parts:
        return cls(max(1, -(-(n_bytes or 0) // PART_BYTES)), min(56, max(32, int(n_bytes or 1).bit_length() + SPARE_BITS)))

    def short(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - self.bits)

    def cuts(self, ordered: np.ndarray) -> np.ndarray:
        """Where each part begins in sorted short keys, and their number."""
        edges = (np.arange(self.n + 1, dtype=object) << self.bits) // self.n
        inner = np.searchsorted(ordered, edges[1:-1].astype(np.uint64)) if self.n > 1 else np.zeros(0, np.int64)
        return np.concatenate([[0], inner, [len(ordered)]])


def packed(*arrays: np.ndarray, level: int = 1) -> bytes:
    """The arrays, each with its type and length, as one zstandard frame."""
    head = np.array([x for a in arrays for x in (ord(a.dtype.char), a.dtype.itemsize, len(a))], np.int64)
    return zstandard.compress(np.int64(len(arrays)).tobytes() + head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), level)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3), 8 + 24 * n, []
    for char, size, length in head.tolist():
        out.append(np.frombuffer(raw, np.dtype(chr(char)), length, at))
        at += size * length
    return out


def coded(x: np.ndarray) -> list[np.ndarray]:
    """Sorted numbers below 2^62 in about 2 + log2(span / n) bits each: low bits side by side, the others as gaps between set bits."""
    n = len(x)
    if not n:
        return [np.zeros(2, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(1, np.uint64)]
    y = x - x[0]
    k = max(0, (int(y[-1]) // n).bit_length() - 1)
    width = 4 if k <= 32 else 8
    low = (y & np.uint64((1 << k) - 1)).astype(f"<u{width}").view(np.uint8).reshape(n, width)
    high = (y >> np.uint64(k)).astype(np.int64) + np.arange(n)
    marks = np.zeros(high[-1] + 1, np.uint8)
    marks[high] = 1
    return [np.array([n, k]), np.packbits(np.unpackbits(low, axis=1, bitorder="little")[:, :k]), np.packbits(marks), x[:1].astype(np.uint64)]


def decoded(head: np.ndarray, low: np.ndarray, marks: np.ndarray, first: np.ndarray) -> np.ndarray:
    n, k = head.tolist()
    if not n:
        return np.zeros(0, np.uint64)
    width = 4 if k <= 32 else 8
    wide = np.zeros((n, 8 * width), np.uint8)
    wide[:, :k] = np.unpackbits(low, count=n * k).reshape(n, k)
    small = np.packbits(wide, axis=1, bitorder="little").view(f"<u{width}").ravel().astype(np.uint64)
    high = (np.flatnonzero(np.unpackbits(marks))[:n] - np.arange(n)).astype(np.uint64)
    return first[0] + (high << np.uint64(k)) + small


def dealt_rows(blob: int, cuts: np.ndarray, make: Callable[[slice], bytes]) -> Iterator[pa.RecordBatch]:
    """A row for each part that has some of the items; make(its slice of them) gives its payload."""
    keys = np.flatnonzero(np.diff(cuts)).tolist()
    if keys:
        data = [make(slice(int(cuts[p]), int(cuts[p + 1]))) for p in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([blob] * len(keys), pa.int64()), pa.array(data, pa.binary())], ["part", "blob", "data"])


def key_rows(blob: int, keys: np.ndarray, docs: np.ndarray, parts: Parts) -> Iterator[pa.RecordBatch]:
    """part, blob, data: the blob's distinct short keys, and whether two of its documents have them."""
    if not len(keys):
        return
    keys = parts.short(keys)
    order = np.lexsort((docs, keys))
    h, d = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    last = np.concatenate([first[1:], [len(h)]]) - 1
    h, several = h[first], d[first] != d[last]
    yield from dealt_rows(blob, parts.cuts(h), lambda s: packed(*coded(h[s]), np.packbits(several[s])))


def shared_keys(most: int) -> Callable:
    """applyInArrow function: for each blob's keys, whether several documents have them, and whether more than `most` blobs do."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, hashes, several = [], [], []
        for batch in batches:
            for blob, data in zip(batch.column("blob").to_pylist(), batch.column("data"), strict=True):
                *code, flags = unpacked(data.as_py())
                blobs.append(blob)
                hashes.append(decoded(*code))
                several.append(np.unpackbits(flags, count=len(hashes[-1])))
        h, s = np.concatenate(hashes), np.concatenate(several)
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        count = np.diff(np.concatenate([first, [len(h)]]))
        found, hot = np.empty(len(h), bool), np.empty(len(h), bool)
        found[order] = np.repeat((count > 1) | (np.maximum.reduceat(s[order], first) > 0), count)
        hot[order] = np.repeat(count > most, count)
        cuts = np.cumsum([0, *map(len, hashes)])
        rows = [packed(np.array([b - a]), np.packbits(found[a:b]), np.packbits(hot[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        part = key[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.int64()), pa.array([part] * len(blobs), pa.int64()), pa.array(rows, pa.binary())], ["blob", "part", "data"])

    return run


def answers(replies: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Shared, and hot, of a blob's distinct short keys in ascending order."""
    rows = [unpacked(r["data"]) for r in sorted(replies, key=lambda r: r["part"])]
    return tuple(np.concatenate([np.unpackbits(r[k], count=int(r[0][0])) for r in rows]).astype(bool) for k in (1, 2))
