"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

# Words are runs without these bytes; A-Z count as a-z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII bytes but letters and digits.
MARKS = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])
_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def place_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, equal wherever the span stands; A-Z count as a-z."""
    up, down = place_tables(len(raw))
    total = np.cumsum(_BYTE[raw] * up[: len(raw)])
    return mixed((total[e - 1] - np.where(s > 0, total[s - 1], np.uint64(0))) * down[s])


def words(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and hash of each word; between: the bytes that part words, if not white space."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    space = (SPACE if between is None else between)[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets[:-1]] = True
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1] | edge[1:-1]
    ends[:-1] &= space[1:] | edge[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1, span_hashes(raw, s, e)


def shingles(text: np.ndarray, h: np.ndarray, n_texts: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each k-word shingle; a text with fewer words has its whole sequence as one."""
    counts = np.bincount(text, minlength=n_texts)
    first = np.cumsum(counts) - counts
    if len(h) >= k:
        at = np.flatnonzero(text[: len(h) - k + 1] == text[k - 1 :])
        out = np.zeros(len(at), np.uint64)
        for j in range(k):
            out += h[at + j] * _PLACES[j]
        found, hashes = text[at], mixed(out)
    else:
        found, hashes = text[:0], h[:0]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        out = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            out += np.where(counts[short] > j, h[np.minimum(first[short] + j, len(h) - 1)], np.uint64(0)) * _PLACES[j]
        out += counts[short].astype(np.uint64) * _PLACES[40]
        found, hashes = np.concatenate([found, short]), np.concatenate([hashes, mixed(out)])
    return found, hashes


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each text's distinct shingles, sorted by both."""
    _, _, text, h = words(raw, offsets)
    found, hashes = shingles(text, h, len(offsets) - 1, k)
    order = np.argsort(hashes)
    by_text = found[order]
    order = order[np.argsort(by_text.astype(np.uint16) if len(offsets) <= 1 << 16 else by_text, kind="stable")]  # 16 bits are sorted by radix
    found, hashes = found[order], hashes[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (hashes[1:] != hashes[:-1])
    return found[keep], hashes[keep]
