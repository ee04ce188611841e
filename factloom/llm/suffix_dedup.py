"""Suffix-array dedup: bytes covered by a LENGTH-byte string that also starts in a document with a smaller doc_id are removed.

Every LENGTH-byte window has an anchor: its leftmost GRAM-byte gram of least hash. Equal windows have equal anchors at equal places,
so windows meet by anchor. Neighbouring windows with one anchor are one segment, LENGTH - 1 bytes longer than their number.

1. Texts are packed into blobs of about BLOB bytes, once, in a table; each text has a SHA-256 of its own. Of equal texts only those
   with the least doc_id go on: the others are removed whole, if they have a window at all, and could remove nothing more.
2. Anchors that occur in two documents or more are found from short hashes of the anchors, dealt by hash.
3. A blob sends each distinct segment with such an anchor once, with its least doc_id, to the anchor's part. The windows of an anchor
   in more than HOT blobs are dealt by a longer string around the anchor instead, of which each window holds one: the anchor with the
   13 bytes after it, or with the 14 before it. So a common phrase is parted by what stands beside it.
4. A part compares the bytes of an anchor's segments. Different ones are concatenated, their suffixes sorted, and intervals of
   suffixes with a common prefix are expanded breadth first: extending the intervals of value v backward, by the Burrows-Wheeler
   transform's bytes, gives those of value v + 1. It stops at LENGTH; suffixes that are then still together share that much. Equal
   ones are one interval from the start. What has a smaller doc_id elsewhere goes back to the blobs.
5. Blobs mark and count what is removed.

Hashes only deal: segments are compared as bytes within a blob and in a part. A whole equal text is known by its SHA-256. A task holds
a blob, or one part: the segments of about PART_BYTES of text, at every size. An anchor's group holds a segment a blob at least where
all blobs have it, so on a far larger corpus blobs (and executors) should be larger too.

Defined results: a null text is empty; a null doc_id counts as larger than any; rows that share a doc_id do not remove each
other's bytes; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.blobs import DEALT, REPLY, Parts, answers, coded, dealt_rows, decoded, key_rows, packed, shared_keys, unpacked
from factloom.llm.shared import slices, text_bytes, written
from factloom.llm.words import mixed, place_tables

LENGTH, GRAM = 50, 24
WINDOW = LENGTH - GRAM + 1
#: Bytes beside a hot anchor: a window holds the anchor with AFTER bytes after it, or else with BEFORE bytes before it.
AFTER = (LENGTH - GRAM) // 2
BEFORE = LENGTH - GRAM - AFTER + 1
BLOB = 2 << 20
HOT = 512
SALTS = 32
#: Bytes of segments that are sorted together; an anchor's segments are never parted.
TOGETHER = 1 << 19
_VALUE = np.random.default_rng(77001).integers(1, 1 << 63, 256, dtype=np.uint64)
_NONE = np.iinfo(np.int64).max


class Segments:
    """Segments of a blob's texts: start, run (windows), gram (place of the anchor), anchor (hash), doc (row of its text)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.raw, n = raw, len(raw)
        none = np.zeros(0, np.int64)
        self.start, self.run, self.doc, self.gram, self.anchor = none, none, none, none, none.astype(np.uint64)
        if n < LENGTH:
            return
        up, self.down = place_tables(n + 1)
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[raw] * up[:n])])
        grams = (self.total[GRAM:] - self.total[:-GRAM]) * self.down[: n - GRAM + 1]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        # The hash's upper bits and the place in one number, so that the least is the leftmost of the least.
        low = np.uint64((1 << n.bit_length()) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while width < WINDOW:
            step = min(width, WINDOW - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        place = (least & low).astype(np.int64)
        ends = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
        starts = np.flatnonzero(np.arange(len(place)) + LENGTH <= ends)
        if not len(starts):
            return
        at = place[starts]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        self.start, self.gram = starts[first], at[first]
        self.run = np.diff(np.concatenate([first, [len(starts)]]))
        self.anchor = mixed(grams[self.gram])  # leasts are small numbers; mixed, they deal evenly
        self.doc = np.searchsorted(offsets, self.start, "right") - 1

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mixed((self.total[at + size] - self.total[at]) * self.down[at] + np.asarray(size).astype(np.uint64))

    def chosen(self, shared: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, run, doc and key of the shared segments; a hot one is dealt as up to two, by what is before and after its anchor."""
        whole, parted = np.flatnonzero(shared & ~hot), np.flatnonzero(shared & hot)
        start, stop, gram = self.start[parted], self.start[parted] + self.run[parted], self.gram[parted]
        middle = np.clip(gram - BEFORE + 1, start, stop)  # windows from here on hold AFTER bytes after the anchor
        left, right = np.flatnonzero(middle > start), np.flatnonzero(stop > middle)
        starts = np.concatenate([self.start[whole], start[left], middle[right]])
        runs = np.concatenate([self.run[whole], (middle - start)[left], (stop - middle)[right]])
        docs = np.concatenate([self.doc[whole], self.doc[parted][left], self.doc[parted][right]])
        keys = np.concatenate([self.anchor[whole], self.hashes(gram[left] - BEFORE, GRAM + BEFORE), self.hashes(gram[right], GRAM + AFTER)])
        return starts, runs, docs, keys


def gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return raw[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def as_first(raw: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the bytes of each span are those of the span at first[k]."""
    same = size == size[first]
    where = np.flatnonzero(same & (first != np.arange(len(first))))
    for some in np.array_split(where, max(1, int(size[where].sum()) >> 22)):
        if len(some):
            n = size[some]
            equal = gathered(raw, start[some], n) == gathered(raw, start[first[some]], n)
            same[some] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return same


class Blob:
    """An opened blob; its copies (texts that an earlier document has whole) are left out of raw, offsets and docs."""

    def __init__(self, texts: bytes, copies: list[int] | None) -> None:
        self.docs, self.nulls, self.offsets, self.all = unpacked(texts)
        self.copy = np.zeros(len(self.docs), bool)
        self.copy[copies or []] = True
        sizes = np.diff(self.offsets)
        self.raw = self.all[np.repeat(~self.copy, sizes)] if self.copy.any() else self.all
        self.starts = np.concatenate([[0], np.cumsum(sizes[~self.copy])])
        self.ids = self.docs[~self.copy]
        self.segments = Segments(self.raw, self.starts)

    def items(self, replies: list[dict], parts: Parts) -> None:
        """Occurrences (start, doc, of: their item) and distinct items (first: an occurrence, run, key, low) sorted by key."""
        seg = self.segments
        shared, hot = answers(replies)
        _, at = np.unique(parts.short(seg.anchor), return_inverse=True)
        start, run, doc, key = seg.chosen(shared[at], hot[at])
        size, doc_id = run + LENGTH - 1, self.ids[doc]
        own, key = seg.hashes(start, size), parts.short(key)
        order = np.lexsort((start, doc_id, own, key))
        start, run, doc, key, own = start[order], run[order], doc[order], key[order], own[order]
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])])[: len(own)]
        # One hash, other bytes: an item of its own.
        fresh |= ~as_first(self.raw, start, size[order], np.flatnonzero(fresh)[np.cumsum(fresh) - 1])
        self.start, self.doc, self.of = start, doc, np.cumsum(fresh) - 1
        self.first = np.flatnonzero(fresh)
        self.run, self.key = run[self.first], key[self.first]
        self.low = np.full(len(self.first), _NONE, np.int64)
        np.minimum.at(self.low, self.of, self.ids[doc])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in slices(batch, "text", BLOB):
            raw, offsets = text_bytes(part.column("text"))
            ids = part.column("doc_id").cast(pa.int64())
            docs = ids.fill_null(_NONE).to_numpy(zero_copy_only=False)
            data = packed(docs, np.asarray(ids.is_null()), offsets, raw, level=5)
            places = np.flatnonzero(np.diff(offsets) >= LENGTH)
            marks = b"".join(hashlib.sha256(raw[offsets[p] : offsets[p + 1]]).digest() for p in places.tolist())
            names = packed(places, docs[places], np.frombuffer(marks, np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + seq], pa.int64()), pa.array([len(raw)], pa.int64()), *(pa.array([x], pa.binary()) for x in (data, names))], ["blob", "size", "texts", "names"])
            seq += 1


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """blob, place, doc, mark (SHA-256) of each text that is long enough for a window."""
    for batch in batches:
        for blob, names in zip(batch.column("blob").to_pylist(), batch.column("names"), strict=True):
            places, docs, marks = unpacked(names.as_py())
            marks = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(places), [None, pa.py_buffer(marks.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), blob)), pa.array(places), pa.array(docs), marks.cast(pa.binary())], ["blob", "place", "doc", "mark"])


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Values of some columns, one row in memory at a time."""
    for batch in batches:
        for row in range(batch.num_rows):
            yield tuple(batch.column(c)[row].as_py() for c in columns)


def _anchors(parts: Parts):
    """part, blob, data: the distinct anchors of a blob, and whether two of its documents have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, texts, copies in _rows(batches, "blob", "texts", "copies"):
            blob = Blob(texts, copies)
            yield from key_rows(name, blob.segments.anchor, blob.ids[blob.segments.doc], parts)

    return run


def _segments(parts: Parts):
    """part, blob, data: keys, least doc_ids, runs and bytes of the blob's distinct shared segments, in the order of Blob.items()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, texts, copies, replies in _rows(batches, "blob", "texts", "copies", "replies"):
            blob = Blob(texts, copies)
            blob.items(replies, parts)
            base = blob.low.min(initial=_NONE)
            span = int(blob.low.max(initial=base)) - int(base)
            low = (blob.low - base).astype(np.uint16 if span < 1 << 16 else np.uint32 if span < 1 << 32 else np.int64)
            start = blob.start[blob.first]
            make = lambda s: packed(*coded(blob.key[s]), np.array([base]), low[s], blob.run[s].astype(np.uint8), gathered(blob.raw, start[s], blob.run[s] + LENGTH - 1), level=3)  # noqa: B023, E731
            yield from dealt_rows(name, parts.cuts(blob.key), make)

    return run


def sorted_suffixes(text: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
    """Suffix array of text (byte + 1, and 0 at each segment's end; end: where that is), by prefix doubling; ties by place."""
    n, h = len(text), 7
    padded = np.concatenate([text, np.zeros(h, np.int64)]).astype(np.uint64)
    key, live = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(h):
        key = (key << np.uint64(9)) | np.where(live, padded[j : j + n], np.uint64(0))
        live &= padded[j : j + n] > 0
    sa = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[sa][1:] != key[sa][:-1]])
    slot = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[sa] = slot[np.cumsum(new) - 1] + 1
    while h < longest:
        size = np.diff(np.concatenate([slot, [n]]))
        tied = np.repeat(size > 1, size)  # in the order of sa
        where = np.flatnonzero(tied)
        if not len(where):
            break
        items = sa[where]
        after = items + h
        second = np.where(after <= end[items], rank[np.minimum(after, n - 1)], 0)
        key = rank[items] * (n + 2) + second
        order = np.argsort(key, kind="stable")
        sa[where] = items[order]
        key = key[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[items[order]] = where[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] + 1
        new[where] = fresh
        slot = np.flatnonzero(new)
        h *= 2
    return sa


def classes(text: np.ndarray, end: np.ndarray, longest: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and class of each suffix in it: suffixes of one class share `length` bytes.

    parted[p] tells that the suffixes at p - 1 and p differ within the value reached so far. Value v + 1 follows from v by backward
    extension: the two are the byte text[sa[p]] before the suffixes at next[p - 1] and next[p], and they part where the byte differs
    or where a boundary of value v lies between those two. Each boundary is derived once, at its own value.
    """
    n = len(text)
    sa = sorted_suffixes(text, end, longest)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    byte = text[sa]
    follow = place[np.minimum(sa + 1, n - 1)]
    parted = np.ones(n, bool)
    parted[1:] = (byte[1:] != byte[:-1]) | (byte[1:] == 0)
    fresh = np.flatnonzero(parted)
    open_ = np.flatnonzero(~parted)
    before, here = follow[open_ - 1].astype(np.int32), follow[open_].astype(np.int32)
    count = np.zeros(n, np.int32)
    for _ in range(length - 1):
        if not len(open_) or not len(fresh):
            break
        count[:] = 0
        count[fresh] = 1
        seen = np.cumsum(count, dtype=np.int32)
        split = seen[here] != seen[before]
        fresh = open_[split]
        parted[fresh] = True
        rest = ~split
        open_, before, here = open_[rest], before[rest], here[rest]
    return sa, np.cumsum(parted) - 1


def least_docs(segments: list[bytes], low: np.ndarray) -> list[np.ndarray]:
    """For each segment, the least doc_id of all segments that hold each of its windows."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    end = ends[owner]
    sa, group = classes(text, end, int(sizes.max()) + 1)
    window = end[sa] - sa >= LENGTH
    best = np.full(group[-1] + 1, _NONE, np.int64)
    np.minimum.at(best, group[window], low[owner[sa[window]]])
    result = np.empty(len(text), np.int64)
    result[sa] = best[group]
    return [result[e - n : e - LENGTH + 1] for e, n in zip(ends, sizes, strict=True)]


def _found(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """blob, part, data: for the items sent that a smaller doc_id has elsewhere, their places and their windows' least doc_ids."""
    blobs, cols = [], []
    for batch in batches:
        for blob, data in zip(batch.column("blob").to_pylist(), batch.column("data"), strict=True):
            blobs.append(blob)
            *code, base, low, run, raw = unpacked(data.as_py())
            cols.append((decoded(*code), low.astype(np.int64) + base[0], run, raw))
    meet, low, run, raw = (np.concatenate(x) for x in zip(*cols, strict=True))
    ends = np.cumsum([len(c[0]) for c in cols])
    del cols
    run = run.astype(np.int64)
    size = run + LENGTH - 1
    place, at = np.cumsum(size) - size, np.cumsum(run) - run
    order = np.argsort(meet, kind="stable")
    change = np.concatenate([[True], meet[order][1:] != meet[order][:-1]])
    first = np.flatnonzero(change)
    stops = np.concatenate([first[1:], [len(order)]])
    # Equal bytes under one key are one class, and so are their windows.
    leader = np.empty(len(order), np.int64)
    leader[order] = order[np.repeat(first, stops - first)]
    alone = np.logical_and.reduceat(as_first(raw, place, size, leader)[order], first)
    value = np.empty(len(order), np.int64)
    value[order] = np.repeat(np.minimum.reduceat(low[order], first), stops - first)
    best = np.repeat(value, run)
    waiting: list[np.ndarray] = []
    total = 0

    def search() -> None:
        """Expand the intervals of the different segments that wait, and hand their values to all equal segments."""
        items = np.concatenate(waiting)
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(raw[p : p + n].tobytes(), len(known)) for p, n in zip(place[items].tolist(), size[items].tolist(), strict=True)])
        lows = np.full(len(known), _NONE, np.int64)
        np.minimum.at(lows, which, low[items])
        values = least_docs(list(known), lows)
        for begin, n, k in zip(at[items].tolist(), run[items].tolist(), which.tolist(), strict=True):
            best[begin : begin + n] = values[k]
        waiting.clear()

    for a, b in zip(first[~alone].tolist(), stops[~alone].tolist(), strict=True):
        waiting.append(order[a:b])
        total += int(size[order[a:b]].sum())
        if total > TOGETHER:
            search()
            total = 0
    if waiting:
        search()
    removes = np.minimum.reduceat(best, at) < low
    part = key[0].as_py()
    for blob, a, b in zip(blobs, [0, *ends], ends, strict=False):
        items = np.flatnonzero(removes[a:b])
        if len(items):
            data = packed(np.array([b - a]), items, gathered(best, at[items + a], run[items + a]))
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.int64()), pa.array([part], pa.int64()), pa.array([data], pa.binary())], ["blob", "part", "data"])


def _removed(texts: bytes, copies: list[int] | None, replies: list[dict] | None, found: list[dict] | None, parts: Parts) -> tuple[Blob, np.ndarray]:
    """The blob, and which of its bytes go."""
    blob = Blob(texts, copies)
    gone = np.repeat(blob.copy, np.diff(blob.offsets))
    if not replies:
        return blob, gone
    blob.items(replies, parts)
    at = np.cumsum(blob.run) - blob.run
    best = np.repeat(blob.low, blob.run)
    cuts = parts.cuts(blob.key)
    for r in found or []:
        _, items, values = unpacked(r["data"])
        items = items + cuts[r["part"]]
        n = blob.run[items]
        best[np.repeat(at[items] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = values
    n = blob.run[blob.of]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    goes = np.repeat(blob.ids[blob.doc], n) > best[np.repeat(at[blob.of], n) + inner]
    where = (np.repeat(blob.start, n) + inner)[goes]
    edges = np.zeros(len(blob.raw) + 1, np.int32)
    np.add.at(edges, where, 1)
    np.add.at(edges, where + LENGTH, -1)
    gone[~gone] = np.cumsum(edges)[:-1] > 0
    return blob, gone


def _result(batches: Iterator[pa.RecordBatch], parts: Parts, texts_too: bool) -> Iterator[pa.RecordBatch]:
    for values in _rows(batches, "texts", "copies", "replies", "found"):
        blob, gone = _removed(*values, parts)
        offsets, raw = blob.offsets, blob.all
        before = np.concatenate([[0], np.cumsum(gone)])
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        edge[heads] = gone[heads]
        spans = np.concatenate([[0], np.cumsum(edge)])
        kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
        columns = [pa.array(blob.docs, pa.int64(), mask=blob.nulls), pa.array(np.diff(offsets)), pa.array(np.diff(before[offsets])), pa.array(np.diff(spans[offsets])), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if texts_too:
            columns.append(pa.array([k.decode("utf-8", "replace") for k in kept]))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(columns, names)


def remove_repeats(docs: DataFrame, texts_too: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the text that is left (a cut character is replaced)."""
    blobs = written(docs.select("doc_id", "text").mapInArrow(_pack, "blob long, size long, texts binary, names binary"), "blobs")
    parts = Parts.of(blobs.agg(F.sum("size")).first()[0])
    texts = blobs.select("blob", "texts")  # dealt by blob once: the three joins share that exchange, and hash the small side
    named = blobs.select("blob", "names").mapInArrow(_named, "blob long, place long, doc long, mark binary")
    first = named.groupBy("mark").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where(F.col("first") < F.col("last")).select("mark", "first")
    # A text that very many documents have is joined in SALTS tasks.
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = named.withColumn("salt", F.pmod(F.xxhash64("blob", "place"), F.lit(SALTS)).cast("int")).join(salted, ["mark", "salt"]).where(F.col("doc") > F.col("first")).groupBy("blob").agg(F.collect_list("place").alias("copies"))
    with_copies = texts.join(copies.hint("shuffle_hash"), "blob", "left")

    def answered(dealt: DataFrame, by, name: str) -> DataFrame:
        return dealt.groupBy("part").applyInArrow(by, REPLY).groupBy("blob").agg(F.collect_list(F.struct("part", "data")).alias(name)).hint("shuffle_hash")

    replies = answered(with_copies.mapInArrow(_anchors(parts), DEALT), shared_keys(HOT), "replies")
    found = answered(with_copies.join(replies, "blob").mapInArrow(_segments(parts), DEALT), _found, "found")
    final = with_copies.join(replies, "blob", "left").join(found, "blob", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * texts_too
    return final.mapInArrow(lambda batches: _result(batches, parts, texts_too), schema)
