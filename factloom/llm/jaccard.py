"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.8 or more, and the groups they form.

1. Documents with equal sets become one class, named by a 64-bit hash of the set; its representative is the row with the smallest
   doc_id.
2. All documents use one order of shingles: by a sketch of their frequency (a fixed number of counters over the whole corpus), then by
   hash. Two sets as similar as that share k of their first n - ceil(0.8 n) + k shingles, in any order; this order keeps shingles of
   passages that many documents share out of those prefixes.
3. Representatives whose sizes allow a link and that share a prefix shingle meet in the group of the smallest of them (its centre).
   Each document is in few groups, however many shingles it shares. Shingles that one document alone has are sorted out first, as
   packed hashes. With prefixes longer by n / 20, two similar sets share at least min(n) / 20 + 1 of those shingles, so a document
   that shares fewer with all others together, as one with a common passage does, is in no group.
4. In a group a T-occurrence search (DivideSkip) finds the partners: the long inverted lists are set aside, the short ones are
   merged by counting, what occurs often enough there and is not in the same component yet is binary-probed in the long ones, all
   of them at once, and the exact overlap decides.
5. A group of more than BLOCK documents is split into blocks, each with the same few pivots. What is not in the group's largest
   component afterwards is searched in every block; two documents of one component need no comparison. What asks is split into
   blocks as well, and a task holds one of these and one block. So no link between components is lost, and no task holds a whole
   large group.

Shingles are 64-bit hashes. Defined results: without words or text a set is empty and the document is its own component; rows that
repeat a doc_id share its component, whatever their texts; a row with a null doc_id has none, but the documents that it links are in
one; an empty table gives no rows; extra columns are ignored. keep_one goes by rows: see there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.blobs import DEALT, REPLY, Parts, answers, key_rows, packed, shared_keys, unpacked
from factloom.llm.components import components
from factloom.llm.shared import salted_join, slices, text_bytes, whole_row, written
from factloom.llm.words import mixed, shingle_sets

#: Counters of the frequency sketch, over all documents at every size, and the parts that it is summed in.
COUNTERS, PARTS = 1 << 21, 32
BLOCK, PIVOTS = 1500, 16
SLICE = 1 << 20
#: Candidates whose ids are broadcast, once counted; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Documents that one task call searches at least: small groups are dealt together.
TOGETHER = 2000
#: DivideSkip's weight of merging against probing, the postings merged and the places probed at once.
MU, MERGED, PROBED = 0.5, 1 << 20, 1 << 18


def least_overlap(n: int) -> int:
    """ceil(0.8 n): what a set of n shingles shares at least with any set as similar as 0.8."""
    return (4 * n + 4) // 5


def sketch(docs: DataFrame) -> np.ndarray:
    """Counts of distinct shingles a document by their low bits, over all documents; sums stop at the largest uint32."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                _, h = shingle_sets(*text_bytes(part.column("text")))
                np.add.at(counts, (h & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
        if counts.any():
            size = COUNTERS // PARTS
            packed = [zstandard.compress(counts[k * size : (k + 1) * size].tobytes(), 1) for k in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(packed, pa.binary())], ["k", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS // PARTS, np.uint64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(zstandard.decompress(x.as_py()), np.uint32)
        out = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zstandard.compress(out, 1)], pa.binary())], ["k", "counts"])

    summed = docs.select("text").mapInArrow(count, "k int, counts binary").groupBy("k").applyInArrow(add, "k int, counts binary")
    out = np.zeros((PARTS, COUNTERS // PARTS), np.uint32)
    for r in summed.collect():  # PARTS rows of a fixed size
        out[r.k] = np.frombuffer(zstandard.decompress(bytes(r.counts)), np.uint32)
    return out.ravel()


def more_shared(n: np.ndarray) -> np.ndarray:
    """How many prefix shingles a set of n shares at least with a similar one of its size, given prefixes longer by as many."""
    return n // 20 + 1


def set_keys(n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A name for each set of n shingles: a 64-bit hash of its size and two sums."""
    first, out = np.cumsum(n) - n, n.astype(np.uint64)
    for x in (h, mixed(h ^ np.uint64(0x5851F42D4C957F2D))):
        total = np.concatenate([[np.uint64(0)], np.cumsum(x)])
        out = mixed(out ^ (total[first + n] - total[first]))
    return out.view(np.int64)


def text_mark() -> Column:
    """With doc_id it tells rows apart that repeat a doc_id or have none."""
    return F.xxhash64("text")


def prefix_blobs(docs: DataFrame) -> DataFrame:
    """blob, size (bytes of text), data: doc_ids, marks of the texts, n, names of the sets, lengths of the prefixes and their shingles, in the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(zstandard.compress(sketch(docs).tobytes(), 1))
    opened: list[np.ndarray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not opened:
            opened.append(np.frombuffer(zstandard.decompress(shared.value), np.uint32))
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                raw, offsets = text_bytes(part.column("text"))
                text, h = shingle_sets(raw, offsets)
                n = np.bincount(text, minlength=part.num_rows)
                first = np.cumsum(n) - n
                often = opened[0][(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
                order = np.argsort((text.astype(np.uint64) << np.uint64(32)) | often, kind="stable")  # of one count they stand by hash
                keep = np.minimum(n, n - (4 * n + 4) // 5 + more_shared(n))
                inside = np.arange(len(h)) - np.repeat(first, n) < np.repeat(keep, n)
                ids = part.column("doc_id").cast(pa.int64())
                data = packed(ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null()), part.column("mark").to_numpy(), n, set_keys(n, h), keep, h[order][inside])
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + seq], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([data], pa.binary())], ["blob", "size", "data"])
                seq += 1

    return docs.select("doc_id", "text", text_mark().alias("mark")).mapInArrow(run, "blob long, size long, data binary")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, mark, n, doc, blob, place of every row."""
    for batch in batches:
        for blob, data in zip(batch.column("blob").to_pylist(), batch.column("data"), strict=True):
            ids, nulls, marks, n, docs, _, _ = unpacked(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(marks), pa.array(n), pa.array(docs), pa.array(np.full(len(n), blob)), pa.array(np.arange(len(n)))], ["doc_id", "mark", "n", "doc", "blob", "place"])


def full_sets(docs: DataFrame) -> DataFrame:
    """doc, hashes: the name of each set and the whole sorted set; once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                text, h = shingle_sets(*text_bytes(part.column("text")))
                n = np.bincount(text, minlength=part.num_rows)
                ends, names, sets = np.cumsum(n), [], []
                for doc, b, m in zip(set_keys(n, h).tolist(), ends, n, strict=True):
                    if doc not in seen:
                        seen.add(doc)
                        names.append(doc)
                        sets.append(h[b - m : b].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["doc", "hashes"])

    return docs.select("text").mapInArrow(run, "doc long, hashes binary")


def divide_skip(sets: list[np.ndarray], queries: np.ndarray | None = None) -> np.ndarray:
    """Root of each set's component under links of 100 * shared >= 80 * united; queries: search these alone, against all."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")  # sets are named by their place in it
    sizes = sizes[order]
    ends = np.cumsum(sizes)
    tokens, token = np.unique(np.concatenate([sets[k] for k in order]) if m else np.zeros(0, np.uint64), return_inverse=True)
    lists = token * m + np.repeat(np.arange(m), sizes)
    lists.sort()  # inverted lists, one after another, each sorted by place
    postings = lists % max(1, m)
    lengths = np.bincount(token, minlength=len(tokens))
    starts = np.cumsum(lengths) - lengths
    wanted = np.ones(m, bool) if queries is None else queries[order]
    label = np.arange(m)  # of the component so far
    longest = max(2, int(lengths.max(initial=0)))
    for at in np.flatnonzero(wanted).tolist():
        n = int(sizes[at])
        t = least_overlap(n)
        low = int(np.searchsorted(sizes, t))
        high = at if queries is None else int(np.searchsorted(sizes, n * 5 // 4, "right"))
        if not n or (label[low:high] == label[at]).all():
            continue
        mine = token[ends[at] - n : ends[at]]
        length = lengths[mine]
        if np.count_nonzero(length > 1) < t:  # other sets share too few of its shingles, taken together
            continue
        n_long = min(t - 1, int(t / (MU * math.log2(longest) + 1)))
        by_length = np.argsort(length, kind="stable")
        short, long = mine[by_length[: n - n_long]], np.sort(mine[by_length[n - n_long :]])
        count = np.zeros(m, np.int64)
        for some in np.split(short, np.flatnonzero(np.diff(np.cumsum(lengths[short]) // MERGED)) + 1):
            size = lengths[some]
            end = np.cumsum(size)
            count += np.bincount(postings[np.repeat(starts[some] - end + size, size) + np.arange(end[-1])], minlength=m)
        found = low + np.flatnonzero((count[low:high] >= t - n_long) & (label[low:high] != label[at]))
        found = found[np.argsort(-count[found], kind="stable")]
        step = 1
        while len(found):
            probe, found = found[:step], found[step:]
            step = max(1, min(step * 2, PROBED // max(1, n_long)))
            asked = (long[:, None] * m + probe).ravel()
            held = lists[np.minimum(np.searchsorted(lists, asked), len(lists) - 1)] == asked
            shared = count[probe] + held.reshape(n_long, len(probe)).sum(axis=0)
            near = probe[100 * shared >= 80 * (n + sizes[probe] - shared)]
            if len(near):
                label[np.isin(label, label[near])] = label[at]
                found = found[label[found] != label[at]]
    _, least, component = np.unique(label[np.argsort(order)], return_index=True, return_inverse=True)
    return least[component]


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges (a, b) within each centre's rows; rows with asks are queries where any row has."""
    out = []
    for _, g in rows.groupby("center", sort=False):
        g = g.drop_duplicates("doc")  # rows with one name have one set
        docs = g["doc"].to_numpy()
        asks = g["asks"].to_numpy(bool)
        sets = [np.frombuffer(x, np.uint64) for x in g["hashes"]]
        roots = divide_skip(sets, asks if g["second"].iloc[0] else None)
        far = roots != np.arange(len(roots))
        out.append(pd.DataFrame({"a": docs[far], "b": docs[roots[far]]}))
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")


def _searched(members: DataFrame, sets: DataFrame, second: bool) -> DataFrame:
    """Edges from members (center, asking, block, doc, asks), with sets joined to them."""
    members = written(members, "members")  # counted and joined: made once
    n = members.count()
    tasks = max(1, n // TOGETHER)
    dealt = members.join(sets, "doc").withColumn("deal", F.when(F.col("block") < 0, F.pmod(F.xxhash64("center"), F.lit(tasks))).otherwise(-1 - F.pmod(F.xxhash64("center", "asking", "block"), F.lit(1 << 40))))
    return dealt.withColumn("second", F.lit(second)).groupBy("deal").applyInPandas(_search, "a long, b long")


def _banded(tokens: np.ndarray, n: np.ndarray, down: int) -> np.ndarray:
    """Keys of prefix shingles by their set's size band: sets that can be similar are in one band or in neighbouring ones."""
    band = np.floor(np.log(np.maximum(n, 1)) / np.log(1.2500001)).astype(np.int64) - down
    return mixed(tokens ^ mixed((band + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _keys(data: bytes, places: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, document, size and side (own band, band below) of the prefix shingles of the documents at some places."""
    _, _, _, n, docs, sizes, tokens = unpacked(data)
    chosen = np.zeros(len(docs), bool)
    chosen[places] = True
    inside = np.repeat(chosen, sizes)
    docs, n, tokens = np.repeat(docs, sizes)[inside], np.repeat(n, sizes)[inside], tokens[inside]
    side = np.repeat([0, 1], len(docs))
    return np.concatenate([_banded(tokens, n, 0), _banded(tokens, n, 1)]), np.concatenate([docs, docs]), np.concatenate([n, n]), side


def _entries(parts: Parts):
    """key, doc of the keys that several documents have, of documents that share as many as a partner would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, places, replies in zip(batch.column("data"), batch.column("places"), batch.column("replies"), strict=True):
                keys, docs, n, side = _keys(data.as_py(), places.as_py())
                _, at = np.unique(parts.short(keys), return_inverse=True)
                found = answers(replies.as_py())[0][at]
                keys, docs, n, side = keys[found], docs[found], n[found], side[found]
                _, who, count = np.unique(np.stack([docs, side]), axis=1, return_inverse=True, return_counts=True)
                enough = count[who.ravel()] >= more_shared((4 * n + 4) // 5)
                yield pa.RecordBatch.from_arrays([pa.array(keys[enough].view(np.int64)), pa.array(docs[enough])], ["key", "doc"])

    return run


def _pairs(blobs: DataFrame, reps: DataFrame) -> DataFrame:
    """center, doc: the representatives that share a key, with the smallest of them."""
    parts = Parts.of(blobs.agg(F.sum("size")).first()[0])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, data, places in zip(batch.column("blob").to_pylist(), batch.column("data"), batch.column("places"), strict=True):
                keys, docs, _, _ = _keys(data.as_py(), places.as_py())
                yield from key_rows(blob, keys, docs, parts)

    ours = blobs.join(reps.groupBy("blob").agg(F.collect_list("place").alias("places")), "blob").select("blob", "data", "places")
    replies = ours.mapInArrow(dealt, DEALT).groupBy("part").applyInArrow(shared_keys(1 << 62), REPLY).groupBy("blob").agg(F.collect_list(F.struct("part", "data")).alias("replies"))
    entries = written(ours.join(replies, "blob").select("data", "places", "replies").mapInArrow(_entries(parts), "key long, doc long"), "entries")
    centers = entries.groupBy("key").agg(F.min("doc").alias("center"), F.max("doc").alias("last")).where(F.col("center") < F.col("last")).drop("last")
    return written(entries.join(centers, "key").select("center", "doc").distinct(), "pairs")


def _grouped(docs: DataFrame, by_id: bool) -> DataFrame:
    """doc_id, mark, n, component of every row; components of sets, named by one of them. by_id: those of one doc_id are linked too."""
    blobs = written(prefix_blobs(docs), "blobs")
    rows = blobs.mapInArrow(_named, "doc_id long, mark long, n long, doc long, blob long, place long")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark", "blob", "place")
    reps = rows.where(F.col("n") > 0).groupBy("doc").agg(F.min_by(row, row).alias("r"))
    reps = written(reps.select("doc", "r.doc_id", "r.mark", "r.blob", "r.place"), "reps")
    links = _links(docs, reps, _pairs(blobs, reps))
    if by_id:
        named = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "doc")
        least = named.groupBy("doc_id").agg(F.min("doc").alias("b"), F.max("doc").alias("last")).where(F.col("b") < F.col("last")).drop("last")
        links = links.union(named.join(least, "doc_id").where(F.col("doc") != F.col("b")).select(F.col("doc").alias("a"), "b"))
    groups = components(links).withColumnRenamed("node", "doc")
    return salted_join(rows, groups, "doc").select("doc_id", "mark", "n", F.coalesce("component", "doc").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    rows = written(_grouped(docs, True), "rows")
    named = rows.where(F.col("n") > 0).groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).where(F.col("size") > 1).drop("size")
    own = F.when((F.col("n") == 0) | F.col("least").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("least"))
    return salted_join(rows, named, "component").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _links(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    wanted = pairs.select("doc").distinct().join(reps, "doc").select(F.col("doc_id").alias("w_id"), F.col("mark").alias("w_mark")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = written(full_sets(docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (text_mark() == F.col("w_mark")), "left_semi")), "sets")
    # Large groups alone are named. Tables with a row each are broadcast once they are counted, so no group's rows move by their centre.
    size = written(pairs.groupBy("center").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK), "sizes")
    small = F.broadcast if size.count() <= BROADCAST_IDS else lambda table: table
    sized = pairs.join(small(size), "center", "left")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = sized.select("center", "doc", "m", F.when(F.col("m") > BLOCK, F.pmod(F.xxhash64("doc"), blocks).cast("int")).otherwise(-1).alias("block"), F.lit(True).alias("asks"))
    hot = members.where(F.col("block") >= 0)
    pivots = hot.groupBy("center", "m").agg(F.slice(F.sort_array(F.collect_set(F.when(F.pmod(F.xxhash64("doc"), F.greatest(F.lit(1), (F.col("m") / PIVOTS).cast("int"))) == 0, F.col("doc")))), 1, PIVOTS).alias("docs"))
    spread = pivots.select("center", "m", F.explode_outer("docs").alias("doc"), F.sequence(F.lit(0), F.ceil(F.col("m") / BLOCK).cast("int") - 1).alias("all")).select("center", "doc", "m", F.explode_outer("all").alias("block"), F.lit(True).alias("asks"))
    first = members.union(spread).select("center", F.lit(0).alias("asking"), "block", "doc", "asks").where(F.col("doc").isNotNull()).distinct()
    links = written(_searched(first, sets, False), "links")
    if not hot.limit(1).count():
        return links
    # Large groups: what is outside the largest component is searched in every block, a block of it at a time.
    at = components(links).withColumnRenamed("node", "doc")
    placed = written(hot.join(at, "doc", "left").select("center", "block", "doc", "m", F.coalesce("component", "doc").alias("component")), "placed")
    largest = placed.groupBy("center", "component").count().groupBy("center").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    rest = written(placed.join(small(largest), "center").where(F.col("component") != F.col("main")), "rest")
    n_asking = rest.groupBy("center").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_asking"))
    rest = rest.join(small(n_asking), "center").withColumn("asking", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("n_asking")).cast("int"))
    asking = rest.select("center", "asking", "doc", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / BLOCK).cast("int") - 1)).alias("block")).withColumn("asks", F.lit(True))
    held = placed.join(small(n_asking), "center").select("center", F.explode(F.sequence(F.lit(0), F.col("n_asking") - 1)).alias("asking"), "doc", "block").withColumn("asks", F.lit(False))
    again = asking.unionByName(held).groupBy("center", "asking", "block", "doc").agg(F.max("asks").alias("asks"))
    return written(links.union(_searched(again, sets, True)), "links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest doc_id, of several with it the one with the least mark of its
    text; one without doc_id where the component has no other. Rows that repeat doc_id and text stay once. Unlike in near_duplicates,
    a doc_id links nothing: its other texts stay if no row that is linked to them does. Rows without doc_id and words all stay."""
    rows = written(_grouped(docs, False), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    least = rows.where(F.col("n") > 0).groupBy("component").agg(F.min_by(order, order).alias("r")).select(F.col("r.doc_id").alias("kept_id"), F.col("r.mark").alias("kept_mark"), F.lit(False).alias("each"))
    empty = rows.where(F.col("n") == 0).select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark"), F.col("doc_id").isNull().alias("each")).distinct()
    kept = least.union(empty).select(F.struct("kept_id", "kept_mark", "each").alias("_kept"))
    plain = docs.select(whole_row(docs), F.col("doc_id").alias("_id"), text_mark().alias("_mark"))
    met = plain.join(kept, F.col("_id").eqNullSafe(F.col("_kept.kept_id")) & (F.col("_mark") == F.col("_kept.kept_mark")))
    once = met.withColumn("_nth", F.when(F.col("_kept.each"), F.monotonically_increasing_id()).otherwise(-1)).dropDuplicates(["_id", "_mark", "_nth"])
    return once.select("row.*")
