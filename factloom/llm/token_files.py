"""Token-id files: one zstandard frame a document, a shared dictionary, and an offset index.

A folder holds two Parquet tables. `dictionary` has one row: dict_hash, the dictionary, the id width and the end id. `shards` has
rows of up to SHARD_BYTES of frames in ascending doc_id order: part and seq give the order, first_doc and last_doc the range (Parquet
statistics skip shards), dict_hash must equal the dictionary's, and the arrays doc_ids, counts and offsets are the index, so that one
short document is read without decoding its neighbours. `start` of a document counts the ids of all documents before it: `within` holds
those of its part, and a sum a part, a row for each task that wrote, gives the rest, so no frame is shuffled to be read.

Defined results: a null or empty text has the end id alone; documents that share a doc_id stand together, shorter first, then by
their texts, rows without doc_id before all others; an empty table gives empty files; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.encoding import WordIds, opened
from factloom.llm.shared import slices, written

END_ID = 1
SHARD_BYTES = 1 << 20
#: The dictionary is trained on the whole texts of this many documents, the first by hash of doc_id, those of more characters left out.
#: It only changes the size of the files. Where the library finds too little to train on, the arrays themselves serve as dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 400, 50_000, 64 << 10
#: Parts whose sums are broadcast, once counted; more are joined by a shuffle.
BROADCAST_PARTS = 1_000_000
LEVEL = 3

SHARDS = "part int, seq int, within long, first_doc long, last_doc long, n_docs long, n_tokens long, dict_hash string, doc_ids array<long>, counts array<long>, offsets array<long>, frames binary"


def _id_bytes(texts: list[str], memo: WordIds, end_id: int) -> list[bytes]:
    end = np.array([end_id], memo.dtype).tobytes()
    return [ids + end for ids in memo.packed(texts)]


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> bytes:
    """A dictionary of serialized id arrays; empty where there are too few of them."""
    first = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()
    sample = docs.where(F.col("doc_id").isin([r.doc_id for r in first]) & (F.length("text") <= SAMPLE_CHARS)).select("text").limit(SAMPLE_DOCS)
    arrays = _id_bytes([r.text for r in sample.collect()], WordIds(tokenizer_path), end_id)
    try:
        return zstandard.train_dictionary(DICT_BYTES, arrays, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[:DICT_BYTES] if sum(map(len, arrays)) > 64 else b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode every whole text and write the files."""
    spark = docs.sparkSession
    raw = train_dictionary(docs, tokenizer_path, end_id)
    name = hashlib.sha256(raw).hexdigest()
    width = WordIds(tokenizer_path).dtype.itemsize
    spark.createDataFrame([(name, bytearray(raw), width, end_id)], "dict_hash string, dictionary binary, width int, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(raw)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = opened(WordIds, tokenizer_path)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value), write_checksum=True)
        task, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[int, int, bytes]] = []
        size = within = 0

        def shard() -> pa.RecordBatch:
            offsets = np.cumsum([0, *(len(f) for _, _, f in held)])
            row = {"part": task, "seq": seq, "within": within, "first_doc": held[0][0], "last_doc": held[-1][0], "n_docs": len(held), "n_tokens": sum(n for _, n, _ in held), "dict_hash": name, "doc_ids": [d for d, _, _ in held], "counts": [n for _, n, _ in held], "offsets": offsets.tolist(), "frames": b"".join(f for _, _, f in held)}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW_SHARDS)

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids = _id_bytes([t or "" for t in part.column("text").to_pylist()], memo, end_id)
                for d, x in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                    f = packer.compress(x)
                    if held and size + len(f) > SHARD_BYTES:
                        yield shard()
                        within += sum(n for _, n, _ in held)
                        held, size, seq = [], 0, seq + 1
                    held.append((d, len(x) // width, f))
                    size += len(f)
        if held:
            yield shard()

    # Ranges of doc_id are dealt out before the costly encoding: finding them reads the rows twice.
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
    ranged.sortWithinPartitions("doc_id", F.length("text"), "text").mapInArrow(pack, SHARDS).write.parquet(f"{path}/shards")


_ARROW_SHARDS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("within", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("dict_hash", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("frames", pa.binary())])


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32) and, if asked for, ids.

    doc_ids: read these documents alone; shards outside their range are skipped and no other frame is decoded.
    """
    known = spark.read.parquet(f"{path}/dictionary").first()
    raw, width = bytes(known.dictionary), known.width
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = written(parts.select("part", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    if bases.count() <= BROADCAST_PARTS:
        bases = F.broadcast(bases)
    if doc_ids is not None:
        shards = shards.where((F.col("first_doc") <= max(doc_ids)) & (F.col("last_doc") >= min(doc_ids)))
    wanted = None if doc_ids is None else set(doc_ids)
    shared = spark.sparkContext.broadcast((known.dict_hash, raw))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, data = shared.value
        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_hash"] != name:
                    raise ValueError("a shard was written with another dictionary")
                frames, offsets = memoryview(row["frames"]), row["offsets"]
                out: list[tuple] = []
                start = row["start"]
                for k, (d, n) in enumerate(zip(row["doc_ids"], row["counts"], strict=True)):
                    if wanted is None or d in wanted:
                        ids = np.frombuffer(reader.decompress(frames[offsets[k] : offsets[k + 1]]), f"<u{width}").astype("<u4")
                        out.append((d, start, len(ids), zlib.crc32(ids.tobytes()), ids))
                    start += n
                columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(4)]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([r[4].astype(np.int64) for r in out], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    columns = ["dict_hash", "doc_ids", "counts", "offsets", "frames", (F.col("base") + F.col("within")).alias("start")]
    return shards.join(bases, "part").select(*columns).mapInArrow(decode, schema)
