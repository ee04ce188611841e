"""Token counts: a prefix table stores the exact token count of every prefix of a text.

The table is a one-dimensional dynamic program over the text's code points. The vocabulary never joins text across a space after a
non-space, so a chunk (a run of spaces and a word) adds the same steps wherever it stands, and a worker remembers the steps of the
chunks it has met. Within a chunk the library counts the prefixes of short ones; in longer ones the last token of each prefix is found
from that of a shorter prefix, in time that follows their length. Truncation and budget questions are read off the stored table: no
text is encoded again.

Tables are stored as steps (tokens more or fewer after each code point), 16 bits each, in a zstandard frame for each document.

Defined results: a null or empty text has 0 tokens and an empty table; repeated rows give repeated rows; a prefix as long as another
with the same count is the longer one where a budget is asked for; a null doc_id stays null; an empty table gives no rows; extra columns
are ignored. Memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.encoding import PieceCounts, opened
from factloom.llm.shared import slices, written

#: Tokens from which a text counts as over the limit.
LIMIT = 4096


def prefix_tables(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens, steps: the table of each document, to be written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, pack = opened(PieceCounts, model_path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                steps = memo.steps([t or "" for t in part.column("text").to_pylist()])
                size = pc.binary_length(part.column("text").cast(pa.large_string())).fill_null(0).cast(pa.int64())
                numbers = [pa.array([f(s) for s in steps], pa.int64()) for f in (len, lambda s: int(s.sum(dtype=np.int64)))]
                tables = pa.array([pack.compress(s.tobytes()) for s in steps], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), size, *numbers, tables], ["doc_id", "n_bytes", "n_chars", "n_tokens", "steps"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_chars long, n_tokens long, steps binary")


def counts_of(steps: bytes) -> np.ndarray:
    """Tokens of each prefix, the empty one first."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(zstandard.decompress(steps), "<i2"), dtype=np.int64)])


def _asked(tables: DataFrame, name: str, answer: Callable[[np.ndarray], int]) -> DataFrame:
    """tables without steps, with `name`: answer(counts of all prefixes)."""
    kept = [f for f in tables.schema if f.name != "steps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([answer(counts_of(s.as_py())) for s in batch.column("steps")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), found], [*(f.name for f in kept), name])

    return tables.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{name}` long"]))


def prefix_count(tables: DataFrame, n: int) -> DataFrame:
    """tables with count_at: tokens of the first n code points (of all, in a shorter text)."""
    return _asked(tables, "count_at", lambda counts: int(counts[min(n, len(counts) - 1)]))


def cut_to(tables: DataFrame, budget: int) -> DataFrame:
    """tables with cut: code points of the longest prefix with at most `budget` tokens."""
    return _asked(tables, "cut", lambda counts: int(np.flatnonzero(counts <= budget)[-1]))


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, read off the stored tables."""
    tables = written(prefix_tables(docs, model_path), "prefixes")
    return tables.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
