"""A sink and source of relational tables: whole DataFrames stored in one transaction, through any DB-API module.

    spark.dataSource.register(Transaction)
    df.write.format("transaction").option("module", "sqlite3").option("url", path).option("table", "findings").option("run", "build 17") \\
        .option("header", '{"id": 17, "project": "p"}').option("headertable", "analyses").mode("append").save()
    spark.read.format("transaction").schema("id long, name string").option("table", "findings").option("by", "id")...load()

Tasks insert their rows, CHUNK at a time, into a staging table, marked with their attempt. When all tasks have succeeded, the driver moves the rows
of the attempts that Spark counts, adds the header row, and notes the run, all in one transaction; then the staging table goes. A failing or repeated
task, a lost executor or a failing commit leaves the table as it was. A run that was stored before is not stored again, so a job can be
repeated. Reading splits the range of a whole-number column (option `by`) into `parts` tasks.

SQLite has one writer at a time and no index on `by`. So tasks that store into it stage their rows in files beside the database, each its own and
without waiting for the others; the driver's connection takes them over as whole records, in one transaction, and removes them. Reading splits
the table's own row numbers, so that no task reads what another one does.

As a stream the source gives the rows of each batch once, by the range of `by` that is new since the last one; the offset is its greatest value so far.
`by` must grow with each run that is stored, as a sequence does; rows without it are not streamed.
"""

from __future__ import annotations

import glob
import hashlib
import importlib
import json
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import closing, suppress
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# Rows of one insert, rows fetched at once or put into a file, files that SQLite attaches in one transaction (10 at most), rows of a task that reads by row numbers.
CHUNK, FETCHED, ATTACHED, TASK_ROWS = 1000, 10_000, 8, 2_000_000
TYPES = {"string": "TEXT", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "float": "REAL", "boolean": "BOOLEAN"}
ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32()}


def _values(column: pa.Array) -> list:
    """As to_pylist(), by numpy where that gives the same, which is many times faster."""
    kind = column.type
    if pa.types.is_string(kind) or not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    values = column.to_pylist()
    return [v.isoformat(" ") if hasattr(v, "isoformat") else v for v in values] if pa.types.is_temporal(kind) else values


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError):
        if kind != pa.string():
            raise
        return pa.array([None if v is None else str(v) for v in values], kind)


def _name(text: str) -> str:
    if not re.fullmatch(r"[A-Za-z_]\w{0,100}", text):
        raise ValueError(f"no plain name: {text}")
    return text


class _Base:
    """What driver and tasks know: the module, where it connects to, the table and its columns."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.module, self.url, self.table = options["module"], options["url"], _name(options["table"])
        self.in_file = self.module == "sqlite3"
        self.columns = [_name(f.name) for f in schema.fields]
        self.arrow = [ARROW.get(f.dataType.simpleString()) for f in schema.fields]
        self.kinds = [TYPES.get(f.dataType.simpleString(), "TEXT") for f in schema.fields]

    def connect(self, url: str | None = None):
        module = importlib.import_module(self.module)
        return closing(module.connect(url or self.url, **({"timeout": 120} if self.in_file else {})))

    def marks(self, n: int) -> str:
        style = importlib.import_module(self.module).paramstyle
        return ", ".join(["?" if style == "qmark" else "%s"] * n)

    def defined(self) -> str:
        return ", ".join(f"{c} {k}" for c, k in zip(self.columns, self.kinds, strict=True))


@dataclass
class _Done(WriterCommitMessage):
    attempt: str
    rows: int


class _Writer(_Base, DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        _Base.__init__(self, options, schema)
        self.run, self.token = options["run"], uuid.uuid4().hex  # what an earlier, lost driver has staged has another token
        self.header, self.header_table = json.loads(options.get("header", "{}")), options.get("headertable")
        self.staging = f"{self.table}_staging_" + "".join(f"{b:02x}" for b in self.run.encode())[:60]

    def staged(self, attempt: str) -> str:
        """The file beside an SQLite database with the rows of an attempt; * for those of all attempts at this run."""
        run = hashlib.sha256(f"{self.table} {self.run}".encode()).hexdigest()[:16]
        return f"{glob.escape(self.url) if attempt == '*' else self.url}-staging-{run}-{attempt}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        attempt, n = f"{self.token}-{TaskContext.get().taskAttemptId()}", 0
        table, own = (self.table, ()) if self.in_file else (self.staging, (attempt,))
        insert = f"INSERT INTO {table} VALUES ({self.marks(len(own) + len(self.columns))})"
        step = FETCHED if self.in_file else CHUNK
        with self.connect(self.staged(attempt) if self.in_file else None) as con:
            if self.in_file:
                _unguarded(con)
            con.execute(f"CREATE TABLE IF NOT EXISTS {table} ({'attempt TEXT, ' * len(own)}{self.defined()})")
            con.commit()
            for batch in iterator:
                for at in range(0, batch.num_rows, step):
                    columns = [_values(c) for c in batch.slice(at, step).columns]
                    con.executemany(insert, zip(*[[v] * len(columns[0]) for v in own], *columns, strict=True))
                    if not self.in_file:
                        con.commit()
                n += batch.num_rows
            con.commit()
        return _Done(attempt, n)

    def commit(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        done = [m for m in messages if isinstance(m, _Done)]
        columns = ", ".join(self.columns)
        with self.connect() as con:
            try:
                con.execute(f"CREATE TABLE IF NOT EXISTS {self.table}_runs (run TEXT PRIMARY KEY, n BIGINT)")
                con.execute(f"CREATE TABLE IF NOT EXISTS {self.table} ({self.defined()})")
                if not self.in_file:
                    con.execute(f"CREATE TABLE IF NOT EXISTS {self.staging} (attempt TEXT, {self.defined()})")
                con.commit()
                cur = con.cursor()
                cur.execute(f"SELECT count(*) FROM {self.table}_runs WHERE run = {self.marks(1)}", (self.run,))
                if not cur.fetchone()[0]:
                    files = self.gathered(done) if self.in_file else []
                    for k, path in enumerate(files):
                        cur.execute(f"ATTACH ? AS staged{k}", (path,))
                    cur.execute(f"INSERT INTO {self.table}_runs VALUES ({self.marks(2)})", (self.run, sum(m.rows for m in done)))
                    if self.header_table:
                        names = [_name(k) for k in self.header]
                        cur.execute(f"INSERT INTO {_name(self.header_table)} ({', '.join(names)}) VALUES ({self.marks(len(names))})", tuple(self.header.values()))
                    if self.in_file:
                        self.take(cur, len(files), sum(m.rows for m in done))
                    else:
                        for m in done:
                            cur.execute(f"INSERT INTO {self.table} ({columns}) SELECT {columns} FROM {self.staging} WHERE attempt = {self.marks(1)}", (m.attempt,))
                con.commit()
            except Exception:
                con.rollback()
                raise
            if not self.in_file:
                con.execute(f"DROP TABLE IF EXISTS {self.staging}")
                con.commit()
        self.cleared()

    def gathered(self, done: list[_Done]) -> list[str]:
        """The staged files of the attempts, at most as many as one transaction attaches: the rows of the others are added to these."""
        paths = [self.staged(m.attempt) for m in done if m.rows]

        def add(k: int) -> None:
            with self.connect(paths[k]) as con:
                _unguarded(con)
                for path in paths[k + ATTACHED :: ATTACHED]:
                    con.execute("ATTACH ? AS other", (path,))
                    con.execute(f"INSERT INTO {self.table} SELECT * FROM other.{self.table}")
                    con.commit()
                    con.execute("DETACH other")
                    os.remove(path)

        with ThreadPoolExecutor(ATTACHED) as pool:
            list(pool.map(add, range(min(ATTACHED, len(paths)))))
        return paths[:ATTACHED]

    def take(self, cur, files: int, rows: int) -> None:
        """Adds the rows of the attached files; where the columns are the table's own, SQLite copies whole records."""
        cur.execute(f"PRAGMA main.table_info({self.table})")
        same = [r[1] for r in cur.fetchall()] == self.columns
        into, columns = ("", "*") if same else (f" ({', '.join(self.columns)})", ", ".join(self.columns))
        taken = 0
        for k in range(files):
            taken += cur.execute(f"INSERT INTO main.{self.table}{into} SELECT {columns} FROM staged{k}.{self.table}").rowcount
        if taken != rows:
            raise RuntimeError(f"{taken} of {rows} staged rows were found")

    def cleared(self) -> None:
        if self.in_file:
            for path in glob.glob(self.staged("*")):
                with suppress(FileNotFoundError):
                    os.remove(path)

    def abort(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        self.cleared()
        if not self.in_file:
            with self.connect() as con, suppress(Exception):
                con.execute(f"DROP TABLE IF EXISTS {self.staging}")
                con.commit()


def _unguarded(con) -> None:
    """For a staged file alone: should the machine fail, its attempt fails as a whole."""
    con.execute("PRAGMA journal_mode = OFF")
    con.execute("PRAGMA synchronous = OFF")


@dataclass
class _Part(InputPartition):
    where: str


class _Ranges(_Base):
    """Reading by ranges of a column, or of SQLite's row numbers."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        super().__init__(options, schema)
        self.by, self.parts = _name(options["by"]), int(options["parts"]) if "parts" in options else None

    def asked(self, sql: str) -> list[tuple]:
        with self.connect() as con:
            cur = con.cursor()
            cur.execute(sql)
            return cur.fetchall()

    def numbers(self) -> tuple[int, int] | None:
        """The first and last row number, where the table has them: not views, nor tables without or with a column of that name."""
        if not self.in_file:
            return None
        kind = self.asked(f"SELECT type FROM sqlite_master WHERE lower(name) = '{self.table.lower()}'")
        if kind != [("table",)] or "rowid" in {r[1].lower() for r in self.asked(f"PRAGMA table_info({self.table})")}:
            return None
        try:
            low, high = self.asked(f"SELECT (SELECT min(rowid) FROM {self.table}), (SELECT max(rowid) FROM {self.table})")[0]  # two looks at the tree
        except importlib.import_module(self.module).OperationalError:
            return None
        return None if low is None else (low, high)

    def by_number(self, low: int, high: int) -> list[str]:
        return self.ranges("rowid", low, high, self.parts or max(8, -(-(high - low + 1) // TASK_ROWS)))

    def ends(self) -> tuple[int | None, int | None]:
        ask = f"SELECT min({self.by}), max({self.by}) FROM {self.table}"
        if not (numbers := self.numbers()):
            return self.asked(ask)[0]
        with ThreadPoolExecutor(ATTACHED) as pool:
            found = list(pool.map(lambda where: self.asked(f"{ask} WHERE {where}")[0], self.by_number(*numbers)))
        known = [x for x in found if x[0] is not None]
        return (min(x[0] for x in known), max(x[1] for x in known)) if known else (None, None)

    @staticmethod
    def ranges(column: str, low: int, high: int, parts: int) -> list[str]:
        """Parts of low..high, both included."""
        step = -(-(high - low + 1) // parts)
        return [f"{column} >= {a} AND {column} < {min(a + step, high + 1)}" for a in range(low, high + 1, step)] if high >= low else []

    def rows(self, partition: _Part) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        with self.connect() as con:
            cur = con.cursor()
            cur.execute(f"SELECT {', '.join(self.columns)} FROM {self.table} WHERE {partition.where}")
            while rows := cur.fetchmany(FETCHED):
                if None in self.arrow:
                    yield from rows
                else:
                    yield pa.RecordBatch.from_arrays([_column(c, k) for c, k in zip(zip(*rows, strict=True), self.arrow, strict=True)], self.columns)


class _Reader(_Ranges, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        if numbers := self.numbers():
            return [_Part(x) for x in self.by_number(*numbers)]
        low, high = self.ends()
        return [_Part(x) for x in (f"{self.by} IS NULL", *([] if low is None else self.ranges(self.by, low, high, self.parts or 8)))]

    def read(self, partition: _Part) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        return self.rows(partition)


class _Stream(_Ranges, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        low, _ = self.ends()
        return {"done": 0 if low is None else low - 1}

    def latestOffset(self) -> dict:
        _, high = self.ends()
        return self.initialOffset() if high is None else {"done": high}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = start["done"] + 1, end["done"]
        if high >= low and (numbers := self.numbers()):
            return [_Part(f"{x} AND {self.by} >= {low} AND {self.by} <= {high}") for x in self.by_number(*numbers)]
        return [_Part(x) for x in self.ranges(self.by, low, high, self.parts or 8)]

    def read(self, partition: _Part) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is thrown away: the table keeps what was read."""


class Transaction(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transaction"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a transaction adds rows: use mode append")
        return _Writer(dict(self.options), schema)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> _Stream:
        return _Stream(dict(self.options), schema)
