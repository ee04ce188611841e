"""External extractors as a Spark data source: a command a partition gets its configuration as JSON on its input and gives facts as JSON.

    spark.dataSource.register(ExtractorSource)
    spark.read.format("extractor").option("commands", json.dumps([...])).load()

commands: a list of {"name", "command": [...], "config": {...}, "timeout_ms"}. A command that fails or exceeds its time gives one row with
its error and no fact, so that one broken tool does not take the others' facts along.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COLUMNS = ("fact_type", "message", "file", "start_line", "end_line", "severity", "confidence")


class ExtractorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "extractor"

    def schema(self) -> str:
        return "extractor string, fact_type string, message string, file string, start_line int, end_line int, severity string, confidence double, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["commands"]))


class _Reader(DataSourceReader):
    def __init__(self, commands: list[dict]) -> None:
        self.commands = commands

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(len(self.commands))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import subprocess as run_in_worker

        c = self.commands[partition.value]
        try:
            done = run_in_worker.run(c["command"], input=json.dumps(c.get("config", {})), capture_output=True, text=True, timeout=c.get("timeout_ms", 60_000) / 1000, check=True)
            held = json.loads(done.stdout)
            for f in held if isinstance(held, list) else held.get("facts", []):
                yield (c["name"], *(f.get(k) for k in COLUMNS), None)
        except (subprocess.SubprocessError, OSError, ValueError) as e:
            yield (c["name"], *[None] * len(COLUMNS), f"{type(e).__name__}: {e}"[:500])


def totals(rows: DataFrame) -> DataFrame:
    """extractor, facts, failed; if every extractor failed, the totals are an error."""
    out = rows.groupBy("extractor").agg(F.count("fact_type").alias("facts"), F.max(F.col("error").isNotNull()).alias("failed"))
    every = out.agg(F.min("failed").alias("every"))
    checked = F.when(F.col("every"), F.raise_error(F.lit("all extractors failed")).cast("boolean")).otherwise(F.col("failed"))
    return out.crossJoin(F.broadcast(every)).select("extractor", "facts", checked.alias("failed"))  # every is one row
