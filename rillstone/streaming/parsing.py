"""Parsing of streams with the lines that cannot be parsed set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rillstone.operators.parsing import sorted_positions


class SortedLines:
    """Micro-batch sink that parses each line once and writes it below ``path`` by outcome.

    A batch is one table with a folder for each outcome (``kept``, ``malformed``, ``other``), written in one job from one scan; a
    batch that is run again takes the place of its first try.
    """

    def __init__(self, path: str, line: str = "line") -> None:
        self.path, self.line = path.rstrip("/"), line

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = sorted_positions(batch, self.line)
        rows.write.mode("overwrite").partitionBy("outcome").parquet(f"{self.path}/batch={batch_id}")
