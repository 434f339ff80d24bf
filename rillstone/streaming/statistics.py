"""Statistics of running streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from rillstone.operators.statistics import GAP_ROWS, latency


def count_per_second(stream: DataFrame, event_time: str, lateness: str = "10 seconds") -> DataFrame:
    """Rows per second of event time, once the watermark has passed. Seconds without rows do not appear."""
    per = stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, "1 second").alias("w"))
    return per.agg(F.count(F.lit(1)).alias("count")).select(F.unix_seconds(F.col("w.start")).alias("second"), "count")


def average_per_second(stream: DataFrame, event_time: str, value: str, lateness: str = "10 seconds") -> DataFrame:
    """Integer mean per second of event time."""
    per = stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, "1 second").alias("w"))
    sums = per.agg(F.sum(F.col(value).cast("long")).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.unix_seconds(F.col("w.start")).alias("second"), F.expr("s div n").alias("average"))


class Gaps(StatefulProcessor):
    """Seconds between the last one with rows and the next one, given out as soon as the next one is final."""

    def __init__(self, keys: Sequence[str], value: str, fill: int) -> None:
        self.keys, self.value, self.fill = list(keys), value, fill

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "second long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        final = pd.concat(list(rows)).sort_values("second")
        seconds = final["second"].to_numpy(np.int64)
        before = np.append(self.last.get()[0] if self.last.exists() else seconds[0] - 1, seconds[:-1])
        self.last.update((int(seconds[-1]),))
        yield self._rows(key, seconds, final[self.value].to_numpy(np.int64))
        for low, high in zip((before + 1)[before + 1 < seconds], seconds[before + 1 < seconds]):
            # A gap of any length goes out in pieces.
            for at in range(int(low), int(high), GAP_ROWS):
                missing = np.arange(at, min(at + GAP_ROWS, int(high)))
                yield self._rows(key, missing, np.full(len(missing), self.fill, np.int64))

    def _rows(self, key: tuple, seconds: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({k: [v] * len(seconds) for k, v in zip(self.keys, key)} | {"second": seconds, self.value: values})

    def close(self) -> None:
        pass


def _with_gaps(per_second: DataFrame, keys: Sequence[str], value: str, fill: int) -> DataFrame:
    """``keys second value`` without missing seconds between the first and the last one of a key."""
    columns = per_second.select(*keys, F.col("second").cast("long").alias("second"), F.col(value).cast("long").alias(value))
    names = list(keys) or ["_all"]
    columns = columns if keys else columns.withColumn("_all", F.lit(0))
    schema = ", ".join(f"{c} {columns.schema[c].dataType.simpleString()}" for c in (*names, "second", value))
    filled = columns.groupBy(*names).transformWithStateInPandas(
        statefulProcessor=Gaps(names, value, fill), outputStructType=schema, outputMode="Append", timeMode="None"
    )
    return filled.select(*keys, "second", value)


def counts_without_gaps(stream: DataFrame, event_time: str, keys: Sequence[str] = (), lateness: str = "10 seconds") -> DataFrame:
    """Rows per key and second of event time, 0 in seconds without rows: the batch operator's result up to the watermark."""
    per = stream.withWatermark(event_time, lateness).groupBy(*keys, F.window(event_time, "1 second").alias("w"))
    counts = per.agg(F.count(F.lit(1)).alias("count")).select(*keys, F.unix_seconds(F.col("w.start")).alias("second"), "count")
    return _with_gaps(counts, keys, "count", 0)


def averages_without_gaps(stream: DataFrame, event_time: str, value: str, keys: Sequence[str] = (), lateness: str = "10 seconds") -> DataFrame:
    """Integer mean per key and second, -1 in seconds without rows."""
    per = stream.withWatermark(event_time, lateness).groupBy(*keys, F.window(event_time, "1 second").alias("w"))
    sums = per.agg(F.sum(F.col(value).cast("long")).alias("s"), F.count(F.lit(1)).alias("n"))
    means = sums.select(*keys, F.unix_seconds(F.col("w.start")).alias("second"), F.expr("s div n").alias("average"))
    return _with_gaps(means, keys, "average", -1)


class LatencySink:
    """Micro-batch sink that stamps the time of arrival and writes latencies and their statistics below ``path``.

    ``latencies/batch=n`` has the two latencies of each row, ``statistics/batch=n`` the number of rows and the integer
    means of both by second of arrival. A batch that is run again takes the place of its first try.
    """

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        now = F.unix_millis(F.current_timestamp())
        stamped = latency(batch.select("ts_ms", "ts_ext_ms"), now).withColumn("second", F.expr("unix_millis(current_timestamp()) div 1000"))
        raw = f"{self.path}/latencies/batch={batch_id}"
        stamped.write.mode("overwrite").parquet(raw)
        means = [F.expr(f"sum({c}) div count({c})").alias(f"mean_{c}") for c in ("latency", "end_latency")]
        seen = batch.sparkSession.read.schema(stamped.schema).parquet(raw)
        per_second = seen.groupBy("second").agg(F.count(F.lit(1)).alias("count"), *means)
        per_second.write.mode("overwrite").parquet(f"{self.path}/statistics/batch={batch_id}")


class ThroughputListener(StreamingQueryListener):
    """Collects the observed metrics of running queries: one entry per micro-batch and observation."""

    def __init__(self) -> None:
        self.seen: list[tuple[str, dict]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in (event.progress.observedMetrics or {}).items():
            self.seen.append((name, row.asDict()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
