"""Text sources, message envelopes, replay and generated call records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions.lineage import saved
from rillstone.functions.skew import DEFAULT_SKEW, Skew, row_numbers

# Fixed values of the call generator: eleven-digit numbers, durations below a day, 5 % not established.
FIRST_NUMBER = 10_000_000_000
NUMBERS = 90_000_000_000
DAY_SECONDS = 86_400
FAILED_SHARE = 0.05


def read_lines(spark: SparkSession, path: str, streaming: bool = False, **options: object) -> DataFrame:
    """Lines of text files as column ``line``; Spark's input splits take the place of line strides."""
    reader = spark.readStream if streaming else spark.read
    return reader.options(**options).text(path).withColumnRenamed("value", "line")


def file_source(
    spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame], streaming: bool = False
) -> DataFrame:
    """Typed rows from text files, by a function on the DataFrame of lines."""
    return parse(read_lines(spark, path, streaming))


def encode(ts_ms: Column | str, line: Column | str = "line") -> Column:
    """Message value: producer time and line."""
    return F.concat_ws("|", F.col(ts_ms).cast("string") if isinstance(ts_ms, str) else ts_ms.cast("string"), line)


def decode(messages: DataFrame, value: str = "value", now_ms: Column | None = None) -> DataFrame:
    """``ts_ms`` (ingestion time), ``line`` and ``ts_ext_ms`` (producer time) from message values.

    A line is read up to its first separator.
    """
    parts = F.split(F.col(value).cast("string"), r"\|")
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    kept = [c for c in messages.columns if c != value]
    return messages.select(
        *kept, now.cast("long").alias("ts_ms"), parts[1].alias("line"), parts[0].cast("long").alias("ts_ext_ms")
    )


def read_kafka(spark: SparkSession, host: str, topic: str, **options: object) -> DataFrame:
    """Stream of decoded messages of a topic. Needs Spark's Kafka connector on the class path."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", host).option("subscribe", topic)
    return decode(stream.options(**options).load().select("value"))


def write_kafka(lines: DataFrame, host: str, topic: str, checkpoint: str, ts_ms: str | None = None):
    """Start a query that publishes lines with their producer time (default: now)."""
    stamped = lines if ts_ms else lines.withColumn("_now", F.unix_millis(F.current_timestamp()))
    values = stamped.select(encode(ts_ms or "_now").alias("value"))
    writer = values.writeStream.format("kafka").option("kafka.bootstrap.servers", host).option("topic", topic)
    return writer.option("checkpointLocation", checkpoint).start()


def source(
    kind: str, spark: SparkSession, path: str = "", host: str = "", topic: str = "", rate: int = 0, limit: int | None = None
) -> DataFrame:
    """Stream of ``ts_ms line ts_ext_ms`` by kind: "" a file, "local" a file at a fixed rate, "kafka" a topic, "envelopes" a folder of messages."""
    if kind == "kafka":
        return read_kafka(spark, host, topic)
    if kind == "envelopes":
        from rillstone.sources.envelopes import read_envelopes

        return read_envelopes(spark, path, streaming=True).select("ts_ms", "line", "ts_ext_ms")
    if kind == "local":
        return replay_stream(read_lines(spark, path), rate)
    if kind == "":
        now = F.unix_millis(F.current_timestamp())
        return read_lines(spark, path, streaming=True).select(now.alias("ts_ms"), "line", now.alias("ts_ext_ms"))
    raise ValueError(f"unknown source: {kind}")


def indexed(lines: DataFrame, seq: str, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Add ``index``: 0, 1, ... in ``seq`` order."""
    return row_numbers(lines, [], seq, "_pos", skew).withColumn("index", F.col("_pos") - 1).drop("_pos")


def replay(
    lines: DataFrame, seq: str, rate: int, total: int | None = None, cycles: int = 1, start_ms: int = 0, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Lines sent at ``rate`` per second, again from the start at the end: ``emission`` and ``ts_ms``.

    The first ``total`` emissions, or ``cycles`` rounds. A line knows its own emissions, so nothing is joined.
    """
    placed = indexed(lines, seq, skew)
    n = lines.count()
    emissions = n * cycles if total is None else total
    if n == 0 or emissions == 0:
        return placed.limit(0).select(*lines.columns, F.lit(0).cast("long").alias("emission"), F.lit(0).cast("long").alias("ts_ms"))
    turns = F.sequence(F.lit(0).cast("long"), F.lit((emissions - 1) // n).cast("long"))
    sent = placed.withColumn("_turn", F.explode(turns)).withColumn("emission", F.col("_turn") * n + F.col("index"))
    at = F.expr(f"{start_ms} + emission * 1000 div {rate}").alias("ts_ms")
    return sent.filter(F.col("emission") < emissions).select(*lines.columns, "emission", at)


def replay_stream(lines: DataFrame, rate: int, ramp_up_seconds: int = 0) -> DataFrame:
    """Endless stream of the lines at ``rate`` per second, with their emission time.

    ``lines`` is a static DataFrame; its order is the order of its files and rows. The numbered lines are
    saved first, because every micro-batch reads them.
    """
    spark = lines.sparkSession
    placed = saved(indexed(lines.withColumn("_seq", F.monotonically_increasing_id()), "_seq").drop("_seq"))
    n = placed.count()
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rate)
    if ramp_up_seconds:
        ticks = ticks.option("rampUpTime", f"{ramp_up_seconds}s")
    stamped = ticks.load().select(F.unix_millis("timestamp").alias("ts_ms"), (F.col("value") % n).alias("index"))
    return stamped.join(placed, "index").select("ts_ms", "line", F.col("ts_ms").alias("ts_ext_ms"))


def constant_rate(spark: SparkSession, rate: int, ramp_up_seconds: int = 0) -> DataFrame:
    """Synthetic tuples at a constant rate, or rising to it over ``ramp_up_seconds``."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rate)
    if ramp_up_seconds:
        ticks = ticks.option("rampUpTime", f"{ramp_up_seconds}s")
    return ticks.load().select(
        F.col("value").alias("id"),
        F.unix_millis("timestamp").alias("ts"),
        F.lit(-1).cast("long").alias("stimulus"),
        F.pi().alias("f1"),
        F.pmod(F.xxhash64("value"), F.lit(1000)).cast("int").alias("f2"),
        F.lit(0).alias("f3"),
    )


def generate_calls(spark: SparkSession, numbers: int, calls: int, seed: int = 0, answer_ts: int = 1_704_067_200) -> DataFrame:
    """Random call records over a pool of eleven-digit numbers; nobody calls themselves."""
    if numbers < 2:
        raise ValueError("at least two numbers are needed")

    def number(index: Column) -> Column:
        # A step that shares no factor with the range keeps different members of the pool different.
        return (F.lit(FIRST_NUMBER) + (index * 7_368_787 + seed) % NUMBERS).cast("string")

    drawn = spark.range(calls).select(
        F.col("id").alias("call_id"),
        F.floor(F.rand(seed) * numbers).alias("_a"),
        (1 + F.floor(F.rand(seed + 1) * (numbers - 1))).alias("_gap"),
        F.floor(F.rand(seed + 2) * DAY_SECONDS).cast("int").alias("duration"),
        (F.rand(seed + 3) >= FAILED_SHARE).alias("established"),
    )
    return drawn.select(
        "call_id",
        number(F.col("_a")).alias("caller"),
        number((F.col("_a") + F.col("_gap")) % numbers).alias("callee"),
        F.lit(answer_ts).cast("long").alias("answer_ts"),
        "duration",
        "established",
    )


def call_line(time_zone: str = "+00:00") -> Column:
    """A call record as a line of text."""
    iso = F.concat(
        F.date_format(F.to_utc_timestamp(F.timestamp_seconds("answer_ts"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit(f".000{time_zone}"),
    )
    return F.concat_ws(",", "caller", "callee", iso, "duration", F.when(F.col("established"), "true").otherwise("false"))
