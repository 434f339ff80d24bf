"""Views over the shared ``events`` table: position reports, call records, metric samples and raw lines.

Thirty days of events are compressed by 2400 into 18 minutes. ``event_id`` is the arrival order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_S = 1_704_067_200


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with whole seconds since the first day (`sec`) and the number in ``props`` (`k`)."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id",
        "user_id",
        "value",
        "event_type",
        "cast(datediff(to_date(ts), date'2024-01-01') * 86400L + hour(ts) * 3600 + minute(ts) * 60 + second(ts) as bigint) as sec",
        "cast(regexp_extract(props, '([0-9]+)', 1) as int) as k",
    )


def positions(spark: SparkSession, sf_dir: str, all_types: bool = False) -> DataFrame:
    """Position reports; with ``all_types`` the reports that are not of type 0 are kept as well."""
    reports = (
        events(spark, sf_dir)
        .selectExpr(
            "event_id as seq",
            "cast(case when k = 99 then 2 else 0 end as smallint) as type",
            "cast(sec div 2400 as int) as time",
            "cast(user_id as int) as vid",
            "k as speed",
            "0 as xway",
            "cast(k % 5 as smallint) as lane",
            "cast(event_id % 2 as smallint) as direction",
            "cast((user_id + sec div 2400 div 180) % 5 as smallint) as segment",
            "cast(((user_id + sec div 2400 div 180) % 5) * 5280 + k as int) as position",
            "cast(sec div 2400 div 60 + 1 as int) as minute",
        )
    )
    return reports if all_types else reports.filter("type = 0")


def position_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated position lines of all types."""
    fields = ["type", "time", "vid", "speed", "xway", "lane", "direction", "segment", "position"]
    return positions(spark, sf_dir, all_types=True).select("seq", F.concat_ws(",", *fields).alias("line"))


def accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with a stopped, failing vehicle, one row per minute and segment.

    The shared tables hold no accidents: events of type "error" with the number 0 stand in for them.
    """
    stopped = events(spark, sf_dir).filter("event_type = 'error' and k = 0").select(F.col("event_id").alias("seq"))
    return (
        positions(spark, sf_dir)
        .filter("speed = 0")
        .join(stopped, "seq", "left_semi")
        .select("minute", "xway", "direction", "segment")
        .distinct()
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call detail records."""
    return events(spark, sf_dir).selectExpr(
        "event_id as call_id",
        "cast(user_id as string) as caller",
        "cast(case when k % 10 = 5 then user_id + 5 else user_id + (k % 10) - 5 end as string) as callee",
        f"{EPOCH_S} + sec div 2400 as answer_ts",
        "cast(floor(value * 60) as int) as duration",
        "k >= 5 as established",
    )


def call_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated call records with an ISO time and a +01:00 offset."""
    local = "timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, answer_ts + 3600)"
    iso = f"concat(date_format({local}, \"yyyy-MM-dd'T'HH:mm:ss\"), '.000+01:00')"
    return calls(spark, sf_dir).selectExpr(
        "call_id",
        f"concat_ws(',', caller, callee, {iso}, duration, if(established, 'true', 'false')) as line",
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of an experiment: four measures, three variants, five rates, four nodes, three repetitions.

    Runs of a higher rate begin 300 seconds later each, so that runs must be told apart by their rate.
    """
    return events(spark, sf_dir).selectExpr(
        "event_id as seq",
        "cast(user_id % 3 as int) as rep",
        "concat('Storm.node', cast(user_id % 4 as string)) as node",
        "cast(sec div 2400 + 300 * (user_id % 5) as int) as t",
        "cast(floor(value * 100) as double) as value",
        "case k % 4 when 0 then 'latency' when 1 then 'throughput' when 2 then 'sink-throughput' else 'input-queue' end as parameter",
        "case k % 3 when 0 then 'OS' when 1 then 'CUSTOM-QS' else 'CUSTOM-FCFS' end as variant",
        "cast(1000 * (1 + user_id % 5) as int) as rate",
        "'run' as experiment",
    )
