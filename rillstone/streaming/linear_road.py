"""Tolling on unbounded streams of position reports.

The inputs are the parsed reports with an event time (:func:`with_event_time`). All queries run in append
mode: a minute is final once the watermark has passed its end. The outputs carry ``event_time`` so that the
operators can be chained and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillstone.operators.linear_road import (
    ACCIDENT_SEGMENTS,
    CAR_THRESHOLD,
    LAV_MINUTES,
    LAV_THRESHOLD,
    SEGMENT,
    on_exit_lane,
    toll_formula,
)

LATENESS = "60 seconds"
# A vehicle's segment is kept for so many seconds of event time without a report.
IDLE = 6 * 3600
# Event time of second 0. A stream starts with the watermark at 1970, and rows at the watermark are late.
ROAD_START = 946_684_800
STAY = "minute int, xway int, direction int, segment int, first_seq long, speed_sum long, n long"


def with_event_time(positions: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Add the event time of a report (its second on the clock of the road) and the watermark."""
    return positions.withColumn("event_time", F.timestamp_seconds(F.col("time") + ROAD_START)).withWatermark("event_time", lateness)


def minute_end_ms(minute: int) -> int:
    return (ROAD_START + int(minute) * 60) * 1000


class Stays(StatefulProcessor):
    """Average speed of a vehicle's stay in a segment; a stay ends with its minute or with another segment.

    Reports of one micro-batch are put in ``seq`` order. A stay that was given out is not opened again by
    late reports; they form a stay of their own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stay = handle.getValueState("stay", STAY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reports = pd.concat(list(rows)).sort_values("seq")
        reports["_run"] = (reports[["minute", *SEGMENT]].diff().fillna(1) != 0).any(axis=1).cumsum()
        runs = reports.groupby("_run").agg(
            minute=("minute", "first"), xway=("xway", "first"), direction=("direction", "first"),
            segment=("segment", "first"), first_seq=("seq", "min"), speed_sum=("speed", "sum"), n=("speed", "size"),
        )
        closed = []
        current = tuple(self.stay.get()) if self.stay.exists() else None
        for run in runs.itertuples(index=False, name=None):
            run = tuple(int(v) for v in run)
            if current is not None and current[:4] == run[:4]:
                current = (*current[:5], current[5] + run[5], current[6] + run[6])
                continue
            if current is not None:
                closed.append(current)
            current = run
        self.stay.update(current)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(minute_end_ms(current[0]) - 1)
        if closed:
            yield self.output(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.stay.exists():
            current = tuple(self.stay.get())
            self.stay.clear()
            yield self.output(key, [current])

    @staticmethod
    def output(key, stays: list[tuple]) -> pd.DataFrame:
        vid = int(key[0])
        rows = [
            (s[4], vid, s[0], s[1], s[2], s[3], s[5] // s[6], pd.Timestamp(minute_end_ms(s[0]) - 1, unit="ms"))
            for s in stays
        ]
        return pd.DataFrame(rows, columns=["seq", "vid", "minute", *SEGMENT, "avg_speed", "event_time"])

    def close(self) -> None:
        pass


def average_speed(positions: DataFrame) -> DataFrame:
    """Stays as in the batch operator. Their event time is the last millisecond of their minute."""
    reports = positions.select("vid", "seq", "minute", *SEGMENT, "speed", "event_time")
    return reports.groupBy("vid").transformWithStateInPandas(
        statefulProcessor=Stays(),
        outputStructType="seq long, vid int, minute int, xway int, direction smallint, segment smallint, "
        "avg_speed int, event_time timestamp",
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName="event_time",
    )


def last_average_speed(speeds: DataFrame, minutes: int = LAV_MINUTES) -> DataFrame:
    """LAV per segment and minute from the stream of stays: a sliding window that ends with the minute."""
    window = F.window("event_time", f"{minutes} minutes", "1 minute")
    sums = speeds.groupBy(window.alias("w"), *SEGMENT).agg(
        F.sum("avg_speed").alias("s"), F.count(F.lit(1)).alias("n"), F.max("minute").alias("last")
    )
    end = F.floor((F.unix_seconds(F.col("w.end")) - ROAD_START) / 60)
    return sums.filter(F.col("last") == end).select(
        (F.col("last") + 1).cast("int").alias("minute"), *SEGMENT, F.expr("cast(s div n as int)").alias("lav"),
        F.window_time("w").alias("event_time"),
    )


def count_vehicles(positions: DataFrame, threshold: int = CAR_THRESHOLD) -> DataFrame:
    """Reports per minute and segment, where there are more than ``threshold``."""
    cells = positions.groupBy(F.window("event_time", "1 minute").alias("w"), *SEGMENT).agg(
        F.count(F.lit(1)).cast("int").alias("count")
    )
    minute = (F.floor((F.unix_seconds(F.col("w.start")) - ROAD_START) / 60) + 1).cast("int")
    return cells.filter(F.col("count") > threshold).select(minute.alias("minute"), *SEGMENT, "count", F.window_time("w").alias("event_time"))


class SegmentEntries(StatefulProcessor):
    """Reports whose segment differs from the vehicle's report before.

    A vehicle that does not report for ``idle`` seconds of event time is forgotten: its next report is an entry.
    """

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.segment = handle.getValueState("segment", "segment int, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reports = pd.concat(list(rows)).sort_values("seq")
        before = reports["segment"].shift()
        seen = reports["event_time"].astype("datetime64[ms]").astype("int64")
        last = seen.shift()
        if self.segment.exists():
            before.iloc[0], last.iloc[0] = self.segment.get()
        self.segment.update((int(reports["segment"].iloc[-1]), int(seen.iloc[-1])))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(seen.max()), timerValues.getCurrentWatermarkInMs()) + self.idle * 1000)
        entered = reports[(reports["segment"] != before) | (seen - last > self.idle * 1000)]
        if len(entered):
            yield entered

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.segment.clear()
        return iter(())

    def close(self) -> None:
        pass


def segment_changes(positions: DataFrame, idle: int = IDLE) -> DataFrame:
    """Reports off the exit lane with which a vehicle enters a segment; see :class:`SegmentEntries` for ``idle``."""
    driving = positions.filter(~on_exit_lane()).select("seq", "vid", "minute", *SEGMENT, "event_time")
    return driving.groupBy("vid").transformWithStateInPandas(
        statefulProcessor=SegmentEntries(idle),
        outputStructType="seq long, vid int, minute int, xway int, direction smallint, segment smallint, "
        "event_time timestamp",
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName="event_time",
    )


def assess_tolls(
    entries: DataFrame,
    lav: DataFrame,
    counts: DataFrame,
    lav_threshold: int = LAV_THRESHOLD,
    car_threshold: int = CAR_THRESHOLD,
) -> DataFrame:
    """Tolls of segment entries against the segment state that earlier micro-batches have written.

    ``lav`` and ``counts`` are the tables that :func:`last_average_speed` and :func:`count_vehicles` append
    to; they are read anew in every micro-batch. Entries must follow the watermark of those tables.
    """
    previous = counts.select((F.col("minute") + 1).cast("int").alias("minute"), *SEGMENT, F.col("count").alias("cars"))
    cell = ["minute", *SEGMENT]
    joined = entries.join(lav, cell, "left").join(previous, cell, "left")
    lav_value = F.coalesce("lav", F.lit(0))
    toll = toll_formula(lav_value, F.coalesce("cars", F.lit(0)), lav_threshold, car_threshold)
    return joined.select("seq", "vid", lav_value.cast("int").alias("speed"), toll.cast("int").alias("toll"))


def with_accident_time(accidents: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Accidents (``minute`` and segment) with the end of their minute as event time, and the watermark."""
    end = F.timestamp_seconds(F.col("minute") * 60 + ROAD_START)
    return accidents.withColumn("event_time", end).withWatermark("event_time", lateness)


def blocked_segments(accidents: DataFrame) -> DataFrame:
    """Segments and minutes without tolls, each once: an accident blocks its segment and the four before it in the next minute."""
    step = F.when(F.col("direction") == 0, F.lit(-1)).otherwise(F.lit(1))
    segment = F.col("segment").cast("int")
    reach = F.sequence(segment, segment + step * ACCIDENT_SEGMENTS, step).cast("array<smallint>")
    minute = (F.col("minute") + 1).cast("int").alias("minute")
    spread = accidents.select(minute, "xway", "direction", F.explode(reach).alias("segment"), "event_time")
    return spread.dropDuplicates(["minute", *SEGMENT, "event_time"])


def _in_minute(entries: DataFrame, state: DataFrame, *values: str) -> DataFrame:
    """``entries`` with the state of their minute and segment, null where there is none.

    The state of a minute has a time from one microsecond before its start on. So an entry waits until the watermark has passed
    it: by then the state of its minute is final, and only then it goes on without a partner.
    """
    right = state.select(*[F.col(c).alias(f"_{c}") for c in ("minute", *SEGMENT)], *values, F.col("event_time").alias("_time"))
    same = [F.col(c) == F.col(f"_{c}") for c in ("minute", *SEGMENT)]
    same += [F.col("event_time") >= F.col("_time"), F.col("event_time") <= F.col("_time") + F.expr("interval 60 seconds")]
    on = same[0]
    for more in same[1:]:
        on = on & more
    return entries.join(right, on, "left_outer").drop(*[f"_{c}" for c in ("minute", *SEGMENT)], "_time")


def tolls(
    positions: DataFrame,
    accidents: DataFrame | None = None,
    lav_threshold: int = LAV_THRESHOLD,
    car_threshold: int = CAR_THRESHOLD,
    idle: int = IDLE,
) -> DataFrame:
    """Toll notifications end to end from one stream of reports, and one of accidents if there is one.

    ``seq vid speed toll event_time`` for each segment a vehicle enters, once the watermark has passed the entry. Nothing is read
    but the streams: LAV and counts are windows over the same reports, and meet the entries in outer joins with a time
    range. An accident that comes late, but within the watermark, still waives the tolls it should.
    """
    entries = segment_changes(positions, idle)
    rated = _in_minute(entries, last_average_speed(average_speed(positions)), "lav")
    counts = count_vehicles(positions, car_threshold).withColumns({"minute": (F.col("minute") + 1).cast("int"), "cars": F.col("count")})
    rated = _in_minute(rated, counts, "cars")
    blocked = F.lit(False)
    if accidents is not None:
        rated = _in_minute(rated, blocked_segments(accidents).withColumn("blocked", F.lit(True)), "blocked")
        blocked = F.coalesce("blocked", F.lit(False))
    lav = F.coalesce("lav", F.lit(0))
    due = toll_formula(lav, F.coalesce("cars", F.lit(0)), lav_threshold, car_threshold)
    return rated.select("seq", "vid", lav.cast("int").alias("speed"), F.when(blocked, 0).otherwise(due).cast("int").alias("toll"), "event_time")


class OwedToll(StatefulProcessor):
    """The toll a vehicle owes: its last one, cleared by a zero toll or by an exit."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owed = handle.getValueState("owed", "seq long, toll int")
        self.latest = handle.getValueState("latest", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Of all batches of rows only the last message counts.
        seq, toll = max(max(zip(part["seq"], part["toll"])) for part in rows)
        if self.latest.exists() and self.latest.get()[0] > seq:
            return
        self.latest.update((int(seq),))
        if toll > 0:
            self.owed.update((int(seq), int(toll)))
        elif self.owed.exists():
            self.owed.clear()
        else:
            return
        yield pd.DataFrame({"vid": [int(key[0])], "seq": [int(seq)], "toll": [int(toll)]})

    def close(self) -> None:
        pass


def last_toll(messages: DataFrame) -> DataFrame:
    """``vid seq toll`` whenever the toll that a vehicle owes changes; 0 when it owes nothing any more (update mode).

    ``messages`` are tolls (``vid seq toll``) and exits, which are tolls of 0: see :func:`exits`.
    """
    return messages.select("vid", "seq", "toll").groupBy("vid").transformWithStateInPandas(
        statefulProcessor=OwedToll(), outputStructType="vid int, seq long, toll int", outputMode="Update", timeMode="None"
    )


def exits(positions: DataFrame) -> DataFrame:
    """Reports on the exit lane as messages for :func:`last_toll`."""
    return positions.filter(on_exit_lane()).select("vid", "seq", F.lit(0).alias("toll"))
