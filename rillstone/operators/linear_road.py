"""Variable tolling on an expressway: vehicle speeds, segment velocity, vehicle counts and tolls.

Position reports have the columns ``seq time vid speed xway lane direction segment position minute``.
``semantics="spec"`` gives the documented meaning of an operator; ``"as_run"`` gives the literal output of
the original streaming job at parallelism 1, which flushes its per-minute state on every input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions.skew import DEFAULT_SKEW, FIND, Hot, Skew, checked_broadcast, previous, row_numbers, runs

# Fixed values of the benchmark.
EXIT_LANE = 4
LAV_THRESHOLD = 50
CAR_THRESHOLD = 50
LAV_MINUTES = 5
LAV_VALUES = 11
ACCIDENT_SEGMENTS = 4

SEGMENT = ["xway", "direction", "segment"]
REPORT = ["seq", "time", "vid", "speed", "xway", "lane", "direction", "segment", "position", "minute"]
NO_NOTIFICATION = ["cast(null as int) as vid", "cast(null as int) as speed", "cast(null as int) as toll"]


def check_semantics(semantics: str) -> None:
    if semantics not in ("spec", "as_run"):
        raise ValueError(f"unknown semantics: {semantics}")


def minute_of(time: Column | str) -> Column:
    """Minute number of a time in seconds; the first minute is 1."""
    seconds = F.col(time) if isinstance(time, str) else time
    return (F.floor(seconds / 60) + 1).cast("int")


def on_exit_lane(lane: Column | str = "lane") -> Column:
    return (F.col(lane) if isinstance(lane, str) else lane) == EXIT_LANE


def average_speed(
    positions: DataFrame, semantics: str = "spec", skew: Skew = DEFAULT_SKEW, hot: Hot = FIND
) -> DataFrame:
    """Integer mean speed of each vehicle for each stay in a segment within a minute.

    spec: one row per vehicle, minute and run of consecutive reports in one segment; ``seq`` is the first
    report of the run. as_run: every input releases the one before it, so the first input gives nothing.
    """
    check_semantics(semantics)
    columns = ["seq", "vid", "minute", *SEGMENT, "avg_speed"]
    if semantics == "as_run":
        released = {"vid": "vid", "minute": "minute", **{c: c for c in SEGMENT}, "avg_speed": "speed"}
        lagged = previous(positions, [], "seq", {f"_{n}": c for n, c in released.items()}, skew)
        lagged = lagged.filter(F.col("_vid").isNotNull())
        return lagged.select("seq", *[F.col(f"_{n}").alias(n) for n in released]).select(*columns)
    stays = runs(
        positions.select("seq", "vid", "minute", *SEGMENT, "speed"),
        ["vid", "minute"],
        "seq",
        SEGMENT,
        {"speed_sum": F.col("speed").cast("long")},
        skew,
        hot,
    )
    return stays.select(
        F.col("first_seq").alias("seq"), "vid", "minute", *SEGMENT, F.expr("cast(speed_sum div n as int)").alias("avg_speed")
    )


def last_average_speed(
    speeds: DataFrame, semantics: str = "spec", minutes: int = LAV_MINUTES
) -> DataFrame:
    """Latest average velocity (LAV) of a segment, labelled with the minute it applies to.

    spec: integer mean over the stays of the last ``minutes`` minutes, one row per segment and minute with
    data, labelled with the minute after. as_run: segment keys never match in the original job, so each
    input comes back as its own LAV.
    """
    check_semantics(semantics)
    label = (F.col("minute") + 1).cast("int").alias("minute")
    if semantics == "as_run":
        return speeds.select("seq", label, *SEGMENT, F.col("avg_speed").alias("lav"))
    cells = speeds.groupBy("minute", *SEGMENT).agg(F.sum("avg_speed").alias("s"), F.count(F.lit(1)).alias("n"))
    trailing = Window.partitionBy(*SEGMENT).orderBy("minute").rangeBetween(-(minutes - 1), 0)
    sums = cells.select("minute", *SEGMENT, F.sum("s").over(trailing).alias("s"), F.sum("n").over(trailing).alias("n"))
    return sums.select(label, *SEGMENT, F.expr("cast(s div n as int)").alias("lav"))


def running_last_average_speed(
    speeds: DataFrame, minutes: int = LAV_MINUTES, values: int = LAV_VALUES, skew: Skew = DEFAULT_SKEW, hot: Hot = FIND
) -> DataFrame:
    """One LAV per input: the integer mean of the first ``values`` speeds kept for the segment so far.

    Kept are the speeds of the last ``minutes`` minutes up to the input, in ``seq`` order; minutes do not go
    back within a segment. Only the first ``values`` rows of each minute can enter a mean, so the segment
    window sees at most that many per minute; all other rows just look the result up.
    """
    cell = [*SEGMENT, "minute"]
    placed = row_numbers(speeds, cell, "seq", "_pos", skew, hot)
    firsts = placed.filter(F.col("_pos") <= values).select(*cell, "_pos", F.col("avg_speed").cast("long").alias("v"))
    cells = firsts.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("_pos", "v"))).alias("own"))
    trailing = Window.partitionBy(*SEGMENT).orderBy("minute").rangeBetween(-(minutes - 1), 0)
    kept = F.flatten(F.collect_list(F.col("own.v")).over(trailing))
    # Running sums of the first values kept at the end of the minute; the minute's own rows come last.
    sums = F.aggregate(
        F.slice(kept, 1, values),
        F.array().cast("array<bigint>"),
        lambda acc, v: F.concat(acc, F.array(v + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")))),
    )
    lookup = cells.select(*cell, sums.alias("sums"), (F.size(kept) - F.size("own")).alias("earlier"))
    # Both sides are already spread by cell, so the join moves the small side only.
    joined = placed.join(lookup, cell)
    used = F.least(F.col("earlier") + F.col("_pos"), F.lit(values)).cast("int")
    return joined.select(
        "seq",
        (F.col("minute") + 1).cast("int").alias("minute"),
        *SEGMENT,
        used.alias("_n"),
        F.element_at("sums", used).alias("_s"),
    ).select("seq", "minute", *SEGMENT, F.expr("cast(_s div _n as int)").alias("lav"))


def count_cells(positions: DataFrame) -> DataFrame:
    return positions.groupBy("minute", *SEGMENT).agg(F.count(F.lit(1)).cast("int").alias("count"))


def count_vehicles(
    positions: DataFrame, semantics: str = "spec", threshold: int = CAR_THRESHOLD, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Position reports per minute and segment, where there are more than ``threshold``.

    as_run: one progress row per input (null segment) with the minute of the input before, -1 at first.
    """
    check_semantics(semantics)
    if semantics == "spec":
        return count_cells(positions).filter(F.col("count") > threshold)
    lagged = previous(positions.select("seq", "minute"), [], "seq", {"_minute": "minute"}, skew)
    return lagged.select(
        "seq",
        F.coalesce("_minute", F.lit(-1)).cast("int").alias("minute"),
        F.expr("cast(null as int) as xway"),
        F.expr("cast(null as smallint) as direction"),
        F.expr("cast(null as smallint) as segment"),
        F.expr("cast(null as int) as count"),
    )


def count_progress(positions: DataFrame, threshold: int = CAR_THRESHOLD) -> DataFrame:
    """Minutes with reports but no segment above the threshold, as progress rows."""
    busiest = count_cells(positions).groupBy("minute").agg(F.max("count").alias("most"))
    return busiest.filter(F.col("most") <= threshold).select(
        "minute",
        F.expr("cast(null as int) as xway"),
        F.expr("cast(null as smallint) as direction"),
        F.expr("cast(null as smallint) as segment"),
        F.expr("cast(null as int) as count"),
    )


def segment_changes(positions: DataFrame, skew: Skew = DEFAULT_SKEW, hot: Hot = FIND) -> DataFrame:
    """Reports off the exit lane whose segment differs from the vehicle's last report off the exit lane."""
    driving = positions.filter(~on_exit_lane())
    lagged = previous(driving, ["vid"], "seq", {"_segment": "segment"}, skew, hot)
    return lagged.filter(~F.col("segment").eqNullSafe(F.col("_segment"))).drop("_segment")


def blocked_segments(accidents: DataFrame) -> DataFrame:
    """Segments and minutes in which tolls are waived: an accident in the minute before, up to four segments on.

    Downstream is +1 eastbound (direction 0) and -1 westbound. Each accident is spread upstream, so the
    position reports meet it in an equi-join.
    """
    step = F.when(F.col("direction") == 0, F.lit(-1)).otherwise(F.lit(1))
    reach = F.sequence(
        F.col("segment").cast("int"), F.col("segment").cast("int") + step * ACCIDENT_SEGMENTS, step
    )
    spread = accidents.select(
        (F.col("minute") + 1).cast("int").alias("minute"), "xway", "direction", F.explode(reach).alias("segment")
    )
    return spread.withColumn("segment", F.col("segment").cast("smallint")).distinct()


def accident_free(positions: DataFrame, accidents: DataFrame) -> DataFrame:
    """Reports with no accident of the minute before in their segment or the four downstream."""
    return positions.join(checked_broadcast(blocked_segments(accidents)), ["minute", *SEGMENT], "left_anti")


def toll_formula(lav: Column, cars: Column, lav_threshold: int, car_threshold: int) -> Column:
    """The toll as a long: with 32 768 cars over the threshold it no longer fits an int."""
    due = (lav < lav_threshold) & (cars > car_threshold)
    over = (cars - car_threshold).cast("long")
    return F.when(due, 2 * over * over).otherwise(F.lit(0)).cast("long")


def toll_notification_pos(
    positions: DataFrame,
    lav: DataFrame | None = None,
    counts: DataFrame | None = None,
    accidents: DataFrame | None = None,
    semantics: str = "spec",
    lav_threshold: int = LAV_THRESHOLD,
    car_threshold: int = CAR_THRESHOLD,
    skew: Skew = DEFAULT_SKEW,
    hot: Hot = FIND,
) -> DataFrame:
    """Toll notification for every segment a vehicle enters off the exit lane.

    ``speed`` is the LAV of the report's minute (0 if unknown). The toll is 2 (cars - threshold)^2 with the
    cars of the minute before, if the LAV is low, the segment full and no accident is ahead.
    as_run: an empty notification per report.
    """
    check_semantics(semantics)
    if semantics == "as_run":
        return positions.selectExpr("seq", *NO_NOTIFICATION)
    if lav is None or counts is None:
        raise ValueError("spec semantics needs the LAV and count inputs")
    cell = ["minute", *SEGMENT]
    parts = [
        lav.select(*cell, F.col("lav"), F.expr("cast(null as int) as cars"), F.lit(False).alias("blocked")),
        counts.select(
            (F.col("minute") + 1).cast("int").alias("minute"),
            *SEGMENT,
            F.expr("cast(null as int) as lav"),
            F.col("count").alias("cars"),
            F.lit(False).alias("blocked"),
        ),
    ]
    if accidents is not None:
        parts.append(
            blocked_segments(accidents).select(
                *cell, F.expr("cast(null as int) as lav"), F.expr("cast(null as int) as cars"), F.lit(True).alias("blocked")
            )
        )
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    state = union.groupBy(*cell).agg(F.max("lav").alias("lav"), F.max("cars").alias("cars"), F.max("blocked").alias("blocked"))
    entered = segment_changes(positions, skew, hot).join(state, cell, "left")
    lav_value = F.coalesce("lav", F.lit(0))
    toll = F.when(F.coalesce("blocked", F.lit(False)), F.lit(0)).otherwise(
        toll_formula(lav_value, F.coalesce("cars", F.lit(0)), lav_threshold, car_threshold)
    )
    return entered.select(
        "seq",
        "vid",
        lav_value.cast("int").alias("speed"),
        toll.alias("toll"),
        F.struct("time", "speed", "xway", "lane", "direction", "segment", "position").alias("pos"),
    )


def toll_notification_las(lav: DataFrame, semantics: str = "as_run") -> DataFrame:
    """as_run: an empty notification per LAV. spec: the last LAV of each minute and segment."""
    check_semantics(semantics)
    if semantics == "as_run":
        return lav.selectExpr("seq", *NO_NOTIFICATION)
    return lav.groupBy("minute", *SEGMENT).agg(F.max_by("lav", "seq").alias("lav"))


def toll_notification_cv(counts: DataFrame, semantics: str = "as_run") -> DataFrame:
    """as_run: an empty notification per count. spec: the last count of each minute and segment, no progress rows."""
    check_semantics(semantics)
    if semantics == "as_run":
        return counts.selectExpr("seq", *NO_NOTIFICATION)
    return counts.filter("xway is not null").groupBy("minute", *SEGMENT).agg(F.max("count").alias("count"))


def last_toll(notifications: DataFrame, positions: DataFrame) -> DataFrame:
    """The toll each vehicle still owes: its last one, unless a zero toll or an exit followed."""
    tolls = notifications.select("vid", "seq", "toll")
    exits = positions.filter(on_exit_lane()).select("vid", "seq", F.lit(0).alias("toll"))
    latest = tolls.unionByName(exits).groupBy("vid").agg(F.max_by(F.struct("toll", "seq"), "seq").alias("last"))
    return latest.select("vid", F.col("last.seq").alias("seq"), F.col("last.toll").alias("toll")).filter("toll > 0")
