"""Hand-computed cases for the tolling operators."""

import pytest

from rillstone.operators import linear_road as lr
from rillstone.operators import parsing
from rillstone.plans import linear_road as plan

SCHEMA = (
    "seq long, time int, vid int, speed int, xway int, lane smallint, direction smallint, segment smallint, "
    "position int, minute smallint"
)


def reports(spark, rows):
    """Rows (seq, time, vid, speed, lane, direction, segment)."""
    full = [(s, t, v, sp, 0, la, d, sg, sg * 5280, t // 60 + 1) for s, t, v, sp, la, d, sg in rows]
    return spark.createDataFrame(full, SCHEMA)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_a_return_to_a_segment_is_another_stay(spark):
    pos = reports(spark, [(0, 0, 1, 50, 0, 0, 7), (1, 10, 1, 61, 0, 0, 7), (2, 20, 1, 40, 0, 0, 8), (3, 30, 1, 30, 0, 0, 7)])
    assert got(lr.average_speed(pos), "seq", "segment", "avg_speed") == [(0, 7, 55), (2, 8, 40), (3, 7, 30)]


def test_stays_end_with_the_minute_and_follow_seq(spark):
    pos = reports(spark, [(5, 59, 1, 10, 0, 0, 7), (4, 58, 1, 21, 0, 0, 7), (6, 60, 1, 90, 0, 0, 7)])
    assert got(lr.average_speed(pos), "seq", "minute", "avg_speed") == [(4, 1, 15), (6, 2, 90)]


def test_as_run_releases_the_report_before(spark):
    pos = reports(spark, [(0, 0, 1, 50, 0, 0, 7), (3, 61, 2, 60, 0, 1, 8)])
    assert got(lr.average_speed(pos, "as_run"), "seq", "vid", "minute", "segment", "avg_speed") == [(3, 1, 1, 7, 50)]
    counts = lr.count_vehicles(pos, "as_run")
    assert got(counts, "seq", "minute") == [(0, -1), (3, 1)]


@pytest.mark.parametrize("n", [1, 2, 7])
def test_the_job_as_run_sends_3n_minus_1(spark, n):
    pos = reports(spark, [(i, i, i, 50, 0, 0, 7) for i in range(n)])
    assert plan.job_as_run(pos).count() == 3 * n - 1


def test_lav_spans_five_minutes(spark):
    pos = reports(spark, [(m, m * 60, 1, 10 * (m + 1), 0, 0, 7) for m in range(7)])
    lav = lr.last_average_speed(lr.average_speed(pos))
    assert got(lav, "minute", "lav") == [(2, 10), (3, 15), (4, 20), (5, 25), (6, 30), (7, 40), (8, 50)]


def test_lav_truncates_and_skips_empty_minutes(spark):
    pos = reports(spark, [(0, 0, 1, 10, 0, 0, 7), (1, 0, 2, 11, 0, 0, 7), (2, 600, 1, 99, 0, 0, 7)])
    assert got(lr.last_average_speed(lr.average_speed(pos)), "minute", "lav") == [(2, 10), (12, 99)]


def test_running_lav_uses_the_first_eleven(spark):
    pos = reports(spark, [(i, 0, i, i * 10, 0, 0, 7) for i in range(14)])
    lav = got(lr.running_last_average_speed(lr.average_speed(pos)), "seq", "lav")
    assert lav[0] == (0, 0) and lav[3] == (3, 15) and lav[10] == (10, 50) and lav[13] == (13, 50)


def cars(n, first_seq=0, vid=100, time=0, speed=10, segment=7):
    return [(first_seq + i, time, vid + i, speed, 0, 0, segment) for i in range(n)]


@pytest.mark.parametrize("n, toll", [(50, 0), (51, 2), (60, 200)])
def test_toll_by_cars_of_the_minute_before(spark, n, toll):
    pos = reports(spark, [*cars(n), (1000, 60, 1, 10, 0, 0, 7)])
    assert [r for r in got(plan.tolls(pos), "seq", "speed", "toll") if r[0] == 1000] == [(1000, 10, toll)]


@pytest.mark.parametrize("speed, toll", [(49, 2), (50, 0)])
def test_toll_by_lav(spark, speed, toll):
    pos = reports(spark, [*cars(51, speed=speed), (1000, 60, 1, 10, 0, 0, 7)])
    assert got(plan.tolls(pos), "seq", "toll")[-1] == (1000, toll)


def test_counts_keep_more_than_fifty_and_progress_fills_in(spark):
    pos = reports(spark, [*cars(51), *cars(50, 100, time=60)])
    assert got(lr.count_vehicles(pos), "minute", "count") == [(1, 51)]
    assert got(lr.count_progress(pos), "minute", "xway", "count") == [(2, None, None)]


def test_no_new_notification_in_the_same_segment_or_on_the_exit(spark):
    pos = reports(
        spark,
        [(0, 0, 1, 10, 0, 0, 7), (1, 30, 1, 10, 4, 0, 8), (2, 60, 1, 10, 0, 0, 7), (3, 90, 1, 10, 0, 0, 8), (4, 95, 2, 1, 4, 0, 8)],
    )
    assert got(lr.segment_changes(pos), "seq") == [(0,), (3,)]


def test_accidents_block_five_segments(spark):
    accidents = spark.createDataFrame([(1, 0, 1, 2), (1, 0, 0, 10)], "minute smallint, xway int, direction smallint, segment smallint")
    blocked = got(lr.blocked_segments(accidents), "minute", "direction", "segment")
    assert blocked == [(2, 0, s) for s in range(6, 11)] + [(2, 1, s) for s in range(2, 7)]
    west = lambda s, seg: (s, 60, s, 10, 0, 1, seg)
    east = lambda s, seg: (s, 60, s, 10, 0, 0, seg)
    pos = reports(spark, [west(0, 1), west(1, 2), west(2, 6), west(3, 7), east(4, 5), east(5, 6), east(6, 10), east(7, 11)])
    assert got(lr.accident_free(pos, accidents), "seq") == [(0,), (3,), (4,), (7,)]
    none = accidents.limit(0)
    assert lr.accident_free(pos, none).count() == 8


def test_an_accident_waives_the_toll(spark):
    pos = reports(spark, [*cars(51), (1000, 60, 1, 10, 0, 0, 7)])
    accident = spark.createDataFrame([(1, 0, 0, 9)], "minute smallint, xway int, direction smallint, segment smallint")
    assert got(plan.tolls(pos, accident), "seq", "toll")[-1] == (1000, 0)


def test_last_toll_is_cleared_by_exit_or_zero(spark):
    pos = reports(spark, [(5, 0, 2, 10, 4, 0, 7)])
    tolls = spark.createDataFrame([(1, 1, 8), (2, 2, 8), (3, 3, 8), (4, 3, 0), (6, 4, 2), (7, 4, 18)], "seq long, vid int, toll int")
    assert got(lr.last_toll(tolls, pos), "vid", "seq", "toll") == [(1, 1, 8), (4, 7, 18)]


def test_empty_input(spark):
    pos = reports(spark, [(0, 0, 1, 10, 0, 0, 7)]).limit(0)
    assert plan.tolls(pos).count() == 0 and plan.job_as_run(pos).count() == 0


def test_unknown_semantics(spark):
    pos = reports(spark, [(0, 0, 1, 10, 0, 0, 7)])
    with pytest.raises(ValueError):
        lr.average_speed(pos, "other")
    with pytest.raises(ValueError):
        lr.toll_notification_pos(pos)


LINES = ["0,30,7,55,0,1,0,42,221760", "2,30,7,55,0,1,0,42,221760", "0,x,7,55,0,1,0,42,221760", "0,30,7", "junk"]


def test_parse_positions(spark):
    good = spark.createDataFrame([(line,) for line in LINES[:2]], "line string")
    assert [tuple(r) for r in parsing.parse_positions(good).collect()] == [(0, 30, 7, 55, 0, 1, 0, 42, 221760, 1)]
    mixed = spark.createDataFrame([(line,) for line in LINES], "line string")
    with pytest.raises(Exception):
        parsing.parse_positions(mixed).collect()
    assert parsing.parse_positions(mixed, mode="permissive").count() == 1
    assert [r[0] for r in parsing.malformed_positions(mixed).orderBy("line").collect()] == LINES[3:4] + LINES[2:3] + LINES[4:]
    with pytest.raises(ValueError):
        parsing.parse_positions(good, mode="lenient")


def test_minutes_of_a_long_stream(spark):
    far = spark.createDataFrame([(2_000_000,), (3_000_000_00,)], "time long").select(lr.minute_of("time").alias("m"))
    assert [r["m"] for r in far.collect()] == [33_334, 5_000_001]


def test_a_toll_over_an_int(spark):
    """40 000 cars: 2 * 39 950^2 does not fit an int, neither as the notification nor as what is owed."""
    pos = reports(spark, [(100_000, 60, 1, 10, 0, 0, 7)])
    cell = ["0 as xway", "cast(0 as smallint) as direction", "cast(7 as smallint) as segment"]
    lav = spark.range(1).selectExpr("2 as minute", *cell, "10 as lav")
    counts = spark.range(1).selectExpr("1 as minute", *cell, "40000 as count")
    tolls = lr.toll_notification_pos(pos, lav, counts)
    assert got(tolls, "vid", "toll") == [(1, 3_192_005_000)]
    assert got(lr.last_toll(tolls, pos), "vid", "toll") == [(1, 3_192_005_000)]
