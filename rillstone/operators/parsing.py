"""Text lines to typed records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.operators.linear_road import minute_of

# Field order of the two line formats.
POSITION_FIELDS = [
    ("type", "smallint"),
    ("time", "int"),
    ("vid", "int"),
    ("speed", "int"),
    ("xway", "int"),
    ("lane", "smallint"),
    ("direction", "smallint"),
    ("segment", "smallint"),
    ("position", "int"),
]
CALL_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"


def _check_mode(mode: str) -> None:
    if mode not in ("failfast", "permissive"):
        raise ValueError(f"unknown mode: {mode}")


def _field(parts: Column, i: int, kind: str, mode: str) -> Column:
    if mode == "failfast":
        return parts[i].cast(kind)
    return F.get(parts, F.lit(i)).try_cast(kind)


def parse_positions(lines: DataFrame, line: str = "line", mode: str = "failfast") -> DataFrame:
    """Position reports (type 0) from comma-separated lines; other columns are kept.

    ``failfast`` raises on a malformed line; ``permissive`` drops it (see :func:`malformed_positions`).
    """
    _check_mode(mode)
    kept = [c for c in lines.columns if c != line]
    parts = F.split(line, ",")
    kind = _field(parts, 0, "smallint", mode)
    typed = lines.filter(kind == 0).select(
        *kept, *[_field(parts, i, t, mode).alias(n) for i, (n, t) in enumerate(POSITION_FIELDS)]
    )
    if mode == "permissive":
        typed = typed.dropna(subset=[n for n, _ in POSITION_FIELDS])
    return typed.withColumn("minute", minute_of("time"))


def malformed_positions(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that ``permissive`` parsing drops although they are not of another type."""
    parts = F.split(line, ",")
    kind = _field(parts, 0, "smallint", "permissive")
    bad = [_field(parts, i, t, "permissive").isNull() for i, (_, t) in enumerate(POSITION_FIELDS)]
    broken = bad[0]
    for column in bad[1:]:
        broken = broken | column
    return lines.filter(kind.isNull() | ((kind == 0) & broken))


def sorted_positions(lines: DataFrame, line: str = "line") -> DataFrame:
    """Every line once, with its ``outcome``: ``kept`` (fields set), ``malformed`` or ``other`` (another type; both with null fields).

    One parse gives what :func:`parse_positions` keeps and :func:`malformed_positions` sets aside.
    """
    parts = F.split(line, ",")
    kind = _field(parts, 0, "smallint", "permissive")
    fields = {n: _field(parts, i, t, "permissive") for i, (n, t) in enumerate(POSITION_FIELDS)}
    broken = reduce(lambda a, b: a | b, [c.isNull() for c in fields.values()])
    outcome = F.when(kind.isNull() | ((kind == 0) & broken), "malformed").when(kind == 0, "kept").otherwise("other")
    rows = lines.withColumn("_parsed", F.struct(outcome.alias("outcome"), *[c.alias(n) for n, c in fields.items()]))
    is_kept = F.col("_parsed.outcome") == "kept"
    out = [F.when(is_kept, F.col(f"_parsed.{n}")).alias(n) for n in fields]
    return rows.select(*lines.columns, F.col("_parsed.outcome").alias("outcome"), *out).withColumn("minute", minute_of("time"))


def _call_fields(line: str, mode: str) -> list[Column]:
    parts = F.split(line, ",")
    to_time = F.to_timestamp if mode == "failfast" else F.try_to_timestamp
    text = (lambda i: parts[i]) if mode == "failfast" else (lambda i: F.get(parts, F.lit(i)))
    return [
        text(0).alias("caller"),
        text(1).alias("callee"),
        F.unix_seconds(to_time(text(2), F.lit(CALL_TIME_FORMAT) if mode == "permissive" else CALL_TIME_FORMAT)).alias("answer_ts"),
        _field(parts, 3, "int", mode).alias("duration"),
        (F.lower(text(4)) == "true").alias("established"),
    ]


CALL_FIELDS = ["caller", "callee", "answer_ts", "duration", "established"]


def parse_calls(lines: DataFrame, line: str = "line", mode: str = "failfast") -> DataFrame:
    """Call records from comma-separated lines: numbers, answer time (epoch seconds), duration, established.

    Only the word "true", in any case, means established. ``malformed_calls`` has the lines that the permissive mode
    leaves out.
    """
    _check_mode(mode)
    kept = [c for c in lines.columns if c != line]
    typed = lines.select(*kept, *_call_fields(line, mode))
    return typed.dropna(subset=CALL_FIELDS) if mode == "permissive" else typed


def malformed_calls(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines that permissive parsing leaves out, as they are."""
    fields = _call_fields(line, "permissive")
    broken = reduce(lambda a, b: a | b, [field.isNull() for field in fields])
    return lines.filter(broken)
