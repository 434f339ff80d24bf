"""Call scoring on unbounded streams of call records.

One keyed operator per caller holds the known callees and the four decayed rates, another per number holds
the rate of received calls; both are joined by call and time. Rates are held at
the latest answer time seen: a call that comes late is added with the weight it has by then, and reads the rates of that
time. Within a micro-batch calls are put in order of answer time and ``call_id``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillstone.functions.decay import AVERAGE_AGE, WARM_UP, block_seconds, global_average, rate_constant
from rillstone.operators.voip import BETA, BETA_24, acd_score, fofir_score, pre_rcr, total_score, url_score

LATENESS = "10 minutes"
# Seconds for which a caller's callee stays known; a multiple of it is never the time of another timer.
CALLEE_MEMORY = 90 * 86_400
RATES = "answer_ts long, ecr double, ecr24 double, encr double, ct24 double"


def with_event_time(calls: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return calls.withColumn("event_time", F.timestamp_seconds("answer_ts")).withWatermark("event_time", lateness)


class CallerRates(StatefulProcessor):
    """Known callees and decayed rates of one caller.

    A callee is known if the caller has called it in the ``memory`` seconds before, by answer time; after that it is new
    again. Two kinds of timers bound the state: one drops rates without weight, one at each multiple of ``memory`` drops
    callees that are no longer known.
    """

    def __init__(self, memory: int) -> None:
        self.memory = memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.callees = handle.getMapState("callees", "callee string", "seen long")
        self.rates = handle.getValueState("rates", RATES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values("call_id")
        # One look-up and one update for each callee of the batch; within it, the call before tells.
        at, by_callee = calls["answer_ts"].astype("int64"), calls.groupby("callee", sort=False)["answer_ts"]
        before, latest = by_callee.shift(), by_callee.cummax().astype("int64")
        first, last = before.isna(), ~calls.duplicated("callee", keep="last")
        seen = {c: self.callees.getValue((c,))[0] for c in calls["callee"][first] if self.callees.containsKey((c,))}
        kept = calls["callee"].map(seen).astype("float64")
        highest = pd.concat([by_callee.cummax().groupby(calls["callee"]).shift(), kept], axis=1).max(axis=1)
        calls["new_callee"] = ~(highest >= at - self.memory)
        for callee, ts in zip(calls["callee"][last], latest[last]):
            self.callees.updateValue((callee,), (max(int(ts), seen.get(callee, 0)),))
        sweep = self.memory * 1000
        now = max(int(at.max()) * 1000, timerValues.getCurrentWatermarkInMs())
        self.handle.registerTimer((now // sweep + 1) * sweep)
        calls = calls[calls["established"]].sort_values(["answer_ts", "call_id"])
        if not len(calls):
            return
        slow, fast = rate_constant(BETA_24), rate_constant(BETA)
        t, ecr, ecr24, encr, ct24 = self.rates.get() if self.rates.exists() else (None, 0.0, 0.0, 0.0, 0.0)
        out = []
        for now, new, duration in zip(calls["answer_ts"], calls["new_callee"], calls["duration"]):
            last, t = (int(now) if t is None else t), max(int(now), int(now) if t is None else t)
            keep, keep24 = math.exp(-fast * (t - last)), math.exp(-slow * (t - last))
            late, late24 = math.exp(-fast * (t - int(now))), math.exp(-slow * (t - int(now)))
            ecr, ecr24 = ecr * keep + fast * late, ecr24 * keep24 + slow * late24
            encr, ct24 = encr * keep + (fast * late if new else 0.0), ct24 * keep24 + (slow * late24 * duration if new else 0.0)
            out.append((ecr, ecr24, encr if new else math.nan, ct24 if new else math.nan))
        self.rates.update((t, ecr, ecr24, encr, ct24))
        for timer in list(self.handle.listTimers()):
            if timer % sweep:
                self.handle.deleteTimer(timer)
        self.handle.registerTimer((t + block_seconds(BETA_24)) * 1000 + 1)
        features = pd.DataFrame(out, columns=["ecr", "ecr24", "encr", "ct24"], index=calls.index)
        yield pd.concat([calls[["call_id", "caller", "answer_ts", "new_callee"]], features, calls[["event_time"]]], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, sweep = expiredTimerInfo.getExpiryTimeInMs(), self.memory * 1000
        if at % sweep:
            self.rates.clear()
            return iter(())
        pairs = [(key_of[0], seen[0]) for key_of, seen in self.callees.iterator()]
        gone = [callee for callee, seen in pairs if seen + self.memory < at // 1000]
        for callee in gone:
            self.callees.removeKey((callee,))
        if len(gone) < len(pairs):
            self.handle.registerTimer(at + sweep)
        return iter(())

    def close(self) -> None:
        pass


def caller_features(calls: DataFrame, memory: int = CALLEE_MEMORY) -> DataFrame:
    """Established calls with ``new_callee`` and the caller's rates; encr and ct24 are NaN on other calls.

    A callee is known for ``memory`` seconds, see :class:`CallerRates`.
    """
    return (
        calls.select("call_id", "caller", "callee", "answer_ts", "duration", "established", "event_time")
        .groupBy("caller")
        .transformWithStateInPandas(
            statefulProcessor=CallerRates(memory),
            outputStructType="call_id long, caller string, answer_ts long, new_callee boolean, ecr double, ecr24 double, "
            "encr double, ct24 double, event_time timestamp",
            outputMode="Append",
            timeMode="EventTime",
            eventTimeColumnName="event_time",
        )
    )


class ReceivedRate(StatefulProcessor):
    """Decayed rate of calls received by a number; a call by the number reads it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rate = handle.getValueState("rate", "answer_ts long, rcr double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["answer_ts", "call_id", "adds"])
        decay = rate_constant(BETA)
        t, rate = self.rate.get() if self.rate.exists() else (None, 0.0)
        read = []
        for now, adds in zip(events["answer_ts"], events["adds"]):
            last, t = (int(now) if t is None else t), max(int(now), int(now) if t is None else t)
            rate *= math.exp(-decay * (t - last))
            read.append(rate)
            rate += decay * math.exp(-decay * (t - int(now))) if adds else 0.0
        self.rate.update((t, rate))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((t + block_seconds(BETA)) * 1000)
        reads = events.assign(rcr=read)[~events["adds"]]
        if len(reads):
            yield reads[["call_id", "rcr", "event_time"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rate.clear()
        return iter(())

    def close(self) -> None:
        pass


def rcr(calls: DataFrame) -> DataFrame:
    """Rate of established calls received by the caller before each established call."""
    both = pre_rcr(calls.filter("established").select("call_id", "caller", "callee", "answer_ts", "event_time"))
    events = both.select("key", "call_id", "answer_ts", (F.col("role") == "callee").alias("adds"), "event_time")
    return events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=ReceivedRate(),
        outputStructType="call_id long, rcr double, event_time timestamp",
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName="event_time",
    )


def rated_calls(calls: DataFrame) -> DataFrame:
    """Established calls with the caller's rates and the received rate, joined by call and time."""
    return _joined(caller_features(calls), rcr(calls))


class GlobalAverage(StatefulProcessor):
    """Moving average over all calls in order of answer time and ``call_id``.

    Calls wait in a list until the watermark has passed their time, so late ones within it still take their place; what
    is released together is put in order, and the average goes on from one number. One instance sees every call,
    as an average of all calls in their order must, but of each only three numbers, and of no batch more than one.
    """

    def __init__(self, age: float) -> None:
        self.decay = 2.0 / (age + 1.0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.average = handle.getValueState("average", "state double")
        self.waiting = handle.getListState("waiting", "call_id long, duration double, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            at = part["event_time"].astype("datetime64[ms]").astype("int64")
            self.waiting.appendList(list(zip(part["call_id"].astype("int64").tolist(), part["duration"].astype("float64").tolist(), at.tolist())))
        return self._released(timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._released(timerValues.getCurrentWatermarkInMs())

    def _released(self, watermark: int) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=["call_id", "duration", "at"])
        ready = held["at"] <= watermark
        rest = held[~ready]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(rest):
            self.handle.registerTimer(int(rest["at"].min()))
        if not ready.any():
            return
        if len(rest):
            self.waiting.put(list(rest.itertuples(index=False, name=None)))
        else:
            self.waiting.clear()
        due = held[ready].sort_values(["at", "call_id"])
        state, out = self.average.get()[0] if self.average.exists() else 0.0, []
        for x in due["duration"]:
            if state < WARM_UP:
                state += x
            elif state == WARM_UP:
                state = state / WARM_UP
            else:
                state = x * self.decay + state * (1.0 - self.decay)
            out.append(state if state > WARM_UP else 0.0)
        self.average.update((float(state),))
        yield pd.DataFrame({"call_id": due["call_id"].to_numpy(), "global_acd": out, "event_time": pd.to_datetime(due["at"].to_numpy(), unit="ms")})

    def close(self) -> None:
        pass


def global_acd(calls: DataFrame, age: float = AVERAGE_AGE) -> DataFrame:
    """``call_id global_acd event_time`` of every call, once the watermark has passed it."""
    slim = calls.select(F.lit(0).alias("all"), "call_id", F.col("duration").cast("double").alias("duration"), "event_time")
    return slim.groupBy("all").transformWithStateInPandas(
        statefulProcessor=GlobalAverage(age), outputStructType="call_id long, global_acd double, event_time timestamp",
        outputMode="Append", timeMode="EventTime", eventTimeColumnName="event_time",
    )


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one call from both sides, whose state goes once the watermark has passed the call."""
    right = right.withColumnsRenamed({"call_id": "_id", "event_time": "_time"})
    same = (F.col("call_id") == F.col("_id")) & (F.col("event_time") == F.col("_time"))
    return left.join(right, same).drop("_id", "_time")


def scores(calls: DataFrame, memory: int = CALLEE_MEMORY) -> DataFrame:
    """``call_id caller answer_ts fofir url acd score event_time`` of established calls to new callees, end to end.

    Rates, received rates and the average of all calls are three stateful operators over one stream, joined by call and
    time; a score comes out once the watermark has passed its call. Scores that are not numbers are left out.
    """
    new = caller_features(calls, memory).filter("new_callee")
    rated = _joined(_joined(new, rcr(calls)), global_acd(calls))
    ratios = rated.select(
        "call_id", "caller", "answer_ts",
        fofir_score(F.col("ecr"), F.col("rcr")).alias("fofir"),
        url_score(F.col("encr"), F.col("ecr")).alias("url"),
        acd_score(F.col("ct24"), F.col("ecr24"), F.col("global_acd")).alias("acd"),
        "event_time",
    )
    value = total_score(F.col("fofir"), F.col("url"), F.col("acd"))
    return ratios.withColumn("score", value).filter(~F.isnan("score"))


class GlobalAverageSink:
    """Micro-batch sink that extends the moving average of all calls and writes it to ``path``.

    Calls of a micro-batch are averaged in parallel blocks. The average after each micro-batch is kept in
    ``path/state/<batch>``, so a repeated micro-batch starts from the same value and writes the same rows.
    ``call_id`` must not go back between micro-batches.
    """

    def __init__(self, path: str, **blocks: int) -> None:
        self.path = str(PurePosixPath(path)) if path.startswith("/") else path.rstrip("/")
        self.blocks = blocks

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        start = 0.0
        if batch_id > 0:
            start = spark.read.parquet(f"{self.path}/state/{batch_id - 1}").first()["state"]
        averaged = global_average(batch, "call_id", "duration", "global_acd", start=start, state="_state", **self.blocks)
        target = f"{self.path}/averages/batch={batch_id}"
        averaged.write.mode("overwrite").parquet(target)
        last = spark.read.parquet(target).agg(F.coalesce(F.max_by("_state", "call_id"), F.lit(start)).alias("state"))
        last.write.mode("overwrite").parquet(f"{self.path}/state/{batch_id}")
