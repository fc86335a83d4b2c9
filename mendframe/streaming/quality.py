"""Validation over streams: the batch operators run as they are; rates are windowed under a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators.validate import long_errors, validated


def windowed_rates(stream: DataFrame, schema: dict, time: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """start, total, successes, n_errors of each tumbling window; rows later than `late` are left out."""
    checked = validated(stream, schema).withWatermark(time, late)
    sums = checked.groupBy(F.window(time, width)).agg(F.count("*").alias("total"), F.count_if("valid").alias("successes"), F.sum(F.size("errors")).alias("n_errors"))
    return sums.select(F.col("window.start").alias("start"), "total", "successes", "n_errors")


def route(stream: DataFrame, schema: dict, keys: list[str], good: str, bad: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append valid rows to the Parquet folder `good` and the errors of the others to `bad`; a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        both = validated(batch, schema).persist()
        both.where("valid").select(*batch.columns).write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        long_errors(both, keys).write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        both.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def repair_loop(rounds: Callable[[DataFrame], DataFrame], failed: DataFrame, schema: dict, most: int) -> tuple[DataFrame, DataFrame]:
    """(passed, failed) after at most `most` rounds of corrections, each of which turns failed rows into new attempts.

    Rows gain `attempts`. The lineage grows by one round at a time; checkpoint in `rounds` for many rounds.
    """
    names, passed = failed.columns, None
    for attempt in range(1, most + 1):
        tried = validated(rounds(failed).select(*names), schema).withColumn("attempts", F.lit(attempt))
        now = tried.where("valid").select(*names, "attempts")
        passed = now if passed is None else passed.unionByName(now)
        failed = tried.where(~F.col("valid")).select(*names)
    return passed, failed


STATE = "attempts int, codes array<string>, feedback string, done boolean"
OUT = "status string, attempts int, json string, codes array<string>, feedback string"


def guarded_stream(checked: DataFrame, key: str, time: str, retries: int, timeout_seconds: int) -> DataFrame:
    """key, status, attempts, json, codes, feedback over a stream of checked attempts (key, time, valid, json, codes, feedback).

    A key's state is its count, codes and last feedback. An attempt that passes gives "passed"; one
    that fails gives "retry" with the feedback for the next; the last that fails gives "failed",
    with G003 where there is no feedback. A key that hears nothing for `timeout_seconds` of event
    time gives "timeout" with G002. What comes after an end is ignored; so are attempts later
    than the watermark. An attempt in a batch is as good as any other: they are taken by time.
    """
    kind = checked.schema[key].dataType.simpleString()

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, codes, last, done = state.get if state.exists else (0, [], None, False)
        codes, out = list(codes), []
        if state.hasTimedOut:
            if not done:
                out.append(("timeout", n, None, [*codes, "G002"], last))
            state.update((n, codes, last, True))
        else:
            rows = pd.concat(frames).sort_values("_time", kind="stable")
            for r in rows.itertuples(index=False):
                if done:
                    break
                n += 1
                if r.valid:
                    done = True
                    out.append(("passed", n, r.json, codes, None))
                else:
                    codes, last = codes + list(r.codes), r.feedback
                    done = n > retries
                    out.append(("failed", n, None, codes + ["G003"] * (last is None), last) if done else ("retry", n, None, list(r.codes), last))
            state.update((n, codes, last, done))
            if not done:
                state.setTimeoutTimestamp(max(int(rows["_time"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + timeout_seconds * 1000)
        if out:
            yield pd.DataFrame([(keys[0], *o) for o in out], columns=[key, *[c.split(" ")[0] for c in OUT.split(", ")]])

    picked = checked.select(key, F.col(time).alias("_time"), "valid", "json", "codes", "feedback").withWatermark("_time", "0 seconds")
    return picked.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, {OUT}", STATE, "append", "EventTimeTimeout")
