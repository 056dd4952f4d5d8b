"""Structured Streaming jobs over rolling frames: alert onsets with lead time, and windowed risk roll-ups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ONSET_SCHEMA = "scenario_id string, event_time_s double, first_alert_time_s double, lead_time_s double, missed_event boolean, valid boolean"
STATE_SCHEMA = "t0 double, saw_zero boolean, alert double, done boolean, pend_t array<double>, pend_y array<int>, pend_s array<double>, mark double"


@dataclass(frozen=True)
class OnsetRule:
    threshold: float
    min_pre_s: float = 2.0
    lateness_s: float = 10.0
    expire_s: float = 60.0


def _onset_fn(rule: OnsetRule):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Holds frames back until the lateness has passed, then walks them in time order.

        Only unsettled frames are kept, so the state is bounded by the frames of one lateness span.
        """
        t0, saw_zero, alert, done, pt, py, ps, mark = state.get if state.exists else (None, False, None, False, [], [], [], None)
        pt, py, ps = list(pt or []), list(py or []), list(ps or [])
        if state.hasTimedOut:
            watermark = float("inf")
        else:
            for pdf in batches:
                pt += pdf["t"].astype(float).tolist()
                py += pdf["y"].astype(int).tolist()
                ps += pdf["score"].astype(float).tolist()
            watermark = state.getCurrentWatermarkMs() / 1000.0
        frames = sorted(zip(pt, py, ps))
        settled = [f for f in frames if f[0] <= watermark]
        rest = [f for f in frames if f[0] > watermark]
        out = []
        for t, y, s in settled:
            if done:
                break
            t0 = t if t0 is None else t0
            if y == 1 and saw_zero:
                valid = t - t0 >= rule.min_pre_s
                has = alert is not None
                out.append((key[0], t, alert if valid else None, t - alert if valid and has else None, bool(valid and not has), bool(valid)))
                done = True
                break
            saw_zero = saw_zero or y == 0
            if alert is None and s >= rule.threshold:
                alert = t
        if state.hasTimedOut:
            state.remove()
        else:
            if done:
                rest = []
            last = max([mark or 0.0, *[f[0] for f in frames]])
            state.update((t0, saw_zero, alert, done, [f[0] for f in rest], [f[1] for f in rest], [f[2] for f in rest], last))
            state.setTimeoutTimestamp(int(max(last + rule.expire_s, watermark + 0.001) * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["scenario_id", "event_time_s", "first_alert_time_s", "lead_time_s", "missed_event", "valid"])
    return step


def alert_onsets(frames: DataFrame, rule: OnsetRule) -> DataFrame:
    """Onset, first alert before it and lead time per scenario; frames later than the watermark are dropped.

    ``frames`` has ``scenario_id``, ``ts`` (event time), ``y`` and ``score``. Times come out as epoch seconds.
    """
    rows = frames.withWatermark("ts", f"{int(rule.lateness_s)} seconds").select(
        "scenario_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("y").cast("int").alias("y"), F.col("score").cast("double").alias("score"))
    return rows.groupBy("scenario_id").applyInPandasWithState(_onset_fn(rule), ONSET_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def risk_rollup(frames: DataFrame, kind: str, size: str, slide: str | None = None, threshold: float = 0.5, lateness: str | None = None, keys: tuple[str, ...] = ("scenario_id",)) -> DataFrame:
    """Mean, maximum and alert count per key and tumbling, sliding or session window. Works on streams (with ``lateness``) and on tables."""
    rows = frames.withWatermark("ts", lateness) if lateness else frames
    win = F.session_window("ts", size) if kind == "session" else F.window("ts", size, slide) if kind == "sliding" else F.window("ts", size)
    agg = rows.groupBy(*keys, win.alias("w")).agg(
        F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.sum((F.col("score") >= threshold).cast("bigint")).alias("alerts"), F.count("*").alias("n_frames"))
    return agg.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "mean_score", "max_score", "alerts", "n_frames")


def run_available(result: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that its source holds now and returns what it has written to ``folder`` so far.

    A later call with the same folder goes on from the stored offsets and state; each row is written once.
    """
    job = result.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    job.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{folder}/rows")
