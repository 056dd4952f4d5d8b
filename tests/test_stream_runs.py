"""A stream that runs until its source holds nothing new, and goes on later from its stored state."""

from datetime import datetime, timedelta

from feaslens.streaming import alerts

SCHEMA = "scenario_id string, ts timestamp, y int, score double"
START = datetime(2024, 1, 1)


def frames(name, values):
    """``values``: (second, y, score)."""
    return [(name, START + timedelta(seconds=t), y, s) for t, y, s in values]


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_state_is_carried_from_run_to_run(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rule = alerts.OnsetRule(threshold=0.5, min_pre_s=2.0, lateness_s=5.0, expire_s=60.0)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        rows = alerts.run_available(alerts.alert_onsets(stream, rule), target).collect()
        return sorted((r.scenario_id, r.event_time_s, r.lead_time_s, r.missed_event, r.valid) for r in rows)

    base = START.timestamp()
    write(spark, source, frames("a", [(0, 0, 0.1), (1, 0, 0.7), (3, 0, 0.2)]) + frames("b", [(0, 0, 0.1), (1, 1, 0.9)]))
    assert run() == []  # nothing is older than the lateness and no scenario has expired
    write(spark, source, frames("a", [(4, 1, 0.9), (6, 1, 0.9)]) + frames("c", [(500, 0, 0.0)]))
    want = [("a", base + 4, 3.0, False, True), ("b", base + 1, None, False, False)]
    assert run() == want
    assert run() == want  # no new files: nothing is written twice
    write(spark, source, frames("d", [(2000, 0, 0.9)]))
    assert run() == want  # an expired scenario without onset leaves no row
