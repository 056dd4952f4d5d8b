"""Files in and out, resume, and streams that must equal the batch result."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from feaslens.operators import leadtime
from feaslens.sources import tables as io
from feaslens.streaming import alerts

DOC = {"sample_id": "d1", "scenario_id": "d1", "ego_index": 0, "agent_count": 2, "agent_ids": [0, 1], "agent_types": [1, 1], "times_s": [0.0, 0.1], "current_xy": [[0, 0], [18, 1.5]],
       "current_vel_xy": [[15, 0], [8, 0]], "current_heading": [0, 0], "current_size_lw": [[4.8, 1.9], [4.6, 1.8]], "future_xy": [[[0, 0], [1.5, 0]], [[18, 1.5], [18.8, 1.4]]],
       "future_vel_xy": [[[15, 0], [15, 0]], [[8, 0], [8, 0]]], "future_heading": [[0, 0], [0, 0]], "future_valid": [[True, True], [True, False]],
       "map_lane_centerlines": [[[-20, 0], [80, 0]], [[-20, 3.5], [80, 3.5]]]}


def test_json_samples(spark, tmp_path):
    for name, text in (("good", json.dumps(DOC)), ("broken", "{not json"), ("short", json.dumps({"sample_id": "d2"}))):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            f.write(text)
    agents, states, lanes, errors = io.read_samples_json(spark, str(tmp_path))
    assert [(r.agent_id, r.is_ego, r.x, r.length) for r in agents.orderBy("agent_ix").collect()] == [("0", True, 0.0, 4.8), ("1", False, 18.0, 4.6)]
    assert states.count() == 4 and states.filter("valid").count() == 3
    assert lanes.count() == 4
    assert sorted(r.status.split(":")[0] for r in errors.collect()) == ["failed", "failed"]


XML = """<?xml version="1.0"?><commonRoad xmlns="http://x" benchmarkID="USA_US101-1"><scenarioTags><urban/><highway/></scenarioTags><lanelet id="1"/><lanelet id="2"/>
<dynamicObstacle id="3"><type>car</type><trajectory><state><time><exact>40</exact></time></state></trajectory></dynamicObstacle><staticObstacle id="4"><type>parkedVehicle</type></staticObstacle>
<planningProblem id="5"/></commonRoad>"""


def test_xml_manifest(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "USA_US101-1.xml").write_text(XML)
    (tmp_path / "bad.xml").write_text("nothing")
    rows = {r.parse_status: r for r in io.scan_xml_manifest(spark, str(tmp_path)).collect()}
    ok = rows["ok"]
    assert (ok.scenario_id, ok.lanelet_count, ok.dynamic_obstacle_count, ok.static_obstacle_count, ok.planning_problem_count, ok.max_time_step) == ("USA_US101-1", 2, 1, 1, 1, 40)
    assert ok.obstacle_types == "car:1;parkedVehicle:1" and ok.tags == "highway|urban"
    assert rows["failed"].lanelet_count is None


def test_sink_resume_fingerprint(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    io.append_pending(df.filter("id < 40"), path, "id")
    io.append_pending(df, path, "id")
    back = spark.read.parquet(path)
    assert back.count() == 100
    assert io.fingerprint(back).first() == io.fingerprint(df.repartition(7)).first()
    assert io.fingerprint(df.filter("id != 5")).first() != io.fingerprint(df).first()
    some, rest, whole = (io.fingerprint(d) for d in (df.filter("id <= 5"), df.filter("id > 5"), df))
    assert io.combined(some.unionByName(rest)).first() == whole.first() and io.combined(whole, rest).first() == some.first()
    assert io.fingerprint(df.unionByName(df)).first().hash != whole.first().hash  # a repeated row counts
    assert set(io.fingerprint(df.limit(0)).first().hash) == {"0"}
    pair = lambda a, b: io.fingerprint(spark.createDataFrame([(a, b)], "x string, y string")).first().hash
    assert len({pair("a", None), pair(None, "a"), pair("an", None), pair("a", ""), pair("", "a"), pair("n", "")}) == 6
    with pytest.raises(FileNotFoundError):
        io.read_table(spark, str(tmp_path / "gone.parquet"))
    preds = spark.createDataFrame([("e1", "f1", 0.5), ("e2", "f1", 0.1)], "endpoint string, feature_set string, score double")
    io.write_predictions(preds, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("endpoint = 'e1'").count() == 1
    io.write_table(preds, str(tmp_path / "t"), io.config_hash({"a": 1}))
    assert spark.read.parquet(str(tmp_path / "t")).select("config_hash").distinct().count() == 1


FRAMES = "scenario_id string, ts timestamp, y int, score double"


def frame_rows():
    out = []
    for s in range(12):
        for k in range(30):
            t = 1_700_000_000 + s * 3 + k * 2
            y = int(k >= 8 + s) if s % 3 else int(k < 2 or k > 20)
            out.append((f"s{s}", t, y if s % 4 else 0, (k * 7 + s * 5) % 23 / 23.0))
    return out


def run_stream(spark, tmp_path, build, name):
    rows = frame_rows()
    src = str(tmp_path / "in")
    late = sorted(rows, key=lambda r: (r[1] + (r[1] * 7 % 5), r[0]))  # shuffled by a few seconds
    for i in range(4):
        part = late[i * len(late) // 4:(i + 1) * len(late) // 4]
        spark.createDataFrame(part, "scenario_id string, t long, y int, score double").select(
            "scenario_id", F.timestamp_seconds("t").alias("ts"), "y", "score").coalesce(1).write.mode("append").parquet(src)
    # A last frame far ahead moves the watermark past everything.
    spark.createDataFrame([("end", rows[-1][1] + 10_000, 0, 0.0)], "scenario_id string, t long, y int, score double").select(
        "scenario_id", F.timestamp_seconds("t").alias("ts"), "y", "score").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).filter("scenario_id != 'end'"), spark.read.parquet(src).filter("scenario_id != 'end'")


def test_onset_stream_equals_batch(spark, tmp_path):
    rule = alerts.OnsetRule(threshold=0.8, min_pre_s=10.0, lateness_s=30)
    got, batch = run_stream(spark, tmp_path, lambda s: alerts.alert_onsets(s, rule), "onset_out")
    frames = batch.select("scenario_id", (F.unix_micros("ts") / 1e6).alias("t"), "y", "score")
    on = leadtime.event_onset(frames, "scenario_id", ["t"], "t", "y", rule.min_pre_s)
    lead = leadtime.lead_time(frames, on, spark.createDataFrame([(0.8,)], "threshold double"), "scenario_id", "t", "score").filter("has_valid_onset")
    want = sorted((r.scenario_id, r.event_time_s, r.first_pre_event_alert_time_s, r.missed_event) for r in lead.collect())
    have = sorted((r.scenario_id, r.event_time_s, r.first_alert_time_s, r.missed_event) for r in got.filter("valid").collect())
    assert want and have == want


@pytest.mark.parametrize("kind,size,slide", [("tumbling", "20 seconds", None), ("sliding", "20 seconds", "10 seconds"), ("session", "5 seconds", None)])
def test_rollup_stream_equals_batch(spark, tmp_path, kind, size, slide):
    build = lambda df, late=None: alerts.risk_rollup(df, kind, size, slide, 0.5, late)
    got, batch = run_stream(spark, tmp_path, lambda s: build(s, "30 seconds"), f"roll_{kind}")
    key = lambda df: sorted((r.scenario_id, r.window_start, r.n_frames, r.alerts, round(r.mean_score, 9)) for r in df.collect())
    assert key(got) == key(build(batch))
