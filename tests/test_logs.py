"""Log parsing, reconstruction and streams on written lines."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sievekit.operators import logs as L
from sievekit.sources import logs as S
from sievekit.streaming import logs as ST

GOOD = [
    {"timestamp": "2026-10-08T03:07:40.000Z", "event": "request_started", "request_id": "r1", "method": "POST", "route": "/a"},
    {"timestamp": "2026-10-08T03:07:40.100Z", "event": "analysis_started", "request_id": "r1", "job_id": "j1", "filename": "f.png"},
    {"timestamp": "2026-10-08T03:07:40.200Z", "event": "segmentation_completed", "job_id": "j1", "duration_ms": 90},
    {"timestamp": "2026-10-08T03:07:40.300Z", "event": "segmentation_completed", "job_id": "j1", "duration_ms": 101},
    {"timestamp": "2026-10-08T03:07:41.000Z", "event": "analysis_completed", "request_id": "r1", "job_id": "j1", "status": "success", "total_processing_ms": 1210, "grain_count": 5},
    {"timestamp": "2026-10-08T03:07:41.120Z", "event": "request_finished", "request_id": "r1", "status_code": 404, "ok": True, "duration_ms": 1120},
    {"timestamp": "2026-10-08T03:08:00Z", "event": "request_started", "request_id": "r2", "route": "/b"},
    {"timestamp": "2026-10-08T03:08:01Z", "event": "request_failed", "request_id": "r2", "status_code": 500, "error_type": "ValueError", "duration_ms": 10},
    {"timestamp": "2026-10-08T03:08:02Z", "event": "request_finished", "request_id": "r2", "status_code": 200, "ok": True, "duration_ms": 30},
    {"timestamp": "2026-10-08T03:09:00Z", "event": "request_finished", "request_id": "r3", "status_code": 200, "ok": True},
    {"timestamp": "2026-10-08T03:10:00Z", "event": "analysis_started", "job_id": "j2"},
    {"timestamp": "2026-10-08T03:10:01Z", "event": "analysis_failed", "job_id": "j2", "failed_stage": "segmentation", "total_processing_ms": 0, "duration_ms": 77},
]


def write_logs(folder):
    """Half the lines in the live file, half in the rotated one, with junk in between."""
    lines = [json.dumps(e) for e in GOOD]
    lines = [x if i % 2 else f"2026-10-08 03:07:48,214 [INFO] service: {x}" for i, x in enumerate(lines)]
    (folder / "app.log").write_text("\n".join(["not json at all", *lines[::2], '{"cut": ']) + "\n")
    (folder / "app.log.1").write_bytes(("\n".join(lines[1::2]) + "\n").encode() + b"\xff\xfe broken {\n")


def events_of(spark, folder):
    parsed = S.scan_logs(spark, str(folder))
    return parsed.withColumn("seq", F.col("place"))


def test_scan_and_audit(spark, tmp_path):
    write_logs(tmp_path)
    assert S.scan_logs(spark, str(tmp_path)).count() == len(GOOD)
    parsed = S.parse_events(S.read_lines(spark, str(tmp_path)), keep=("file",))
    row = S.parse_audit(parsed).first()
    assert tuple(row) == (2, len(GOOD) + 3, len(GOOD), 3, 3)
    capped = S.scan_logs(spark, str(tmp_path), max_records=7)
    # The cap counts good records in file order: all of app.log, then one of app.log.1.
    assert {r[0]: r[1] for r in capped.groupBy("file_seq").count().collect()} == {0: 6, 1: 1}


def test_reconstruction(spark, tmp_path):
    write_logs(tmp_path)
    events = events_of(spark, tmp_path)
    requests = {r["request_id"]: r for r in L.link_requests(L.reconstruct_requests(events), L.job_outcomes(events)).collect()}
    assert set(requests) == {"r1", "r2"}  # r3 never started
    r1, r2 = requests["r1"], requests["r2"]
    assert (r1["ok"], r1["duration_ms"], r1["job_id"], r1["analysis_status"], r1["grain_count"]) == (True, 1120, "j1", "success", 5)
    # The later finish wins, the error text of the failure stays.
    assert (r2["ok"], r2["status_code"], r2["error_type"]) == (True, 200, "ValueError")
    jobs = {r["job_id"]: r for r in L.reconstruct_analyses(events).collect()}
    assert (jobs["j1"]["status"], jobs["j1"]["duration_ms"], jobs["j1"]["filename"]) == ("success", 1210, "f.png")
    assert (jobs["j2"]["status"], jobs["j2"]["failed_stage"], jobs["j2"]["duration_ms"]) == ("failed", "segmentation", 77)
    stats = {r["route"]: r for r in L.endpoint_stats(L.reconstruct_requests(events)).collect()}
    # ok alone is not enough for an endpoint success, but it is for the overview.
    assert (stats["/a"]["success_count"], stats["/b"]["success_count"]) == (0, 1)
    assert L.request_overview(L.reconstruct_requests(events)).first()["successful_requests"] == 2
    assert {r["stage"]: r["duration_ms"] for r in L.stage_timings(events).collect()} == {"segmentation": 95}


def test_second_start_replaces_request(spark):
    rows = [
        (1, "request_started", "GET"), (2, "request_failed", None), (3, "request_started", "PUT"),
    ]
    cols = "seq long, event string, method string"
    df = spark.createDataFrame(rows, cols).withColumns(
        {
            "ts": F.timestamp_seconds("seq"), "request_id": F.lit("r"), "route": F.lit("/x"), "path": F.lit("/x"),
            "status_code": F.lit(500), "duration_ms": F.lit(5), "ok": F.lit(False), "error_type": F.lit("E"), "error_message": F.lit(""),
        }
    )
    got = L.reconstruct_requests(df).collect()
    assert len(got) == 1 and got[0]["method"] == "PUT" and got[0]["finished_at"] is None and got[0]["error_type"] == ""


def test_strict_json_and_number_kinds(spark):
    lines = {
        '{"event":"a","duration_ms":5}': (True, 5),
        '{"event":"a","duration_ms":5.5}': (True, None),
        '{"event":"a","duration_ms":true}': (True, 1),
        '{"event":"a","duration_ms":"7"}': (True, None),
        '{"event":"a"} junk': (False, None),
        '{"event":"a"}, {"b":1}': (False, None),
        '{"event":"a"}][{"b":2}': (False, None),
        '{"event":"a","k":[{"z":1}]}': (True, None),
        "no brace": (False, None),
        "{} {}": (False, None),
    }
    df = spark.createDataFrame([(k,) for k in lines], "value string")
    got = {r["value"]: (r["well_formed"], r["duration_int"]) for r in S.parse_events(df).collect()}
    assert got == lines


def test_round_trip_of_emitted_events(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (2, "y", 9)], "seq long, event string, duration_ms long").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000.25))
    )
    S.emit_events(df, str(tmp_path / "app.log"))
    back = {r["event"]: r for r in S.scan_logs(spark, str(tmp_path)).collect()}
    assert back["x"]["duration_ms"] is None and back["y"]["duration_ms"] == 9
    assert "duration_ms" not in back["x"]["value"] and '"2023-11-14T22:13:20.250Z"' in back["x"]["value"]


def test_stream_late_rows_and_open_starts(spark, tmp_path):
    """Four files, one batch each: a late start is dropped, an unanswered start gets nulls."""
    schema = "ts timestamp, event string, request_id string, duration_ms long"
    batches = [
        [(60, "request_started", "a"), (100, "request_finished", "a")],
        [(6000, "request_started", "b")],
        [(6100, "request_started", "d")],  # late rows are judged by the batch before
        [(61, "request_started", "late"), (12000, "request_started", "c"), (12000, "request_finished", "zz")],
    ]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(s, e, k) for s, e, k in rows], "s long, event string, request_id string")
        out = df.select(F.timestamp_seconds("s").alias("ts"), "event", "request_id", F.lit(1).cast("long").alias("duration_ms"))
        out.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"batch={i}"))
    stream = lambda: spark.readStream.schema(schema + ", batch int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rate = ST.run_available(ST.stream_rate(stream()), "rate")
    seconds = {int(r["minute"].timestamp()): r["requests"] for r in rate.collect()}
    assert seconds.get(60) == 1 and seconds.get(6000) == 1
    starts = stream().where("event = 'request_started'")
    ends = stream().where("event = 'request_finished'")
    pairs = {r["request_id"]: r["end_event"] for r in ST.run_available(ST.stream_pairing(starts, ends), "pairs").collect()}
    assert pairs["a"] == "request_finished" and pairs.get("b", "absent") is None


def test_files_feed_the_log_operators(spark, tmp_path):
    from sievekit.operators.logs import endpoint_stats, reconstruct_requests
    from sievekit.sources.logs import scan_logs

    assert scan_logs(spark, str(tmp_path)).count() == 0
    start = '{"timestamp": "2026-01-01T00:00:00Z", "event": "request_started", "request_id": "r", "route": "/a"}'
    end = '{"timestamp": "2026-01-01T00:00:00Z", "event": "request_finished", "request_id": "r", "route": "/a", "ok": true, "status_code": 200, "duration_ms": 12}'
    (tmp_path / "app.log.1").write_text(start + "\n")
    (tmp_path / "app.log").write_text(end + "\nno json here\n")
    stats = endpoint_stats(reconstruct_requests(scan_logs(spark, str(tmp_path)))).collect()
    assert len(stats) == 1 and stats[0]["route"] == "/a"
