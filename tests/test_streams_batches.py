"""Streams in several batches, with late rows, equal the answer over all rows at once."""

from __future__ import annotations

import random
import time
from collections import Counter
from datetime import datetime, timedelta

from sievekit.streaming import logs as ST

SCHEMA = "request_id string, event string, ts timestamp, duration_ms bigint"
T0 = datetime(2024, 3, 1, 12)


def batches(spark, folder, parts):
    """One file per batch, taken one at a time in this order."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken by the second in which they came
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def parts_of(seed, late):
    """Events of two hours in batches of twenty minutes; some come up to ``late`` minutes after their batch."""
    rng, out = random.Random(seed), [[] for _ in range(6)]
    for i in range(400):
        minute = rng.randint(0, 119)
        at = T0 + timedelta(minutes=minute, seconds=rng.randint(0, 59))
        event = rng.choice(["request_started", "request_started", "request_finished", "request_failed"])
        key = "hot" if rng.random() < 0.3 else rng.choice([f"r{i % 40}", None])
        due = min(5, (minute + rng.choice([0, 0, late])) // 20)
        out[due].append((key, event, at, None if event == "request_started" else rng.randint(1, 9)))
    return [p for p in out if p]


def brute_pairs(rows, bound):
    out = Counter()
    for key, event, at, _ in rows:
        if event == "request_started":
            hits = [e for e in rows if e[1] != "request_started" and key is not None and e[0] == key and at <= e[2] <= at + bound]
            for e in hits or [None]:
                out[(key, at, *((e[2], e[1], e[3]) if e else (None, None, None)))] += 1
    return out


def test_pairing_in_batches(spark, tmp_path):
    parts, bound = parts_of(1, 15), timedelta(minutes=25)
    rows = [r for p in parts for r in p]
    stream = batches(spark, str(tmp_path / "in"), parts)
    starts, ends = stream.where("event = 'request_started'"), stream.where("event <> 'request_started'")
    left = []

    def still_open(spark, state):
        left.append(ST.open_starts(spark, state))
        return left[0]

    out = ST.run_available(ST.stream_pairing(starts, ends, bound, "40 minutes"), "test", still_open=still_open)
    assert 0 < left[0].count() < out.where("end_event IS NULL").count()  # some starts were closed by timers, not at the end
    assert not any(str(tmp_path) + "/in" in f for f in out.inputFiles())
    want = brute_pairs(rows, bound)
    fields = ("request_id", "started_at", "finished_at", "end_event", "duration_ms")
    assert Counter(tuple(r[f] for f in fields) for r in out.collect()) == want and max(want.values()) >= 1


def test_rate_in_batches(spark, tmp_path):
    parts = parts_of(2, 15)
    rows = [r for p in parts for r in p]
    stream = batches(spark, str(tmp_path / "in"), parts)
    closed = ST.run_available(ST.stream_rate(stream, "30 minutes", "10 minutes"), "test", still_open=ST.open_windows)
    want = Counter(at - timedelta(minutes=at.minute % 10, seconds=at.second) for _, event, at, _ in rows if event == "request_started")
    assert {r["minute"]: r["requests"] for r in closed.collect()} == want


def test_pairing_of_nothing_and_without_times(spark, tmp_path):
    parts = [[("a", "request_started", None, None), ("a", "request_finished", T0, 1), ("b", "request_started", T0, None)], []]
    stream = batches(spark, str(tmp_path / "in"), parts)
    starts, ends = stream.where("event = 'request_started'"), stream.where("event <> 'request_started'")
    out = ST.run_available(ST.stream_pairing(starts, ends), "test", still_open=ST.open_starts)
    assert [(r["request_id"], r["end_event"]) for r in out.collect()] == [("b", None)]


def test_pairing_keeps_its_state_in_the_engine(spark, tmp_path):
    parts = [[(f"r{i}", e, T0 + timedelta(seconds=i), 5) for i in range(50) for e in ("request_started", "request_finished")]]
    stream = batches(spark, str(tmp_path / "in"), parts)
    starts, ends = stream.where("event = 'request_started'"), stream.where("event <> 'request_started'")
    operators = []

    def still_open(spark, state):
        operators.extend(r["operatorName"] for r in spark.read.format("state-metadata").load(state).select("operatorName").distinct().collect())
        return ST.open_starts(spark, state)

    out = ST.run_available(ST.stream_pairing(starts, ends), "test", still_open=still_open)
    assert operators == ["symmetricHashJoin"]  # a call per key into Python did not end on a million starts
    assert out.where("duration_ms = 5").count() == 50 and out.count() == 50
