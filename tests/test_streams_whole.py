"""Stream queries give all rows, also those that the watermark holds back at the end."""

from __future__ import annotations

from collections import Counter, defaultdict
from datetime import timedelta

import __spark_entry__ as entry
from sievekit.plans import testbed as T

SF = "/root/testdata/sf0.001"


def rows_of(spark, *events):
    found = T.log_events(spark, SF).select("ts", "event", "request_id", "duration_ms").collect()
    return [r for r in found if r["event"] in events]


def test_stream_rate_has_the_last_windows(spark):
    want = Counter(f"{r['ts']:%Y-%m-%d %H:%M}" for r in rows_of(spark, "request_started"))
    got = entry.queries()["stream_rate"](spark, SF).collect()
    assert len(got) == len(want) and {r["minute"]: r["requests"] for r in got} == want


def test_stream_pairing_has_the_open_starts(spark):
    ends = defaultdict(list)
    for e in rows_of(spark, "request_finished", "request_failed"):
        ends[e["request_id"]].append(e)
    want = []
    for s in rows_of(spark, "request_started"):
        hits = [e for e in ends[s["request_id"]] if s["ts"] <= e["ts"] <= s["ts"] + timedelta(hours=12)]
        for e in hits or [None]:
            end = (f"{e['ts']:%Y-%m-%d %H:%M:%S}", e["event"], e["duration_ms"]) if e else (None, None, None)
            want.append((s["request_id"], f"{s['ts']:%Y-%m-%d %H:%M:%S}", *end))
    cols = ("request_id", "started_at", "finished_at", "end_event", "duration_ms")
    got = [tuple(r[c] for c in cols) for r in entry.queries()["stream_pairing"](spark, SF).collect()]
    assert any(w[3] is None for w in want) and sorted(got, key=repr) == sorted(want, key=repr)
