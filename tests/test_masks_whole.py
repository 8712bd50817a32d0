"""The mask selection query compares all mask pixels."""

from __future__ import annotations

from collections import defaultdict

import __spark_entry__ as entry
from sievekit.plans import testbed as T

SF = "/root/testdata/sf0.001"


def test_greedy_mask_nms_reads_all_pixels(spark):
    masks = defaultdict(set)
    for r in T.pixels(spark, SF).where("mask").select("instance_id", "x", "y").collect():
        masks[r["instance_id"]].add((r["x"] + r["instance_id"] % 3, r["y"]))
    kept = defaultdict(list)
    for i in sorted(masks, key=lambda i: (-(i % 8), i)):
        if all(len(masks[i] & masks[k]) / len(masks[i] | masks[k]) <= 0.5 for k in kept[i % 97]):
            kept[i % 97].append(i)
    got = [(r["canvas"], r["instance_id"]) for r in entry.queries()["greedy_mask_nms"](spark, SF).collect()]
    assert sorted(got) == sorted((c, i) for c, found in kept.items() for i in found)
