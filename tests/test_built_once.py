"""Input that a query reads several times is built once, and shuffle width follows the input."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from sievekit import session
from sievekit.plans import testbed as T

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["keep_overlapping", "greedy_nms", "merge_by_iou", "assemble_document", "flatten_document"])
def test_instances_are_numbered_once(spark, name):
    out = entry.queries()[name](spark, SF)
    assert out.count() and not any("lineitem" in f for f in out.inputFiles())


def test_width_follows_the_input(spark, monkeypatch):
    width = "spark.sql.shuffle.partitions"
    before = spark.conf.get(width)
    monkeypatch.setattr(session, "_TARGET_PARTITION_BYTES", 1000)
    try:
        T.instances(spark, SF)
        assert int(spark.conf.get(width)) == -(-session.bytes_of(spark, f"{SF}/lineitem.parquet") // 1000) > int(before)
        spark.conf.set(width, "50000")
        T.instances(spark, SF)
        assert spark.conf.get(width) == "50000"  # what is wide enough stays
    finally:
        spark.conf.set(width, before)
