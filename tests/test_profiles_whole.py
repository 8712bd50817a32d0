"""Every part row becomes a profile with a verdict."""

from __future__ import annotations

import __spark_entry__ as entry
from sievekit.plans import testbed as T

SF = "/root/testdata/sf0.001"


def test_validate_profile_keeps_all_rows(spark):
    keys = [r["p_partkey"] for r in T.table(spark, SF, "part").select("p_partkey").collect()]
    got = [r["sample_id"] for r in entry.queries()["validate_profile"](spark, SF).collect()]
    assert sorted(got) == sorted(k if k % 3 < 2 else -k for k in keys)
