"""Steps of the near-copy join leave no shuffle files behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.llm import similarity
from sievekit.session import shuffles_end_with_actions

NAME = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffles(spark):
    """Of how many shuffles files are known."""
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def test_shuffles_end_with_their_action(spark, tmp_path):
    before = spark.conf.get(NAME)
    known = shuffles(spark)
    with shuffles_end_with_actions(spark):
        found = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(9).withColumnRenamed("id", "k"), "k")
        found.write.parquet(str(tmp_path / "rows"))
        assert found.checkpoint(eager=True).count() == 7
    assert shuffles(spark) <= known and spark.conf.get(NAME) == before


def test_link_similar_plans_its_steps_so(spark, monkeypatch):
    seen, make = [], similarity.components

    def look(links):
        seen.append(spark.conf.get(NAME))
        return make(links)

    monkeypatch.setattr(similarity, "components", look)
    before = spark.conf.get(NAME)
    rows = [(i, " ".join(f"w{j}" for j in range(20 + i % 2))) for i in range(6)]
    got = similarity.link_similar(spark.createDataFrame(rows, "request_id long, error_message string"))
    assert spark.conf.get(NAME) == before and set(seen) == {"true"}
    assert {r["component_id"] for r in got.collect()} == {0}
    assert got.count() == 6 and len(got.collect()) == 6  # the answer can be asked again
