"""A training corpus from ``documents``: five stages, each of which works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import lines, mixture, passages, repetition, similarity
from sievekit.llm.queries import table
from sievekit.session import scratch_path, tune


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is among ``ids``; rows that share an id stay or go together."""
    ids = ids.select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    tune(spark)
    return _kept(docs, repetition.quality_rules(docs, key="doc_id", text="text").where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; what is left without a word goes."""
    tune(spark)
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = lines.drop_repeated_lines(docs, key="doc_id", text="text", also=rest, exact_words=1)
    left = found.where((F.col("n_dropped") == 0) | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: that with the smallest id."""
    tune(spark)
    found = similarity.link_similar(docs, key="doc_id", text="text")
    return _kept(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not quote the benchmark."""
    tune(spark)
    items = table(spark, sf_dir, "benchmark")
    found = passages.find_passages(docs, items, key="doc_id", text="text", item="item_id", passage="text")
    return _kept(docs, found.where("not contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of all sources takes."""
    tune(spark)
    return mixture.mix_sources(docs, key="doc_id", text="text", source="source")


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
]

#: The mix draws by pseudorandom permutations, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    docs = table(tune(spark), sf_dir, "documents")
    place = scratch_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}")
        docs = spark.read.parquet(f"{place}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
