"""Allow or block the URLs of requests: host and path rules, else gradient-boosted trees on lexical features.

DataFrame functions and the ML library's own stages only; no Python runs on the executors.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.session import checkpointed

FEATURES = (
    "length", "host_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "escapes",
    "suffix_rate", "suffix_count",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` and for null."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest (verdict, rule) that fits, as a struct, or null.

    A rule is ``host/path``. It fits the host and its subdomains if the path starts with its
    own. Of equally long rules the one listed first wins.
    """
    ordered = sorted(rules, key=lambda x: -len(x[1]))
    if not ordered:
        return F.lit(None).cast("struct<verdict:string,rule:string,host:string,path:string>")
    table = F.array(
        *[
            F.struct(
                F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"),
                F.lit(rule.partition("/")[0]).alias("host"), F.lit(rule[len(rule.partition("/")[0]) :]).alias("path"),
            )
            for verdict, rule in ordered
        ]
    )
    fits = F.filter(
        table,
        lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]),
    )
    return F.get(fits, F.lit(0))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    counts = F.transform(chars, lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    bits = F.aggregate(counts, F.lit(0.0), lambda s, k: s + F.when(k > 0, -k / n * F.log2(k / n)).otherwise(0.0))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical_features(df: DataFrame, url: str) -> DataFrame:
    """Length, depth, digit ratio, entropy, parameter and other counts, and the host's last label."""
    text = F.coalesce(F.col(url), F.lit(""))
    host, path = host_and_path(text)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)

    def count(value: Column, char: str) -> Column:
        return (F.length(value) - F.length(F.replace(value, F.lit(char), F.lit("")))).cast("double")

    digits = (F.length(text) - F.length(F.translate(text, string.digits, ""))).cast("double")
    return df.withColumns(
        {
            "length": F.length(text).cast("double"), "host_length": F.length(host).cast("double"),
            "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
            "labels": count(host, ".") + 1, "digit_ratio": F.when(F.length(text) > 0, digits / F.length(text)).otherwise(0.0),
            "entropy": _entropy(text), "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
            "hyphens": count(host, "-"), "escapes": count(text, "%"), "suffix": F.substring_index(host, ".", -1),
        }
    )


def judge_urls(
    requests: DataFrame,
    labelled: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    key: str = "request_id",
    url: str = "path",
    blocked: str = "failed",
    max_labelled: int = 4096,
    trees: int = 10,
    depth: int = 3,
) -> DataFrame:
    """Allow or block the URL of every request.

    ``requests`` has ``key`` (the ``request_id``) and ``url`` (the full URL of its ``path``);
    ``labelled`` has ``url`` and ``blocked``, a boolean (for requests: whether they failed).
    Returns ``key, host, path, rule, verdict, score``. The longest of ``rules`` ((verdict,
    ``host/path``) pairs, a short configured list) that fits decides. Elsewhere trees do, that
    were boosted on lexical features of the labelled URLs: length, depth, digit ratio, entropy,
    parameter counts, and how often and how often blocked the host's last label is among them.

    The trees are fitted on at most ``max_labelled`` labelled rows, those with the smallest
    hashes of their URL; that bounds the training data, not the judged rows nor the counts of
    last labels, which are of all labelled rows. Where these have
    only one class, or none, every URL without a rule is allowed and ``score`` is null.

    A null URL, or one without ``://``, has an empty host and path, fits no rule and is judged
    as an empty text. Labelled rows with nulls are ignored. Repeated rows and null keys stay.
    Only the named columns are read, so other names cannot clash. An empty table gives an
    empty result.
    """
    known = labelled.select(F.col(url).alias("url"), F.col(blocked).cast("double").alias("label")).dropna()
    seen = known.agg(F.count("*").alias("n"), F.avg("label").alias("rate")).first()
    suffixes = lexical_features(known, "url").groupBy("suffix").agg(F.count("*").alias("suffix_n"), F.sum("label").alias("suffix_blocked"))
    suffixes = checkpointed(suffixes)
    known = checkpointed(known.orderBy(F.xxhash64("url"), "url", "label").limit(max_labelled))
    shape = lexical_features(known, "url")
    fitted = known.agg(F.avg("label").alias("rate")).first()

    def complete(df: DataFrame) -> DataFrame:
        # Ten rows of the general rate smooth rare suffixes.
        n, hit = F.coalesce("suffix_n", F.lit(0)), F.coalesce("suffix_blocked", F.lit(0.0))
        return df.join(suffixes, "suffix", "left").withColumns(
            {"suffix_rate": (hit + 10.0 * (seen["rate"] or 0.0)) / (n + 10.0), "suffix_count": F.log1p(n.cast("double"))}
        )

    host, path = host_and_path(F.col("url"))
    rows = requests.select(F.col(key).alias("key"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    if seen["n"] and 0.0 < fitted["rate"] < 1.0:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        model = GBTClassifier(
            labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, maxBins=32, seed=7
        ).fit(vectors.transform(complete(shape)).select("features", "label"))
        rows = model.transform(vectors.transform(complete(lexical_features(rows, "url"))))
        score = F.get(vector_to_array("probability"), F.lit(1))
    else:
        score = F.lit(None).cast("double")
    rows = rows.withColumn("score", score)
    method = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return rows.select(
        F.col("key").alias(key), "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), method).alias("verdict"), "score",
    )

