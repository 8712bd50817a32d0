"""Order statistics and numbering that never put one huge key into one task.

A key (sample, route, request) may hold a third of all rows. Rows are therefore counted per
(key, bucket), the bucket being a monotone function of the ordering; only those counts are
accumulated per key, and fine-grained work runs inside one bucket. These are plans like any
other: nothing runs before an action. Operators whose forms for ordinary and huge groups
differ choose by ``by_group_size``, which counts the groups up to ``GROUP_LIMIT`` rows first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions.rules import Col, c
from sievekit.session import checkpointed

# Rows of one group that a single task may hold in memory.
GROUP_LIMIT = 100_000


def by_group_size(
    df: DataFrame,
    by: Sequence[str],
    small: Callable[[DataFrame], DataFrame],
    large: Callable[[DataFrame], DataFrame],
    limit: int | None = None,
) -> DataFrame:
    """``small`` for groups within the limit, ``large`` for the others, results united."""
    limit = GROUP_LIMIT if limit is None else limit
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    if sizes.isEmpty():
        return small(df)
    if not by:
        return large(df)
    hot = checkpointed(sizes.select(*by))
    match = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    rest = df.alias("l").join(hot.alias("r"), match, "left_anti")
    big = df.alias("l").join(hot.alias("r"), match, "left_semi")
    return small(rest).unionByName(large(big))


def log_bucket(value: Col, per_octave: int = 4096) -> Column:
    """Monotone bucket of a double, 1/per_octave octave wide: at most a few 100,000 per key."""
    v = c(value).cast("double")
    # Not-a-number is above all numbers; it may share a bucket with infinity.
    return F.when(F.isnan(v), F.lit(2**63 - 1)).otherwise(
        (F.signum(v) * F.floor(F.log2(F.abs(v) + 1.0) * per_octave)).cast("long")
    )


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null being a key like any other; without keys the right side is one row."""
    if not keys:
        return left.join(F.broadcast(right))
    other = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return left.join(other, same, how).drop(*[f"_k{i}" for i in range(len(keys))])


# --- numbering --------------------------------------------------------------


def row_numbers(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    bucket: Sequence[Column],
    name: str,
    fine: Sequence[Column] = (),
) -> DataFrame:
    """``row_number() over (partition by by order by order)``, one plan for groups of any size.

    ``bucket`` columns are non-decreasing along ``order`` (nulls first), read left to right;
    ``fine`` ones are so inside of one bucket. Rows are counted per key and bucket, only those
    counts are summed up along the key, and rows are sorted where they share key and bucket.
    Without ``fine`` columns the counts of a key are one window, with them one per bucket. The
    input is read twice, the first time only its keys and order. Nothing runs on call.
    """
    coarse = {f"_b{i}": column for i, column in enumerate(bucket)}
    inner = {f"_f{i}": column for i, column in enumerate(fine)}
    outer_key, key = [*by, *coarse], [*by, *coarse, *inner]
    rows = df.withColumns(coarse | inner)

    def before(within: Sequence[str], along: Sequence[str]) -> Column:
        upto = Window.partitionBy(*within).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(upto), F.lit(0))

    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    totals = sizes.groupBy(*outer_key).agg(F.sum("_n").alias("_n")) if inner else sizes
    # A structure equals another one with nulls in the same fields, and is never null itself.
    starts = totals.select(F.struct(*outer_key).alias("_key"), before(by, [*coarse]).alias("_start"))
    if inner:
        offsets = sizes.select(
            F.struct(*key).alias("_fine"), F.struct(*outer_key).alias("_key"), before(outer_key, [*inner]).alias("_offset")
        )
        starts = offsets.join(starts, "_key").select(
            F.col("_fine").alias("_key"), (F.col("_start") + F.col("_offset")).alias("_start")
        )
    place = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    numbered = rows.withColumn("_key", F.struct(*key)).withColumn(name, place).join(starts, "_key")
    return numbered.withColumn(name, (F.col(name) + F.col("_start")).cast("long")).select(
        *[column for column in df.columns if column != name], name
    )


def bucketed_running_sum(df: DataFrame, order: Column, bucket: Column, value: str, name: str) -> DataFrame:
    """Global running sum along a unique ``order``: bucket totals first, then inside buckets."""
    rows = df.withColumn("_b", bucket)
    sizes = rows.groupBy("_b").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(starts, "_b")
        .withColumn(name, F.col("_start") + F.sum(value).over(inside))
        .drop("_b", "_start")
    )


# --- exact percentiles ------------------------------------------------------


def value_counts(df: DataFrame, by: Sequence[str], value: Col) -> DataFrame:
    """(by, v, c): equal values collapse before the shuffle; a hot key spreads over its values."""
    return df.select(*by, c(value).cast("double").alias("v")).where("v IS NOT NULL").groupBy(*by, "v").agg(
        F.count("*").alias("c")
    )


def percentiles_of_counts(
    counts: DataFrame, by: Sequence[str], probs: Mapping[str, float], per_octave: int = 4096
) -> DataFrame:
    """Linear-interpolation percentiles of (by, v, c) rows by bucket selection.

    ``counts`` stands in the plan twice: it ends in a shuffle that Spark reuses, or is a table.
    Null values count for nothing but keep their key: without other values its answer is null.
    """
    key = [*by, "_b"]
    rows = counts.withColumn("_b", log_bucket("v", per_octave))
    sizes = rows.groupBy(*key).agg(F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)).alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    sizes = sizes.withColumns({"_end": F.sum("_n").over(upto), "_total": F.sum("_n").over(whole)})
    last = F.col("_total") - 1
    ranks = F.array_distinct(
        F.array(*[side(last * float(p)) for p in sorted(set(probs.values())) for side in (F.floor, F.ceil)])
    )
    # Keep only the buckets that hold a wanted rank: at most two per probability and key.
    picked = (
        sizes.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_end") - F.col("_n")) & (r < F.col("_end"))))
        .where((F.size("_ranks") > 0) | F.col("_b").isNull())
        .select(F.struct(*key).alias("_key"), "_total", "_ranks", (F.col("_end") - F.col("_n")).alias("_start"))
    )
    fine = Window.partitionBy("_key").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    hits = rows.withColumn("_key", F.struct(*key)).join(picked, "_key")
    hits = hits.withColumn("_upto", F.col("_start") + F.sum("c").over(fine))
    hits = hits.withColumn(
        "_ranks", F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("c")) & (r < F.col("_upto")))
    ).where((F.size("_ranks") > 0) | F.col("v").isNull())

    def at(rank: Column) -> Column:
        return F.max(F.when(F.array_contains("_ranks", rank), F.col("v")))

    found = hits.groupBy(*by).agg(
        F.max("_total").alias("_total"),
        *[at(side(last * float(p))).alias(f"_{tag}_{name}") for name, p in probs.items() for tag, side in (("lo", F.floor), ("hi", F.ceil))],
    )

    def mix(name: str, p: float) -> Column:
        share = last * float(p) - F.floor(last * float(p))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return F.when(low == high, low).when(share == 0.5, (low + high) / 2.0).otherwise(low + (high - low) * share)

    return found.select(*by, *[mix(name, p).alias(name) for name, p in probs.items()])


def exact_percentiles(df: DataFrame, by: Sequence[str], wanted: Mapping[str, tuple[Col, float]]) -> DataFrame:
    """Exact percentiles of several columns per key: ``{name: (column, probability)}``.

    One plan for groups of any size, and nothing runs on call: the input is read once into
    counts of (key, column, value), whose shuffle serves the histogram of buckets that finds
    the buckets of the wanted ranks as well as the values inside of those.
    """
    by, probs = list(by), sorted({p for _, p in wanted.values()})
    tag_of = {p: f"p{i}" for i, p in enumerate(probs)}
    entries = [F.struct(F.lit(i).alias("m"), c(col).cast("double").alias("v")) for i, (col, _) in enumerate(wanted.values())]
    long = df.select(*by, F.explode(F.array(*entries)).alias("_e")).select(*by, F.col("_e.m").alias("_m"), F.col("_e.v").alias("v"))
    counts = long.groupBy(*by, "_m", "v").agg(F.count("*").alias("c"))
    found = percentiles_of_counts(counts, [*by, "_m"], {tag: p for p, tag in tag_of.items()})
    return found.groupBy(*by).agg(
        *[F.max(F.when(F.col("_m") == i, F.col(tag_of[p]))).alias(name) for i, (name, (_, p)) in enumerate(wanted.items())]
    )


def exact_medians(df: DataFrame, by: Sequence[str], values: Mapping[str, Col]) -> DataFrame:
    return exact_percentiles(df, by, {name: (col, 0.5) for name, col in values.items()})
