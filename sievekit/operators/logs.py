"""Requests, analyses and service statistics from log events.

Events carry ``ts`` (nullable) and a unique ``seq`` in reading order. "Last" always means
last by (ts, seq) with missing times first, and is taken with max_by, which combines before
the shuffle, so a request id that owns a third of the log is no hot spot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.fixed import FAILURE_EVENTS
from sievekit.functions.rules import Col, c, ist_label, rnd
from sievekit.operators.scaling import bucketed_running_sum, exact_percentiles
from sievekit.session import checkpointed

def read_order() -> Column:
    """Sort key of an event; a missing time sorts before any other."""
    return F.struct("ts", "seq")



def last_of(event: str, *fields: str) -> Column:
    """Struct of ``fields`` and the order of the last such event in the group."""
    hit = F.col("event") == event
    return F.max_by(F.struct(*fields, read_order().alias("ord")), F.when(hit, read_order()))


def last_per_key(events: DataFrame, keys: Sequence[str], *fields: str) -> DataFrame:
    last = F.max_by(F.struct(*fields), read_order())
    return events.groupBy(*keys).agg(last.alias("_l")).select(*keys, "_l.*")


def order_events(events: DataFrame) -> DataFrame:
    return events.orderBy(F.col("ts").asc_nulls_first(), "seq")


# --- reconstruction ---------------------------------------------------------


def reconstruct_requests(events: DataFrame) -> DataFrame:
    """One row per started request. A new start wipes what came before it."""
    rows = events.where(
        F.col("request_id").isNotNull()
        & (F.col("request_id") != "")
        & F.col("event").isin("request_started", "request_finished", "request_failed")
    )
    end = ("ts", "status_code", "duration_ms", "ok", "error_type", "error_message")
    found = rows.groupBy("request_id").agg(
        last_of("request_started", "method", "route", "path", "ts").alias("s"),
        last_of("request_finished", *end).alias("f"),
        last_of("request_failed", *end).alias("x"),
    ).where("s IS NOT NULL")
    fin = F.when(F.col("f.ord") > F.col("s.ord"), F.col("f"))
    bad = F.when(F.col("x.ord") > F.col("s.ord"), F.col("x"))
    found = found.withColumns({"f": fin, "x": bad})
    failed_last = F.col("x").isNotNull() & (F.col("f").isNull() | (F.col("x.ord") > F.col("f.ord")))
    last = F.when(failed_last, F.col("x")).otherwise(F.col("f"))
    found = found.withColumn("e", last)
    return found.select(
        "request_id",
        *[F.coalesce(f"s.{k}", F.lit("")).alias(k) for k in ("method", "route", "path")],
        F.col("s.ts").alias("started_at"),
        F.col("e.ts").alias("finished_at"),
        F.col("e.status_code").alias("status_code"),
        F.col("e.duration_ms").alias("duration_ms"),
        (~failed_last & F.coalesce("e.ok", F.lit(False))).alias("ok"),
        F.coalesce("x.error_type", F.lit("")).alias("error_type"),
        F.coalesce("x.error_message", F.lit("")).alias("error_message"),
        F.col("e").isNotNull().alias("ended"),
    )


_COUNTS = ("grain_count", "whole_count", "broken_count", "undetermined_count")


def job_outcomes(events: DataFrame) -> DataFrame:
    """Last start, completion and failure of every job, and when the job was first seen."""
    rows = events.where(
        F.col("job_id").isNotNull()
        & (F.col("job_id") != "")
        & F.col("event").isin("analysis_started", "analysis_completed", "analysis_failed")
    )
    return rows.groupBy("job_id").agg(
        last_of("analysis_started", "request_id", "ts", "filename").alias("s"),
        last_of(
            "analysis_completed", "request_id", "ts", "status", "total_processing_ms", "rice_detected", *_COUNTS,
            "reference_source", "segmentation_method",
        ).alias("c"),
        last_of(
            "analysis_failed", "request_id", "ts", "total_processing_ms", "duration_ms", "failed_stage",
            "error_type", "error_message",
        ).alias("x"),
        F.min(read_order()).alias("first_seen"),
    )


def _failed_ms() -> Column:
    """A missing or zero total falls back to the plain duration."""
    return F.coalesce(F.nullif(F.col("x.total_processing_ms"), F.lit(0)), F.col("x.duration_ms"))


def reconstruct_analyses(events: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """One row per started job; completed beats failed."""
    jobs = job_outcomes(events) if jobs is None else jobs
    done, bad = F.col("c").isNotNull(), F.col("c").isNull() & F.col("x").isNotNull()

    def text(when: Column, name: str) -> Column:
        return F.coalesce(F.when(when, F.col(name)), F.lit("")).alias(name.split(".")[1])

    millis = F.when(done, F.col("c.total_processing_ms")).when(bad, _failed_ms())
    return jobs.where("s IS NOT NULL").select(
        "job_id",
        F.coalesce("s.request_id", F.lit("")).alias("request_id"),
        F.col("s.ts").alias("started_at"),
        F.when(done, F.col("c.ts")).when(bad, F.col("x.ts")).alias("completed_at"),
        millis.alias("duration_ms"),
        F.when(done, F.coalesce("c.status", F.lit("success"))).when(bad, "failed").otherwise("").alias("status"),
        (done & F.coalesce("c.rice_detected", F.lit(False))).alias("rice_detected"),
        *[F.coalesce(F.when(done, F.col(f"c.{k}")), F.lit(0)).cast("long").alias(k) for k in _COUNTS],
        text(bad, "x.failed_stage"),
        text(bad, "x.error_type"),
        text(bad, "x.error_message"),
        text(done, "c.reference_source"),
        F.coalesce("s.filename", F.lit("")).alias("filename"),
        text(done, "c.segmentation_method"),
    )


def newest_first(analyses: DataFrame) -> DataFrame:
    return analyses.orderBy(F.col("started_at").desc_nulls_last())


def link_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Attach the job of each ended request; of several jobs the last one first seen wins."""
    owner = F.coalesce(*[F.nullif(F.col(f"{e}.request_id"), F.lit("")) for e in ("s", "c", "x")])
    named = jobs.withColumn("request_id", owner).where("request_id IS NOT NULL")
    pick = named.groupBy("request_id").agg(
        F.max_by(F.struct("job_id", "c", "x"), F.col("first_seen")).alias("j")
    )
    out = requests.join(pick, "request_id", "left").withColumn("j", F.when(F.col("ended"), F.col("j")))
    out = out.withColumns({"c": F.col("j.c"), "x": F.col("j.x")})
    done = F.col("c").isNotNull()
    bad = ~done & F.col("x").isNotNull()
    return out.select(
        *[k for k in requests.columns if k not in ("error_type", "error_message", "ended")],
        F.coalesce("j.job_id", F.lit("")).alias("job_id"),
        *[
            F.when(bad, F.coalesce(F.col(f"x.{k}"), F.col(k))).otherwise(F.col(k)).alias(k)
            for k in ("error_type", "error_message")
        ],
        F.when(done, F.coalesce("c.status", F.lit(""))).when(bad, "failed").otherwise("").alias("analysis_status"),
        F.when(done, F.col("c.total_processing_ms")).when(bad, _failed_ms()).alias("analysis_duration_ms"),
        (done & F.coalesce("c.rice_detected", F.lit(False))).alias("rice_detected"),
        *[F.coalesce(F.when(done, F.col(f"c.{k}")), F.lit(0)).cast("long").alias(k) for k in _COUNTS],
    )


# --- statistics -------------------------------------------------------------


def _duration_stats(df: DataFrame, by: Sequence[str], col: str, counts: dict[str, Column]) -> DataFrame:
    """Counts, mean, maximum and exact p50/p95 of whole-millisecond durations."""
    by = list(by)
    df = checkpointed(df)  # reconstructed rows are few beside the events, and read three times
    base = df.groupBy(*by).agg(
        *[expr.alias(name) for name, expr in counts.items()],
        F.coalesce(rnd(F.avg(col)), F.lit(0.0)).alias("avg_duration_ms"),
        F.coalesce(F.max(col), F.lit(0)).cast("long").alias("max_duration_ms"),
    )
    tails = exact_percentiles(df, by, {"p50": (col, 0.5), "p95": (col, 0.95)})
    joined = base.join(tails, by, "left") if by else base.join(F.broadcast(tails), how="left")
    for p in ("p50", "p95"):
        joined = joined.withColumn(f"{p}_duration_ms", F.coalesce(rnd(p), F.lit(0.0))).drop(p)
    return joined


def endpoint_stats(requests: DataFrame) -> DataFrame:
    """Per route; success needs ``ok`` and a status in [200, 400)."""
    rows = requests.select("route", "ok", "status_code", "duration_ms").withColumn("route", F.coalesce(F.nullif(F.col("route"), F.lit("")), F.lit("/unknown")))
    good = F.col("ok") & F.col("status_code").between(200, 399)
    out = _duration_stats(
        rows,
        ["route"],
        "duration_ms",
        {"request_count": F.count("*"), "success_count": F.count_if(F.coalesce(good, F.lit(False)))},
    )
    return out.withColumns(
        {
            "failure_count": F.col("request_count") - F.col("success_count"),
            "success_rate": rnd(F.try_divide(F.col("success_count").cast("double"), F.col("request_count")) * 100.0),
        }
    )


def request_overview(requests: DataFrame) -> DataFrame:
    """Service totals; here success is ``ok`` alone."""
    out = _duration_stats(
        requests.select("ok", "duration_ms"), [], "duration_ms", {"total_requests": F.count("*"), "successful_requests": F.count_if("ok")}
    )
    rate = F.coalesce(F.try_divide(F.col("successful_requests").cast("double"), F.col("total_requests")), F.lit(0.0))
    return out.withColumns(
        {
            "failed_requests": F.col("total_requests") - F.col("successful_requests"),
            "success_rate": rnd(rate * 100.0, 1),
        }
    )


def analysis_stats(analyses: DataFrame) -> DataFrame:
    out = _duration_stats(
        analyses.select("status", "duration_ms"),
        [],
        "duration_ms",
        {"total_analyses": F.count("*"), "successful_analyses": F.count_if(F.col("status") == "success")},
    )
    return out.withColumn("failed_analyses", F.col("total_analyses") - F.col("successful_analyses"))


def stage_timings(events: DataFrame, duration: Col = "duration_int") -> DataFrame:
    """Truncated mean duration per finished stage, whole analyses left out."""
    rows = events.where(
        F.col("event").endswith("_completed") & (F.col("event") != "analysis_completed") & c(duration).isNotNull()
    )
    stage = F.regexp_replace("event", "_completed$", "")
    mean = F.try_divide(F.sum(c(duration)), F.count(c(duration)))
    return rows.groupBy(stage.alias("stage")).agg(
        F.when(mean >= 0, F.floor(mean)).otherwise(F.ceil(mean)).cast("long").alias("duration_ms")
    )


def failures(events: DataFrame) -> DataFrame:
    return events.where(F.col("event").isin(*FAILURE_EVENTS))


def error_summary(events: DataFrame, k: int = 10) -> DataFrame:
    """(dimension, value, n): the k most frequent endpoints, stages and error types.

    Ties go to the value seen first. Each list is a top-k over pre-aggregated counts.
    """
    bad = failures(events)
    request = F.col("event") == "request_failed"
    parts = []
    for dim, rows, value in (
        ("endpoint", bad.where(request), F.coalesce("route", "path", F.lit("unknown"))),
        ("stage", bad.where(~request), F.coalesce("failed_stage", F.lit("unknown"))),
        ("type", bad, F.coalesce("error_type", F.lit("Unknown"))),
    ):
        counted = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(read_order()).alias("first"))
        top = counted.orderBy(F.col("n").desc(), "first").limit(k)
        parts.append(top.select(F.lit(dim).alias("dimension"), "value", "n"))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def error_rates(requests: DataFrame, analyses: DataFrame, events: DataFrame) -> DataFrame:
    r = requests.agg(F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("failed_requests"))
    a = analyses.agg(F.count_if(F.col("status") == "failed").alias("failed_analyses"))
    e = failures(events).agg(F.count("*").alias("total_errors"))
    rate = F.try_divide(F.col("total_errors").cast("double"), F.greatest(F.col("requests"), F.lit(1))) * 100.0
    one_row = r.join(F.broadcast(a)).join(F.broadcast(e))  # three one-row aggregates
    return one_row.select("failed_requests", "failed_analyses", "total_errors", rnd(rate, 1).alias("error_rate"))


def memory_metrics(events: DataFrame) -> DataFrame:
    rows = events.where(F.col("rss_mb").isNotNull() & F.col("process_id").isNotNull()).withColumn(
        "rss", F.col("rss_mb").try_cast("double")
    ).where("rss IS NOT NULL")
    return rows.agg(
        (F.count("*") > 0).alias("available"),
        F.max_by("rss", read_order()).alias("current_mb"),
        rnd(F.avg("rss")).alias("avg_mb"),
        F.max("rss").alias("peak_mb"),
    )


def last_event_time(events: DataFrame) -> DataFrame:
    return events.agg(F.max("ts").alias("last_ts"))


def requests_per_minute(requests: DataFrame) -> DataFrame:
    rows = requests.where("started_at IS NOT NULL")
    return rows.groupBy(F.date_trunc("minute", "started_at").alias("minute")).agg(F.count("*").alias("requests"))


def concurrency_curve(requests: DataFrame) -> DataFrame:
    """Open requests after every instant at which one starts or ends."""
    starts = requests.select(F.col("started_at").alias("ts"), F.lit(1).alias("d"))
    ends = requests.select(F.col("finished_at").alias("ts"), F.lit(-1).alias("d"))
    net = starts.unionAll(ends).where("ts IS NOT NULL").groupBy("ts").agg(F.sum("d").alias("d"))
    return bucketed_running_sum(net, F.col("ts"), F.date_trunc("minute", "ts"), "d", "open")


def concurrency(requests: DataFrame) -> DataFrame:
    return concurrency_curve(requests).agg(
        F.greatest(F.coalesce(F.max("open"), F.lit(0)), F.lit(0)).cast("long").alias("peak"),
        F.coalesce(F.max_by("open", "ts"), F.lit(0)).cast("long").alias("current"),
    )


def api_vs_analysis(requests: DataFrame, analyses: DataFrame) -> DataFrame:
    """Both durations of every job that has a request; missing ones count as 0."""
    pairs = requests.where("job_id <> ''").select("job_id", F.coalesce("duration_ms", F.lit(0)).alias("api_ms"))
    jobs = analyses.select("job_id", "status", F.coalesce("duration_ms", F.lit(0)).alias("job_ms"))
    return pairs.join(jobs, "job_id")


def duration_trend(pairs: DataFrame) -> DataFrame:
    """Least-squares line of analysis on request duration, per analysis status."""
    return pairs.groupBy("status").agg(
        F.count("*").alias("n"),
        F.regr_slope("job_ms", "api_ms").alias("slope"),
        F.regr_intercept("job_ms", "api_ms").alias("intercept"),
        F.regr_r2("job_ms", "api_ms").alias("r2"),
    )


# --- views ------------------------------------------------------------------


def filter_events(
    events: DataFrame,
    event: str = "",
    level: str = "",
    route: str = "",
    job_id: str = "",
    request_id: str = "",
    errors_only: bool = False,
) -> DataFrame:
    """Substring filters: any case for event, level and route, exact case for ids."""

    def has(col: Column, text: str) -> Column:
        return F.contains(F.lower(F.coalesce(col, F.lit(""))), F.lit(text.lower()))

    out = events
    if event:
        out = out.where(has(F.col("event"), event))
    if level:
        out = out.where(has(F.col("level"), level))
    if route:
        out = out.where(has(F.coalesce(F.nullif(F.col("route"), F.lit("")), F.col("path")), route))
    for name, text in (("job_id", job_id), ("request_id", request_id)):
        if text:
            out = out.where(F.contains(F.coalesce(F.col(name), F.lit("")), F.lit(text)))
    return failures(out) if errors_only else out


def tail(events: DataFrame, n: int = 500) -> DataFrame:
    """The last n events, oldest of them first."""
    return events.orderBy(F.col("ts").desc_nulls_last(), F.col("seq").desc()).limit(n).orderBy(
        F.col("ts").asc_nulls_first(), "seq"
    )


def recent_errors(events: DataFrame, n: int = 50) -> DataFrame:
    cols = ("request_id", "job_id", "method")
    return tail(failures(events), n).select(
        ist_label("ts").alias("timestamp"),
        "event",
        *[F.coalesce(k, F.lit("")).alias(k) for k in cols],
        F.coalesce("route", "path", F.lit("")).alias("route"),
        F.coalesce(F.col("status_code").cast("string"), F.lit("")).alias("status"),
        *[F.coalesce(k, F.lit("")).alias(k) for k in ("failed_stage", "error_type", "error_message")],
        F.coalesce(F.col("duration_ms").cast("string"), F.lit("")).alias("duration_ms"),
    )


def history_view(analyses: DataFrame, status: str | None = None) -> DataFrame:
    rows = analyses if status in (None, "All") else analyses.where(F.col("status") == status)

    def dash(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("-")).alias(name)

    return rows.select(
        ist_label("started_at").alias("timestamp_ist"),
        "job_id",
        dash("request_id"),
        dash("filename"),
        "status",
        F.coalesce("duration_ms", F.lit(0)).alias("processing_ms"),
        "rice_detected",
        *_COUNTS,
        dash("reference_source"),
        dash("segmentation_method"),
        dash("failed_stage"),
        dash("error_type"),
    )


def top_endpoints(stats: DataFrame, k: int = 5) -> DataFrame:
    """(ranking, route, n, success_rate): busiest routes, and routes with most failures."""
    volume = stats.orderBy(F.col("request_count").desc(), "route").limit(k)
    failing = stats.where("failure_count > 0").orderBy(F.col("failure_count").desc(), "route").limit(k)
    return volume.select(
        F.lit("volume").alias("ranking"), "route", F.col("request_count").alias("n"), "success_rate"
    ).unionAll(failing.select(F.lit("failures"), "route", "failure_count", "success_rate"))


def melt_latency(stats: DataFrame) -> DataFrame:
    names = ["avg_duration_ms", "p50_duration_ms", "p95_duration_ms", "max_duration_ms"]
    wide = stats.select("route", *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot("route", names, "metric", "ms")
