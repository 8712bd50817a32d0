"""Registered queries on requests, analyses and service statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions import rules as R
from sievekit.operators import logs as L
from sievekit.plans import testbed as T
from sievekit.plans.registry import query
from sievekit.session import checkpointed, discard, scratch_path
from sievekit.sources import logs as S

TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def ts_text(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


# Requests, jobs and analyses in SQL, shared by the twins below.
REQUESTS_CTE = f"""{T.EVENTS_CTE},
starts AS (
  SELECT request_id, max(ord) AS s_ord, arg_max(ROW(method, route, path, ts), ord) AS s FROM ordered_events
  WHERE event = 'request_started' GROUP BY request_id),
ends AS (
  SELECT e.request_id, arg_max(ROW(e.ts, e.status_code, e.duration_ms, e.ok, e.event), e.ord) AS last_end,
    arg_max(ROW(e.error_type, e.error_message), e.ord) FILTER (WHERE e.event = 'request_failed') AS last_fail
  FROM ordered_events e JOIN starts s ON e.request_id = s.request_id AND e.ord > s.s_ord
  WHERE e.event IN ('request_finished', 'request_failed') GROUP BY e.request_id),
requests AS (
  SELECT s.request_id, coalesce(s.s[1], '') AS method, coalesce(s.s[2], '') AS route, coalesce(s.s[3], '') AS path,
    s.s[4] AS started_at, e.last_end[1] AS finished_at, e.last_end[2] AS status_code, e.last_end[3] AS duration_ms,
    coalesce(e.last_end[5] = 'request_finished' AND e.last_end[4], false) AS ok,
    coalesce(e.last_fail[1], '') AS error_type, coalesce(e.last_fail[2], '') AS error_message,
    e.request_id IS NOT NULL AS ended
  FROM starts s LEFT JOIN ends e ON s.request_id = e.request_id),
job_events AS (
  SELECT * FROM ordered_events WHERE event IN ('analysis_started', 'analysis_completed', 'analysis_failed')),
jobs AS (
  SELECT job_id, min(ord) AS first_seen,
    max(ord) FILTER (WHERE event = 'analysis_started') AS s_ord,
    max(ord) FILTER (WHERE event = 'analysis_completed') AS c_ord,
    max(ord) FILTER (WHERE event = 'analysis_failed') AS x_ord
  FROM job_events GROUP BY job_id),
analyses AS (
  SELECT j.job_id, coalesce(s.request_id, '') AS request_id, s.ts AS started_at,
    CASE WHEN c.ord IS NOT NULL THEN c.ts ELSE x.ts END AS completed_at,
    CASE WHEN c.ord IS NOT NULL THEN c.total_processing_ms
      ELSE coalesce(nullif(x.total_processing_ms, 0), x.duration_ms) END AS duration_ms,
    CASE WHEN c.ord IS NOT NULL THEN coalesce(c.status, 'success') WHEN x.ord IS NOT NULL THEN 'failed' ELSE '' END AS status,
    coalesce(c.rice_detected, false) AS rice_detected, coalesce(c.grain_count, 0) AS grain_count,
    coalesce(c.whole_count, 0) AS whole_count, coalesce(c.broken_count, 0) AS broken_count,
    coalesce(c.undetermined_count, 0) AS undetermined_count,
    CASE WHEN c.ord IS NULL THEN coalesce(x.failed_stage, '') ELSE '' END AS failed_stage,
    CASE WHEN c.ord IS NULL THEN coalesce(x.error_type, '') ELSE '' END AS error_type,
    CASE WHEN c.ord IS NULL THEN coalesce(x.error_message, '') ELSE '' END AS error_message,
    coalesce(c.reference_source, '') AS reference_source, coalesce(s.filename, '') AS filename,
    coalesce(c.segmentation_method, '') AS segmentation_method
  FROM jobs j JOIN ordered_events s ON j.s_ord = s.ord LEFT JOIN ordered_events c ON j.c_ord = c.ord
    LEFT JOIN ordered_events x ON j.x_ord = x.ord),
owners AS (
  SELECT j.job_id, j.first_seen, j.c_ord, j.x_ord, coalesce(s.request_id, c.request_id, x.request_id) AS request_id
  FROM jobs j LEFT JOIN ordered_events s ON j.s_ord = s.ord LEFT JOIN ordered_events c ON j.c_ord = c.ord
    LEFT JOIN ordered_events x ON j.x_ord = x.ord),
request_job AS (SELECT request_id, arg_max(job_id, first_seen) AS job_id FROM owners GROUP BY request_id),
linked AS (
  SELECT r.request_id, r.method, r.route, r.path, r.started_at, r.finished_at, r.status_code, r.duration_ms, r.ok,
    coalesce(o.job_id, '') AS job_id,
    CASE WHEN c.ord IS NULL AND x.ord IS NOT NULL THEN coalesce(x.error_type, r.error_type) ELSE r.error_type END AS error_type,
    CASE WHEN c.ord IS NULL AND x.ord IS NOT NULL THEN coalesce(x.error_message, r.error_message) ELSE r.error_message END AS error_message,
    CASE WHEN c.ord IS NOT NULL THEN coalesce(c.status, '') WHEN x.ord IS NOT NULL THEN 'failed' ELSE '' END AS analysis_status,
    CASE WHEN c.ord IS NOT NULL THEN c.total_processing_ms
      WHEN x.ord IS NOT NULL THEN coalesce(nullif(x.total_processing_ms, 0), x.duration_ms) END AS analysis_duration_ms,
    coalesce(c.rice_detected, false) AS rice_detected, coalesce(c.grain_count, 0) AS grain_count,
    coalesce(c.whole_count, 0) AS whole_count, coalesce(c.broken_count, 0) AS broken_count,
    coalesce(c.undetermined_count, 0) AS undetermined_count
  FROM requests r LEFT JOIN request_job q ON r.request_id = q.request_id AND r.ended
    LEFT JOIN owners o ON q.job_id = o.job_id
    LEFT JOIN ordered_events c ON o.c_ord = c.ord LEFT JOIN ordered_events x ON o.x_ord = x.ord)"""


def requests(spark, sf_dir):
    return L.reconstruct_requests(T.log_events(spark, sf_dir))


def analyses(spark, sf_dir):
    return L.reconstruct_analyses(T.log_events(spark, sf_dir))


def linked(spark, sf_dir):
    events = T.log_events(spark, sf_dir)
    return L.link_requests(L.reconstruct_requests(events), L.job_outcomes(events))


_REQ_OUT = f"""request_id, method, route, path, {TS.format('started_at')} AS started_at, {TS.format('finished_at')} AS finished_at,
  status_code, duration_ms, ok, error_type, error_message"""


@query("reconstruct_requests", f"WITH {REQUESTS_CTE} SELECT {_REQ_OUT} FROM requests")
def reconstruct_requests(spark, sf_dir):
    return requests(spark, sf_dir).drop("ended").withColumns(
        {k: ts_text(k) for k in ("started_at", "finished_at")}
    )


@query(
    "reconstruct_analyses",
    f"""WITH {REQUESTS_CTE} SELECT * REPLACE ({TS.format('started_at')} AS started_at, {TS.format('completed_at')} AS completed_at)
FROM analyses""",
)
def reconstruct_analyses(spark, sf_dir):
    return L.newest_first(analyses(spark, sf_dir)).withColumns(
        {k: ts_text(k) for k in ("started_at", "completed_at")}
    )


@query(
    "link_requests",
    f"""WITH {REQUESTS_CTE} SELECT {_REQ_OUT}, job_id, analysis_status, analysis_duration_ms, rice_detected,
  grain_count, whole_count, broken_count, undetermined_count FROM linked""",
)
def link_requests(spark, sf_dir):
    return linked(spark, sf_dir).withColumns({k: ts_text(k) for k in ("started_at", "finished_at")})


@query(
    "last_per_key",
    f"""WITH {T.EVENTS_CTE} SELECT job_id, event, arg_max(seq, ord) AS seq, arg_max(duration_ms, ord) AS duration_ms
FROM ordered_events WHERE starts_with(event, 'analysis') GROUP BY job_id, event""",
)
def last_per_key(spark, sf_dir):
    rows = T.log_events(spark, sf_dir).where(F.col("event").startswith("analysis"))
    return L.last_per_key(rows, ["job_id", "event"], "seq", "duration_ms")


def _stats_sql(col: str) -> str:
    return f"""coalesce(round_even(avg({col}) * 100, 0) / 100, 0.0) AS avg_duration_ms,
  CAST(coalesce(max({col}), 0) AS BIGINT) AS max_duration_ms,
  coalesce(round_even(quantile_cont(CAST({col} AS DOUBLE), 0.5) * 100, 0) / 100, 0.0) AS p50_duration_ms,
  coalesce(round_even(quantile_cont(CAST({col} AS DOUBLE), 0.95) * 100, 0) / 100, 0.0) AS p95_duration_ms"""


ENDPOINTS_SQL = f"""
endpoint_stats AS (
  SELECT coalesce(nullif(route, ''), '/unknown') AS route, count(*) AS request_count,
    count(*) FILTER (WHERE ok AND status_code BETWEEN 200 AND 399) AS success_count,
    count(*) - count(*) FILTER (WHERE ok AND status_code BETWEEN 200 AND 399) AS failure_count,
    round_even(CAST(count(*) FILTER (WHERE ok AND status_code BETWEEN 200 AND 399) AS DOUBLE) / count(*) * 100 * 100, 0) / 100 AS success_rate,
    {_stats_sql('duration_ms')}
  FROM requests GROUP BY coalesce(nullif(route, ''), '/unknown'))"""


@query("endpoint_stats", f"WITH {REQUESTS_CTE}, {ENDPOINTS_SQL} SELECT * FROM endpoint_stats")
def endpoint_stats(spark, sf_dir):
    return L.endpoint_stats(requests(spark, sf_dir))


@query(
    "request_overview",
    f"""WITH {REQUESTS_CTE} SELECT count(*) AS total_requests, count(*) FILTER (WHERE ok) AS successful_requests,
  count(*) - count(*) FILTER (WHERE ok) AS failed_requests,
  round_even(CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) * 100 * 10, 0) / 10 AS success_rate,
  {_stats_sql('duration_ms')} FROM requests""",
)
def request_overview(spark, sf_dir):
    return L.request_overview(requests(spark, sf_dir))


@query(
    "analysis_stats",
    f"""WITH {REQUESTS_CTE} SELECT count(*) AS total_analyses, count(*) FILTER (WHERE status = 'success') AS successful_analyses,
  count(*) - count(*) FILTER (WHERE status = 'success') AS failed_analyses, {_stats_sql('duration_ms')} FROM analyses""",
)
def analysis_stats(spark, sf_dir):
    return L.analysis_stats(analyses(spark, sf_dir))


@query(
    "stage_timings",
    f"""WITH {T.EVENTS_CTE} SELECT replace(event, '_completed', '') AS stage, CAST(floor(avg(duration_ms)) AS BIGINT) AS duration_ms
FROM log_events WHERE event IN ('segmentation_completed', 'geometry_completed') GROUP BY event""",
)
def stage_timings(spark, sf_dir):
    return L.stage_timings(T.log_events(spark, sf_dir), "duration_ms")


_ERRORS = """
dims AS (
  SELECT 'endpoint' AS dimension, coalesce(route, path, 'unknown') AS value, ord FROM ordered_events WHERE event = 'request_failed'
  UNION ALL SELECT 'stage', coalesce(failed_stage, 'unknown'), ord FROM ordered_events WHERE event = 'analysis_failed'
  UNION ALL SELECT 'type', coalesce(error_type, 'Unknown'), ord FROM ordered_events WHERE event IN ('request_failed', 'analysis_failed')),
counted AS (SELECT dimension, value, count(*) AS n, min(ord) AS first FROM dims GROUP BY dimension, value),
error_summary AS (SELECT dimension, value, n FROM counted QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY n DESC, first) <= 10)"""


@query(
    "error_summary",
    f"WITH {T.EVENTS_CTE}, {_ERRORS} SELECT * FROM error_summary",
)
def error_summary(spark, sf_dir):
    return L.error_summary(T.log_events(spark, sf_dir))


@query(
    "error_rates",
    f"""WITH {REQUESTS_CTE},
a AS (SELECT count(*) FILTER (WHERE status = 'failed') AS failed_analyses FROM analyses),
e AS (SELECT count(*) AS total_errors FROM log_events WHERE event IN ('request_failed', 'analysis_failed'))
SELECT count(*) FILTER (WHERE NOT ok) AS failed_requests, max(failed_analyses) AS failed_analyses, max(total_errors) AS total_errors,
  round_even(CAST(max(total_errors) AS DOUBLE) / greatest(count(*), 1) * 100 * 10, 0) / 10 AS error_rate
FROM requests, a, e""",
)
def error_rates(spark, sf_dir):
    events = T.log_events(spark, sf_dir)
    return L.error_rates(L.reconstruct_requests(events), L.reconstruct_analyses(events), events)


@query(
    "memory_metrics",
    f"""WITH {T.EVENTS_CTE} SELECT count(*) > 0 AS available, arg_max(rss_mb, ord) AS current_mb,
  round_even(avg(rss_mb) * 100, 0) / 100 AS avg_mb, max(rss_mb) AS peak_mb
FROM ordered_events WHERE rss_mb IS NOT NULL AND process_id IS NOT NULL""",
)
def memory_metrics(spark, sf_dir):
    return L.memory_metrics(T.log_events(spark, sf_dir))


@query(
    "last_event_time",
    f"WITH {T.EVENTS_CTE} SELECT strftime(max(ts) + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S IST') AS last_event FROM log_events",
)
def last_event_time(spark, sf_dir):
    return L.last_event_time(T.log_events(spark, sf_dir)).select(R.ist_label("last_ts").alias("last_event"))


@query(
    "requests_per_minute",
    f"""WITH {REQUESTS_CTE} SELECT {TS.format("date_trunc('minute', started_at)")} AS minute, count(*) AS requests
FROM requests GROUP BY 1""",
)
def requests_per_minute(spark, sf_dir):
    return L.requests_per_minute(requests(spark, sf_dir)).withColumn("minute", ts_text("minute"))


_CURVE = """
deltas AS (SELECT started_at AS ts, 1 AS d FROM requests UNION ALL SELECT finished_at, -1 FROM requests),
net AS (SELECT ts, sum(d) AS d FROM deltas WHERE ts IS NOT NULL GROUP BY ts),
curve AS (SELECT ts, CAST(sum(d) OVER (ORDER BY ts) AS BIGINT) AS open FROM net)"""


@query(
    "concurrency",
    f"WITH {REQUESTS_CTE}, {_CURVE} SELECT greatest(max(open), 0) AS peak, arg_max(open, ts) AS current FROM curve",
)
def concurrency(spark, sf_dir):
    return L.concurrency(requests(spark, sf_dir))


@query(
    "concurrency_curve",
    f"WITH {REQUESTS_CTE}, {_CURVE} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, open FROM curve",
)
def concurrency_curve(spark, sf_dir):
    return L.concurrency_curve(requests(spark, sf_dir)).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "open"
    )


@query(
    "api_vs_analysis",
    f"""WITH {REQUESTS_CTE},
pairs AS (
  SELECT a.status, coalesce(r.duration_ms, 0) AS api_ms, coalesce(a.duration_ms, 0) AS job_ms
  FROM linked r JOIN analyses a ON r.job_id = a.job_id WHERE r.job_id <> '')
SELECT status, count(*) AS n, CASE WHEN count(DISTINCT api_ms) > 1 THEN round_even(regr_slope(job_ms, api_ms) * 10000, 0) / 10000 END AS slope,
  round_even(regr_intercept(job_ms, api_ms) * 10000, 0) / 10000 AS intercept, round_even(regr_r2(job_ms, api_ms) * 10000, 0) / 10000 AS r2
FROM pairs GROUP BY status""",
)
def api_vs_analysis(spark, sf_dir):
    events = T.log_events(spark, sf_dir)
    jobs = L.job_outcomes(events)
    pairs = L.api_vs_analysis(
        L.link_requests(L.reconstruct_requests(events), jobs), L.reconstruct_analyses(events, jobs)
    )
    return L.duration_trend(pairs).select(
        "status", "n", *[R.rnd(k, 4).alias(k) for k in ("slope", "intercept", "r2")]
    )


@query(
    "filter_events",
    f"""WITH {T.EVENTS_CTE} SELECT seq, event, route FROM log_events
WHERE contains(lower(event), 'failed') AND contains(lower(level), 'err') AND contains(lower(coalesce(nullif(route, ''), path)), 'p')
  AND contains(request_id, 'r-1') AND event IN ('request_failed', 'analysis_failed')""",
)
def filter_events(spark, sf_dir):
    return L.filter_events(
        T.log_events(spark, sf_dir), event="FAILED", level="err", route="P", request_id="r-1", errors_only=True
    ).select("seq", "event", "route")


@query(
    "history_view",
    f"""WITH {REQUESTS_CTE} SELECT strftime(started_at + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S IST') AS timestamp_ist, job_id,
  coalesce(nullif(request_id, ''), '-') AS request_id, coalesce(nullif(filename, ''), '-') AS filename, status,
  coalesce(duration_ms, 0) AS processing_ms, rice_detected, grain_count, whole_count, broken_count, undetermined_count,
  coalesce(nullif(reference_source, ''), '-') AS reference_source, coalesce(nullif(segmentation_method, ''), '-') AS segmentation_method,
  coalesce(nullif(failed_stage, ''), '-') AS failed_stage, coalesce(nullif(error_type, ''), '-') AS error_type
FROM analyses WHERE status = 'failed'""",
)
def history_view(spark, sf_dir):
    return L.history_view(analyses(spark, sf_dir), "failed")


@query(
    "health_state",
    f"""WITH {T.EVENTS_CTE},
h AS (
  SELECT user_id, max(ts) AS last_ts, count(*) AS parsed, count(*) FILTER (WHERE event = 'request_started') AS requests,
    count(*) FILTER (WHERE event IN ('request_failed', 'analysis_failed')) AS errors
  FROM (SELECT split_part(request_id, '-', 2) AS user_id, ts, event FROM log_events) GROUP BY user_id),
n AS (SELECT max(ts) + INTERVAL 10 SECOND AS now FROM log_events)
SELECT user_id, CASE WHEN date_diff('microsecond', last_ts, now) / 1e6 > 90000 THEN 'RED'
    WHEN requests > 0 AND errors * 1.0::DOUBLE / requests > 0.1 THEN 'YELLOW' ELSE 'GREEN' END AS state,
  CASE WHEN date_diff('microsecond', last_ts, now) / 1e6 < 18000 THEN 'fresh'
    WHEN date_diff('microsecond', last_ts, now) / 1e6 < 90000 THEN 'slightly stale' ELSE 'stale' END AS freshness
FROM h, n""",
)
def health_state(spark, sf_dir):
    """Health of every user's stream; ages are scaled by 300 since the table spans weeks."""
    events = T.log_events(spark, sf_dir).withColumn("user_id", F.split_part("request_id", F.lit("-"), F.lit(2)))
    per_user = events.groupBy("user_id").agg(
        F.max("ts").alias("last_ts"),
        F.count("*").alias("parsed"),
        F.count_if(F.col("event") == "request_started").alias("requests"),
        F.count_if(F.col("event").isin("request_failed", "analysis_failed")).alias("errors"),
    )
    now = events.agg((F.max("ts") + F.expr("INTERVAL 10 SECONDS")).alias("now"))
    rows = per_user.join(F.broadcast(now))
    age = (F.col("now").cast("double") - F.col("last_ts").cast("double")) / 300.0
    scaled = F.timestamp_seconds(F.col("now").cast("double") - age)
    return rows.select(
        "user_id",
        R.health_state(scaled, "errors", "requests", "parsed", "now").alias("state"),
        R.freshness(scaled, "now").alias("freshness"),
    )


@query("order_events", f"WITH {T.EVENTS_CTE} SELECT seq, event, {TS.format('ts')} AS ts FROM ordered_events ORDER BY ord")
def order_events(spark, sf_dir):
    return L.order_events(T.log_events(spark, sf_dir)).select("seq", "event", ts_text("ts"))


@query(
    "recent_errors",
    f"""WITH {T.EVENTS_CTE} SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S IST') AS timestamp, event,
  coalesce(request_id, '') AS request_id, coalesce(job_id, '') AS job_id, coalesce(method, '') AS method,
  coalesce(route, path, '') AS route, CAST(status_code AS STRING) AS status, coalesce(failed_stage, '') AS failed_stage,
  coalesce(error_type, '') AS error_type, coalesce(error_message, '') AS error_message, CAST(duration_ms AS STRING) AS duration_ms
FROM ordered_events WHERE event IN ('request_failed', 'analysis_failed') ORDER BY ord DESC LIMIT 50""",
)
def recent_errors(spark, sf_dir):
    return L.recent_errors(T.log_events(spark, sf_dir))


@query(
    "tail_events",
    f"WITH {T.EVENTS_CTE} SELECT seq, event, route FROM ordered_events WHERE contains(event, 'analysis') ORDER BY ord DESC LIMIT 500",
)
def tail_events(spark, sf_dir):
    return L.tail(L.filter_events(T.log_events(spark, sf_dir), event="analysis")).select("seq", "event", "route")


@query(
    "top_endpoints",
    f"""WITH {REQUESTS_CTE}, {ENDPOINTS_SQL}
SELECT * FROM (SELECT 'volume' AS ranking, route, request_count AS n, success_rate FROM endpoint_stats ORDER BY request_count DESC, route LIMIT 3)
UNION ALL
SELECT * FROM (SELECT 'failures', route, failure_count, success_rate FROM endpoint_stats WHERE failure_count > 0 ORDER BY failure_count DESC, route LIMIT 3)""",
)
def top_endpoints(spark, sf_dir):
    return L.top_endpoints(L.endpoint_stats(requests(spark, sf_dir)), 3)


@query(
    "melt_latency",
    f"""WITH {REQUESTS_CTE}, {ENDPOINTS_SQL}
SELECT route, 'avg_duration_ms' AS metric, avg_duration_ms AS ms FROM endpoint_stats
UNION ALL SELECT route, 'p50_duration_ms', p50_duration_ms FROM endpoint_stats
UNION ALL SELECT route, 'p95_duration_ms', p95_duration_ms FROM endpoint_stats
UNION ALL SELECT route, 'max_duration_ms', CAST(max_duration_ms AS DOUBLE) FROM endpoint_stats""",
)
def melt_latency(spark, sf_dir):
    return L.melt_latency(L.endpoint_stats(requests(spark, sf_dir)))


# --- raw lines --------------------------------------------------------------


def raw_lines(spark, sf_dir):
    """Log lines made from the events: even ones carry a logger prefix, some are cut or junk."""
    events = T.log_events(spark, sf_dir)
    fields = [k for k in events.columns if k not in ("ts", "seq")]
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    body = F.to_json(F.struct(stamp, "seq", *fields))
    body = F.when(F.col("seq") % 50 == 0, F.concat(body, F.lit(" trailing"))).otherwise(body)
    body = F.when(F.col("seq") % 61 == 0, F.concat(body, F.lit(', {"second": 1}'))).otherwise(body)
    body = F.when(F.col("seq") % 71 == 0, F.lit("no json here")).otherwise(body)
    prefix = F.when(F.col("seq") % 2 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" [INFO] service: ")))
    return events.select("seq", F.concat(F.coalesce(prefix, F.lit("")), body).alias("value"))


_GOOD = "seq % 50 <> 0 AND seq % 61 <> 0 AND seq % 71 <> 0"


@query(
    "extract_json",
    f"""WITH {T.EVENTS_CTE} SELECT seq, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event, level, request_id, route, status_code, ok,
  duration_ms, duration_ms AS duration_int, error_type FROM log_events WHERE {_GOOD}""",
)
def extract_json(spark, sf_dir):
    lines = checkpointed(raw_lines(spark, sf_dir))  # text at rest, as a log would be
    parsed = S.parse_events(lines, keep=("seq",)).where("well_formed")
    return parsed.select(
        "seq",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
        "event", "level", "request_id", "route", "status_code", "ok", "duration_ms", "duration_int", "error_type",
    )


def written_logs(spark, sf_dir) -> str:
    """The lines as a rotated log: app.log.1 holds the older half."""
    folder = scratch_path(spark, "logs")
    lines = raw_lines(spark, sf_dir)
    lines.where("seq % 2 = 1").select("value").write.text(f"{folder}/app.log")
    lines.where("seq % 2 = 0").select("value").write.text(f"{folder}/app.log.1")
    return folder


@query(
    "scan_logs",
    f"""WITH {T.EVENTS_CTE} SELECT CAST(CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END AS INT) AS file_seq, event, count(*) AS n,
  CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM log_events WHERE {_GOOD} GROUP BY ALL""",
)
def scan_logs(spark, sf_dir):
    events = S.scan_logs(spark, written_logs(spark, sf_dir))
    return events.groupBy("file_seq", "event").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"))


def logged_events(spark, sf_dir):
    """The events as the service leaves them: written in order, rotated once, and read back from the folder."""
    folder = scratch_path(spark, "service-log")
    events = T.log_events(spark, sf_dir)
    half = events.agg(F.percentile_approx("seq", 0.5)).first()[0]
    for name, part in (("app.log.1", events.where(F.col("seq") <= half)), ("app.log", events.where(F.col("seq") > half))):
        S.emit_events(part.orderBy("seq"), f"{folder}/{name}")
    found = checkpointed(S.scan_logs(spark, folder).drop("raw", "value"))  # parsed once for all that a dashboard shows
    discard(spark, folder)
    return found


@query(
    "log_dashboard",
    f"""WITH {REQUESTS_CTE}, {ENDPOINTS_SQL}, {_ERRORS}, {_CURVE}
SELECT 'endpoint' AS section, route AS name, request_count AS n, success_rate AS rate FROM endpoint_stats
UNION ALL SELECT concat('error ', dimension), value, n, NULL FROM error_summary
UNION ALL SELECT 'concurrency', 'peak', greatest(max(open), 0), NULL FROM curve
UNION ALL SELECT 'concurrency', 'current', arg_max(open, ts), NULL FROM curve""",
)
def log_dashboard(spark, sf_dir):
    """From lines on disk to what the dashboard shows of endpoints, errors and concurrency."""
    events = logged_events(spark, sf_dir)
    requests = checkpointed(L.reconstruct_requests(events))
    ends = L.endpoint_stats(requests).select(
        F.lit("endpoint").alias("section"), F.col("route").alias("name"), F.col("request_count").alias("n"), F.col("success_rate").alias("rate")
    )
    errors = L.error_summary(events).select(
        F.concat(F.lit("error "), "dimension"), "value", "n", F.lit(None).cast("double")
    )
    open_now = L.concurrency(requests).select(F.explode(F.create_map(F.lit("peak"), "peak", F.lit("current"), "current")))
    return ends.union(errors).union(open_now.select(F.lit("concurrency"), "key", "value", F.lit(None).cast("double")))


@query(
    "parse_audit",
    f"""WITH {T.EVENTS_CTE} SELECT CAST(2 AS BIGINT) AS files_read, count(*) AS lines_read, count(*) FILTER (WHERE {_GOOD}) AS records_loaded,
  count(*) FILTER (WHERE NOT ({_GOOD})) AS malformed_lines, count(*) FILTER (WHERE NOT ({_GOOD})) AS parse_errors FROM log_events""",
)
def parse_audit(spark, sf_dir):
    """The audit counts rotation members; a member written by Spark is a folder of parts."""
    lines = S.read_lines(spark, written_logs(spark, sf_dir)).drop("file")
    parsed = S.parse_events(lines.withColumn("file", F.col("file_seq")), keep=("file",))
    return S.parse_audit(parsed)


@query(
    "emit_events",
    f"""WITH {T.EVENTS_CTE} SELECT concat('{{"timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), 'Z","event":"', event, '","job_id":"', job_id, '"',
  CASE WHEN route IS NULL THEN '' ELSE concat(',"route":"', route, '"') END, ',"duration_ms":', CAST(duration_ms AS STRING), '}}') AS value FROM log_events""",
)
def emit_events(spark, sf_dir):
    return S.event_lines(T.log_events(spark, sf_dir).select("ts", "event", "job_id", "route", "duration_ms"))


@query(
    "event_time",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts,
  CASE WHEN event_id % 4 = 3 THEN 'N/A' ELSE strftime(date_trunc('second', ts) + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S IST') END AS ist
FROM events""",
)
def event_time(spark, sf_dir):
    rows = T.table(spark, sf_dir, "events")
    suffix = (
        F.when(F.col("event_id") % 4 == 0, "Z").when(F.col("event_id") % 4 == 1, "+05:30").when(F.col("event_id") % 4 == 2, ".125-0800").otherwise("")
    )
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), suffix)
    parsed = rows.select("event_id", R.event_time(text).alias("ts"))
    return parsed.select("event_id", ts_text("ts"), R.ist_label("ts").alias("ist"))
