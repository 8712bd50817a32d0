"""Registered queries on documents, exports, archives, file checks and streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from sievekit.functions import rules as R
from sievekit.operators import instances as I
from sievekit.plans import testbed as T
from sievekit.plans.instance_queries import INST, r
from sievekit.plans.log_queries import written_logs
from sievekit.plans.reference_queries import LABELLED_CTE, LENGTHS_ONLY, labelled
from sievekit.plans.registry import query
from sievekit.session import scratch_path, stored
from sievekit.sources import images as IM
from sievekit.sources import sinks as SK
from sievekit.streaming import logs as ST


def documents(spark, sf_dir):
    rows = labelled(spark, sf_dir, ids=True).withColumns(
        {"status": F.col("broken_label"), "effective_length": R.rnd("length_px"), "lb_ratio": R.rnd(R.lb_ratio("length_px", "breadth_px"))}
    )
    rows = stored(rows.drop("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "p_size"), "labelled")
    grains = I.row_numbers(rows.where("category_id = 1"), ["sample_id"], [F.col("grain_id")], [F.floor(F.col("grain_id") / 65536)], "n")
    grains = grains.drop("grain_id").withColumnRenamed("n", "grain_id")
    foreign = I.row_numbers(
        rows.where("category_id = 2"), ["sample_id"], [F.col("grain_id")], [F.floor(F.col("grain_id") / 65536)], "foreign_id"
    ).select("sample_id", "foreign_id", "x", "y", "w", "h", "area")
    totals = rows.groupBy("sample_id").agg(F.count("*").alias("total_count"), F.count_if(F.col("status") == "broken").alias("broken_count"))
    return SK.assemble_document(grains, foreign, totals, part_size=20)


_DOC_CTE = f"""{LENGTHS_ONLY}, {LABELLED_CTE},
g AS (SELECT *, row_number() OVER (PARTITION BY sample_id, category_id ORDER BY grain_id) AS n FROM labelled),
p AS (SELECT sample_id, CAST(floor((n - 1) / 20) AS INT) AS part, count(*) FILTER (WHERE category_id = 1) AS grains, count(*) FILTER (WHERE category_id = 2) AS foreign_n,
  CAST(coalesce(sum(area) FILTER (WHERE category_id = 2), 0) AS BIGINT) AS foreign_area, coalesce(string_agg(substr(broken_label, 1, 1), '' ORDER BY n) FILTER (WHERE category_id = 1), '') AS labels FROM g GROUP BY ALL),
s AS (SELECT sample_id, count(*) AS total, count(*) FILTER (WHERE broken_label = 'broken') AS broken FROM labelled GROUP BY sample_id)"""


@query(
    "assemble_document",
    f"""{INST}, {_DOC_CTE} SELECT p.sample_id, part, CAST(grains AS INT) AS grains, CAST(foreign_n AS INT) AS foreign_n, foreign_area, labels,
  CASE WHEN part = 0 THEN total END AS total_count, CASE WHEN part = 0 THEN broken END AS broken_count FROM p JOIN s ON p.sample_id = s.sample_id""",
)
def assemble_document(spark, sf_dir):
    """Documents in parts of at most 20 rows, told by their sizes, order and sums."""
    return documents(spark, sf_dir).select(
        "sample_id",
        "part",
        F.size("grains").alias("grains"),
        F.size("foreign_matter").alias("foreign_n"),
        F.aggregate("foreign_matter", F.lit(0).cast("bigint"), lambda a, f: a + f["area"]).alias("foreign_area"),
        F.concat_ws("", F.transform("grains", lambda g: F.substr(g["status"], F.lit(1), F.lit(1)))).alias("labels"),
        "summary.total_count",
        "summary.broken_count",
    )


@query(
    "flatten_document",
    f"""{INST}, {_DOC_CTE} SELECT sample_id, n AS grain_id, broken_label AS status, {r('length_px', 2)} AS effective_length, {r('ratio')} AS length_ratio,
  breadth_px, {r('length_px / breadth_px', 2)} AS lb_ratio, area, x, y, w, h FROM g WHERE category_id = 1""",
)
def flatten_document(spark, sf_dir):
    flat = SK.flatten_document(documents(spark, sf_dir)).where("grain_id IS NOT NULL")
    return flat.drop("confidence", "quality")


def _export(spark, sf_dir):
    rows = T.instances(spark, sf_dir, ids=True).withColumns(
        {
            "confidence_label": R.confidence_band("confidence"),
            "length_mm": F.when(F.col("p_size") % 2 == 0, F.col("length_px") / 16),
            "breadth_mm": F.when(F.col("p_size") % 2 == 0, F.col("breadth_px") / 16),
            "lb_ratio": R.rnd(R.lb_ratio("length_px", "breadth_px")),
        }
    )
    heads = rows.groupBy("sample_id").agg(
        F.count("*").alias("total_rice_grains"),
        F.max(F.when(F.col("p_size") % 2 == 0, "mm").otherwise("pixels")).alias("measurement_unit"),
        F.lit("none").alias("calibration_mode"),
    )
    return rows, heads


@query(
    "write_instances_json",
    f"""{INST} SELECT CAST(json_extract(value, '$.n') AS BIGINT) AS n, unit, length, breadth FROM (
  SELECT json_object('n', count(*)) AS value, CASE WHEN p_size % 2 = 0 THEN 'mm' ELSE 'pixels' END AS unit,
    {r('sum(CASE WHEN p_size % 2 = 0 THEN length_px / 16 ELSE length_px END)')} AS length, {r('sum(CASE WHEN p_size % 2 = 0 THEN breadth_px / 16 ELSE breadth_px END)')} AS breadth
  FROM instances GROUP BY sample_id, p_size)""",
)
def write_instances_json(spark, sf_dir):
    """Written as JSON text and read back with a schema."""
    path = scratch_path(spark, "json")
    SK.write_instances_json(*_export(spark, sf_dir), path)
    grain = "array<struct<grain_id:bigint,length:double,breadth:double,lb_ratio:double>>"
    back = spark.read.schema(f"total_rice_grains bigint, measurement_unit string, grains {grain}").json(path)
    total = {k: F.aggregate(f"grains.{k}", F.lit(0.0), lambda a, v: a + v) for k in ("length", "breadth")}
    return back.select(
        F.col("total_rice_grains").alias("n"), F.col("measurement_unit").alias("unit"),
        *[R.rnd(v, 4).alias(k) for k, v in total.items()],
    )


@query(
    "write_instances_csv",
    f"""{INST} SELECT sample_id, count(*) AS n, CASE WHEN max(p_size % 2) = 0 THEN 'mm' ELSE 'pixels' END AS unit,
  {r('sum(CASE WHEN p_size % 2 = 0 THEN length_px / 16 ELSE length_px END)')} AS length, {r('sum(confidence)')} AS confidence FROM instances GROUP BY sample_id""",
)
def write_instances_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    SK.write_instances_csv(*_export(spark, sf_dir), path)
    grains = spark.read.csv(
        f"{path}/grains", header=True,
        schema="sample_id bigint, grain_id bigint, confidence double, length double, breadth double, L_over_B double",
    ).groupBy("sample_id").agg(
        F.count("*").alias("n"), R.rnd(F.sum("length"), 4).alias("length"), R.rnd(F.sum("confidence"), 4).alias("confidence")
    )
    heads = spark.read.csv(f"{path}/summary", header=True, schema="sample_id bigint, Parameter string, Value string, Notes string")
    units = heads.where("Parameter = 'Measurement Unit'").select("sample_id", F.col("Value").alias("unit"))
    return grains.join(units, "sample_id")


@query(
    "archive_runs",
    """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-01') AS run_date, count(*) AS runs, CAST(sum(o_custkey) AS BIGINT) AS keys, 4 AS columns FROM orders GROUP BY 1""",
)
def archive_runs(spark, sf_dir):
    """One run per order, archived under the first day of its month; the blob must be gone."""
    path = scratch_path(spark, "runs")
    runs = T.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("key"), F.date_trunc("month", "o_orderdate").alias("run_at"),
        F.lit("data").alias("annotated_image"),
    )
    SK.archive_runs(runs.repartition("run_at"), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("run_date").cast("string").alias("run_date")).agg(
        F.count("*").alias("runs"), F.sum("key").alias("keys"), F.lit(len(back.columns)).alias("columns")
    )


@query(
    "next_run_numbers",
    """WITH old AS (SELECT max(p_size) AS top FROM part)
SELECT o_orderkey AS run, concat(CASE WHEN n < 100 THEN lpad(CAST(n AS STRING), 3, '0') ELSE CAST(n AS STRING) END, '_', strftime(o_orderdate, '%d_%m_%y')) AS run_id
FROM (SELECT *, top + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders, old)""",
)
def next_run_numbers(spark, sf_dir):
    runs = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("run_at"))
    old = T.table(spark, sf_dir, "part").select(F.concat(F.format_string("%03d", "p_size"), F.lit("_01_01_26")).alias("run_id"))
    order = [F.col("run_at"), F.col("run")]
    # Days are the buckets; a day is split by ranges of the order key.
    numbered = SK.next_run_numbers(runs, old, order, [F.to_date("run_at")], [F.floor(F.col("run") / 65536)])
    return numbered.select("run", "run_id")


@query(
    "image_manifest",
    r"""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN length(html) % 9 < 1 THEN 'empty'
    WHEN page_id % 4 = 3 THEN 'unsupported' WHEN length(html) > 4000 THEN 'too_large' ELSE 'ok' END AS verdict FROM pages) GROUP BY verdict""",
)
def image_manifest(spark, sf_dir):
    """The file rules on page names and sizes; every ninth size counts as empty."""
    ext = F.element_at(F.array(F.lit(".PNG"), F.lit(".jpeg"), F.lit(".tif"), F.lit(".gif")), (F.col("page_id") % 4 + 1).cast("int"))
    rows = T.table(spark, sf_dir, "pages").select(
        F.concat(F.col("url"), F.lit("f"), ext).alias("name"), F.length("html").alias("size"),
        F.when(F.length("html") % 9 < 1, 7).otherwise(F.length("html")).alias("length"),
    )
    verdict = IM.image_verdict("name", "length", pixels="size", max_pixels=4000)
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "dedupe_messages",
    """WITH m AS (SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY source, lang)
SELECT source, string_agg(lang, ',' ORDER BY first) AS langs FROM m GROUP BY source""",
)
def dedupe_messages(spark, sf_dir):
    """Distinct messages in first-seen order; repeats collapse before any list is built."""
    rows = T.table(spark, sf_dir, "documents")
    firsts = rows.groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    lists = firsts.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("first", "lang"))).alias("m"))
    doubled = F.concat("m.lang", "m.lang")
    return lists.select("source", F.concat_ws(",", R.dedupe_messages(doubled)).alias("langs"))


# --- streams ----------------------------------------------------------------


def _stamped(rows):
    rows = rows.selectExpr(*T.EVENT_BASE_COLS).selectExpr(*T.EVENT_COLS)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def event_stream(spark, sf_dir):
    """The events table as a stream of files."""
    schema = T.table(spark, sf_dir, "events").schema
    return _stamped(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


@query(
    "stream_rate",
    f"""WITH {T.EVENTS_CTE} SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS requests FROM log_events
WHERE event = 'request_started' GROUP BY 1""",
)
def stream_rate(spark, sf_dir):
    """All windows: those the watermark closed, and at the end of the run the open ones."""
    out = ST.run_available(ST.stream_rate(event_stream(spark, sf_dir)), "rate", still_open=ST.open_windows)
    return out.select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "requests")


@query(
    "stream_dedupe",
    f"WITH {T.EVENTS_CTE} SELECT DISTINCT request_id, event FROM log_events WHERE starts_with(event, 'request')",
)
def stream_dedupe(spark, sf_dir):
    """Which of the equal keys arrives first is up to the stream; the keys are not."""
    rows = event_stream(spark, sf_dir).where(F.col("event").startswith("request"))
    out = ST.run_available(ST.stream_dedupe(rows, ["request_id", "event"], "60 days"), "dedupe")
    return out.select("request_id", "event")


@query(
    "stream_pairing",
    f"""WITH {T.EVENTS_CTE}, s AS (SELECT request_id, ts FROM log_events WHERE event = 'request_started'), e AS (SELECT * FROM log_events WHERE event IN ('request_finished', 'request_failed'))
SELECT s.request_id, strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS finished_at, e.event AS end_event, e.duration_ms
FROM s LEFT JOIN e ON s.request_id = e.request_id AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 12 HOUR""",
)
def stream_pairing(spark, sf_dir):
    """All starts: those the stream put out, and at the end of the run the open ones."""
    rows = event_stream(spark, sf_dir)
    starts, ends = rows.where("event = 'request_started'"), rows.where("event IN ('request_finished', 'request_failed')")
    out = ST.run_available(ST.stream_pairing(starts, ends, timedelta(hours=12), "1 hour"), "pairing", still_open=ST.open_starts)
    return out.withColumns({k: F.date_format(k, "yyyy-MM-dd HH:mm:ss") for k in ("started_at", "finished_at")})


@query(
    "tail_logs",
    f"""WITH {T.EVENTS_CTE} SELECT event, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM log_events
WHERE seq % 50 <> 0 AND seq % 61 <> 0 AND seq % 71 <> 0 GROUP BY event""",
)
def tail_logs(spark, sf_dir):
    good, _ = ST.split_malformed(ST.tail_logs(spark, written_logs(spark, sf_dir)))
    out = ST.run_available(good.select("event", "duration_ms", "ts"), "tail")
    return out.groupBy("event").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"))


@query(
    "follow_logs",
    f"""WITH {T.EVENTS_CTE} SELECT event, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM log_events
WHERE seq % 50 <> 0 AND seq % 61 <> 0 AND seq % 71 <> 0 GROUP BY event""",
)
def follow_logs(spark, sf_dir):
    """The same log as in ``tail_logs``, followed by byte."""
    good, _ = ST.split_malformed(ST.follow_logs(spark, written_logs(spark, sf_dir)))
    out = ST.run_available(good.select("event", "duration_ms"), "follow")
    return out.groupBy("event").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"))
