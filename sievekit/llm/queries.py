"""The numbered operators on the test tables, and what of them SQL can say."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import codes, lines, mixture, pages, passages, personal, repetition, shards, similarity, spelling, tokens, urls, warc
from sievekit.session import scratch_path, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_counts")
def token_counts(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    return tokens.count_tokens(table(spark, sf_dir, "documents"), model, key="doc_id", text="text")


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SIMILAR_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS g FROM w
), d AS (SELECT DISTINCT doc_id, md5(array_to_string(g, ' ')) AS g FROM s WHERE g IS NOT NULL
), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM d x JOIN d y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r AS (
  SELECT a AS doc_id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m ON m.doc_id = w.doc_id
"""


@query("op2_ngram_jaccard", _SIMILAR_SQL)
def ngram_jaccard(spark, sf_dir):
    return similarity.link_similar(table(spark, sf_dir, "documents"), key="doc_id", text="text")


# Words covered by repeated runs of at least m words are those in m-word windows that occur twice.
_QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, (VALUES (5), (10), (201)) v(k) WHERE len(w) >= k
), h AS (SELECT doc_id, k, i, md5(array_to_string(w[i:i + k - 1], ' ')) AS h FROM win
), again AS (
  SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, h) AS c FROM h) WHERE c > 1
), cover AS (
  SELECT doc_id, count(DISTINCT i + j) FILTER (k = 5) AS n5, count(DISTINCT i + j) FILTER (k = 10) AS n10,
    count(*) FILTER (k = 201) AS n201
  FROM (SELECT doc_id, k, i, unnest(CASE WHEN k = 201 THEN [0] ELSE range(0, k) END) AS j FROM again) GROUP BY doc_id
), ln AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), f AS (
  SELECT d.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
    len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(n5, 0) AS n_repeat_words, coalesce(n10, 0) AS run_words, coalesce(n201, 0) AS long_runs
  FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN dup USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * run_words <= 15 * n_words AND long_runs = 0 AS kept
FROM f
"""


@query("op3_quality_rules", _QUALITY_SQL)
def quality_rules(spark, sf_dir):
    found = repetition.quality_rules(table(spark, sf_dir, "documents"), key="doc_id", text="text")
    return found.drop("run_words", "longest_run")


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, failed): pages name the document that they show by the last number of their path;
    a labelled document that is of low quality or toxic makes its page one to block."""
    shown = F.regexp_extract("url", r"^[^?#]*?([0-9]+)(?:\.html|/)?(?:[?#].*)?$", 1)
    named = table(spark, sf_dir, "pages").select("url", shown.try_cast("bigint").alias("doc_id"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return named.join(table(spark, sf_dir, "labels"), "doc_id").select("url", bad.alias("failed"))


@query("op4_url_filter")
def url_filter(spark, sf_dir):
    found = urls.judge_urls(table(spark, sf_dir, "pages"), labelled_urls(spark, sf_dir), RULES, key="page_id", url="url")
    return found.select("page_id", "host", "path", "rule", "verdict")


def joined_sha256(strings: Column) -> Column:
    return F.sha2(F.array_join(strings, ",").cast("binary"), 256)


_PASSAGES_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_FOLD}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (SELECT item_id, regexp_extract_all(coalesce({_FOLD}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), m AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g
), hit AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(0, k)) AS j FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op5_decontaminate", _PASSAGES_SQL)
def decontaminate(spark, sf_dir):
    found = passages.find_passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), key="doc_id", text="text", item="item_id", passage="text"
    )
    return found.withColumn("items_sha256", joined_sha256(F.col("items"))).drop("items")


_LINES_SQL = rf"""
WITH l AS (
  SELECT doc_id, len(ls) AS n_lines, unnest(range(1, len(ls) + 1)) AS no, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), w AS (
  SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM l
), u AS (
  SELECT array_to_string(w, ' ') AS x, any_value(w) AS w, min(row(doc_id, no)) AS p FROM w WHERE len(w) >= 1 GROUP BY ALL
), v AS (
  SELECT x, p, -1 AS i, x AS g FROM u
  UNION ALL
  SELECT x, p, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM u WHERE len(w) >= 8)
), g AS (
  SELECT g, min(p) FILTER (i < 0) AS whole, min(p) FILTER (i > 0) AS gap FROM v GROUP BY g
), bad AS (
  SELECT x FROM (SELECT x, p, i, min(p) OVER (PARTITION BY g, i) AS m FROM v) WHERE i > 0 AND m < p
  UNION
  SELECT x FROM v JOIN g ON g.g = v.g WHERE CASE WHEN i < 0 THEN gap ELSE whole END < p
), k AS (
  SELECT w.doc_id, w.n_lines, w.no, w.line, len(w.w) >= 1 AND (bad.x IS NOT NULL OR row(w.doc_id, w.no) > u.p) AS gone
  FROM w LEFT JOIN u ON u.x = array_to_string(w.w, ' ') AND len(w.w) >= 1 LEFT JOIN bad ON bad.x = u.x
)
SELECT doc_id, n_lines, count(*) FILTER (gone) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT coalesce(gone, false)), '') AS text
FROM k GROUP BY doc_id, n_lines
"""


@query("op6_line_dedup", _LINES_SQL)
def line_dedup(spark, sf_dir):
    return lines.drop_repeated_lines(table(spark, sf_dir, "documents"), key="doc_id", text="text", exact_words=1)


@query("op7_personal_data")
def personal_data(spark, sf_dir):
    found = personal.find_personal_data(table(spark, sf_dir, "documents"), key="doc_id", text="text")

    def listed(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{kind}": number(kind) for kind in personal.KINDS[:4]}
    return found.withColumns(counts).select(
        "doc_id", *counts, joined_sha256(listed(F.col("base"))).alias("base_sha256"), F.array_join(listed(F.col("spans")), ",").alias("spans")
    )


_WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, unhex(sha1(coalesce(html, ''))) AS h, sha1(coalesce(html, '')) AS d FROM pages
), m AS (SELECT d, max(page_id) AS last FROM p GROUP BY d
), q AS (
  SELECT page_id, n, d, last, list_transform(range(0, 8), lambda i: CAST('0x' || substr(d, 5 * i + 1, 5) AS INTEGER)) AS v FROM p JOIN m USING (d)
)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([32768, 1024, 32, 1],
    lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(x // k) % 32 + 1]), '')), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM q
"""


@query("op8_warc", _WARC_SQL)
def warc_round_trip(spark, sf_dir):
    place = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), place, key="page_id", url="url", payload="html")
    whole = warc.read_warc(spark, place, payload=True).where("record_type = 'response'")
    again = warc.read_warc(spark, place).where("record_type = 'revisit'")
    return whole.drop("payload").unionByName(again.drop("payload")).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


# The pages of the test tables hold an article of headings and paragraphs each, without anything foreign in it.
_PAGES_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS a FROM pages
), b AS (
  SELECT page_id, url, unnest(string_split(regexp_replace(regexp_replace(a, '</?(p|h1|h2|h3|ul|li|div)( [^>]*)?>', chr(1), 'g'), '<br ?/?>', ' ', 'g'), chr(1))) AS x,
    unnest(range(0, 1 + len(string_split(regexp_replace(a, '</?(p|h1|h2|h3|ul|li|div)( [^>]*)?>', chr(1), 'g'), chr(1))) - 1)) AS i FROM a
), c AS (
  SELECT page_id, url, i, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(x, '</?[a-z][^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&middot;', '·'), '&amp;', '&'),
    '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS x FROM b
), t AS (SELECT page_id, string_agg(x, chr(10) ORDER BY i) AS text FROM c WHERE x <> '' GROUP BY page_id)
SELECT a.page_id, a.url, coalesce(text, '') AS text, len(coalesce(text, '')) AS n_chars FROM a LEFT JOIN t USING (page_id)
"""


@query("op9_main_text", _PAGES_SQL)
def main_text(spark, sf_dir):
    return pages.extract_main_text(table(spark, sf_dir, "pages"))


@query("op10_mixture")
def mixture_of_sources(spark, sf_dir):
    return mixture.mix_sources(table(spark, sf_dir, "documents"), key="doc_id", text="text", source="source")


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = [
        f"""k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM k, range({parts}) t(p)
), c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM p WHERE r <= {entries})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, p.p, min(row(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e)) AS m
  FROM p JOIN c{i} c ON p.p = c.p GROUP BY r, p.p
), n{i} AS (SELECT r, p, m[1] AS d, m[2] AS e FROM a{i}
), u{i} AS (SELECT p, e, j, sum(x) AS s, count(*) AS n FROM (SELECT n.p, n.e, unnest(p.x) AS x, unnest(range(len(p.x))) AS j FROM n{i} n JOIN p ON n.r = p.r AND n.p = p.p) GROUP BY ALL
), c{i + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(w.x, c.x) AS x FROM c{i} c
  LEFT JOIN (SELECT p, e, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM u{i} GROUP BY p, e) w ON c.p = w.p AND c.e = w.e
)""")
    return f"""WITH {", ".join(steps)}, h AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) AS h FROM (SELECT p, e, unnest(x) AS x, unnest(range(len(x))) AS j FROM c{rounds})
), f AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN f ON k.r = f.r, h"""


@query("op11_vector_codes", _codes_sql())
def vector_codes(spark, sf_dir):
    found, books = codes.compress_features(
        table(spark, sf_dir, "embeddings"), key="vec_id", features="embedding", label="label", parts=8, entries=16, rounds=6, scale=4096
    )
    return found.withColumn("codebooks_sha256", F.lit(codes.codebooks_sha256(books)))


def _crc32_table() -> list[int]:
    out = list(range(256))
    for _ in range(8):
        out = [n >> 1 ^ (n & 1) * 0xEDB88320 for n in out]
    return out


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a string's bytes."""
    known = f"CAST({_crc32_table()} AS BIGINT[])"
    of_bytes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    step = f"xor({known}[(xor(a, b) & 255) + 1], a >> 8)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {of_bytes}), lambda a, b: {step}), 4294967295)"


_SPELLING_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents
), h AS (SELECT w, {_crc32_sql("concat(doc_id, ':', w)")} AS h FROM r
), s AS (SELECT CASE WHEN h % 31 = 0 THEN w[:h % len(w)] || w[h % len(w) + 2:] ELSE w END AS w FROM h
), v AS MATERIALIZED (SELECT w, count(*) AS n FROM s WHERE len(w) >= 7 GROUP BY w HAVING count(*) >= 2
), d AS MATERIALIZED (SELECT w, n, i, w[:i - 1] || w[i + 1:] AS g FROM (SELECT w, n, unnest(range(1, len(w) + 1)) AS i FROM v)
), p AS MATERIALIZED (
  SELECT a.w, b.w AS o, b.n FROM d a JOIN d b ON a.g = b.g AND a.i = b.i AND a.w <> b.w
  UNION SELECT d.w, v.w, v.n FROM d JOIN v ON d.g = v.w
  UNION SELECT v.w, d.w, d.n FROM d JOIN v ON d.g = v.w
), b AS (SELECT w, count(*) AS n_near, min(row(-n, o)) AS m FROM p GROUP BY w
), f AS MATERIALIZED (
  SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -m[1] >= 10 * v.n THEN m[2] END AS form, CASE WHEN -m[1] >= 10 * v.n THEN -m[1] END AS form_n
  FROM v LEFT JOIN b ON v.w = b.w
), t AS (SELECT w, w AS root, 0 AS k FROM f UNION ALL SELECT t.w, f.form, k + 1 FROM t JOIN f ON t.root = f.w WHERE f.form IS NOT NULL
)
SELECT f.w AS word, form, m.root, n, n_near, form_n FROM f JOIN (SELECT w, arg_max(root, k) AS root FROM t GROUP BY w) m ON m.w = f.w
"""


@query("op12_spelling_variants", _SPELLING_SQL)
def spelling_variants(spark, sf_dir):
    words = spelling.count_words(table(spark, sf_dir, "documents"), key="doc_id", text="text", min_letters=7, min_count=2, slip=31)
    return spelling.group_spellings(words, ratio=10)


_SHARDS_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_crc32_sql("coalesce(text, '')")} AS text_crc32,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UHUGEINT) AS k
  FROM documents
), s AS (
  SELECT r, k, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j, 0 AS i FROM d
  UNION ALL
  SELECT r, x, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(x // 8589934592 + 1 AS DOUBLE))) AS BIGINT), i + 1
  FROM (SELECT r, (k * 2862933555777941757 + 1) % 18446744073709551616::UHUGEINT AS x, j, i FROM s WHERE j < 17)
), m AS (SELECT r, max(j) FILTER (j < 16) AS shard, max(j) FILTER (j < 17) AS grown FROM s GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown AS INT) AS grown_shard
FROM d JOIN m ON d.r = m.r
"""


@query("op13_jump_shards", _SHARDS_SQL)
def jump_shards(spark, sf_dir):
    found = shards.shard_records(table(spark, sf_dir, "documents"), key="doc_id", text="text", shards=16)
    return found.withColumn("law", F.lit("key"))
