"""URL filter, archives and main text."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.llm import pages, urls, warc
from sievekit.llm import texts as T

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def test_url_rules(spark):
    rows = [
        (1, "HTTP://A.Example.NET/en/x?q#f"), (2, "http://example.net/de/"), (3, "https://b.example.com/de/1"), (4, "ftp://x.org/fr/"),
        (5, "http://notexample.com/de/"), (6, "no scheme/net/"), (7, None), (8, "http://net"), (None, "http://org/fr/y"), (1, "http://x.net/"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "request_id long, path string, verdict string")
    got = urls.judge_urls(df, df.limit(0).select("path", F.lit(True).alias("failed")), RULES)
    want = {
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/de/", "net/", "block"),
        (3, "b.example.com", "/de/1", "example.com/de/", "block"), (4, "x.org", "/fr/", "org/fr/", "allow"),
        (5, "notexample.com", "/de/", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "net", "", None, "allow"), (None, "org", "/fr/y", "org/fr/", "allow"), (1, "x.net", "/", "net/", "block"),
    }
    assert {tuple(r)[:5] for r in got.collect()} == want
    assert urls.judge_urls(df.limit(0), df.limit(0).select("path", F.lit(True).alias("failed")), RULES).count() == 0


def test_trees_learn_lexical_features(spark):
    good = [(f"https://www.site{i}.example.org/en/{i}.html", False) for i in range(150)]
    bad = [(f"http://{i}{i * 7}x{i}9.example.biz/a/b/c/{i}?x={i}&y=1&z=2", True) for i in range(150)]
    table = spark.createDataFrame(good + bad, "path string, failed boolean")
    known, asked = table.where(F.xxhash64("path") % 3 != 0), table.where(F.xxhash64("path") % 3 == 0)
    got = urls.judge_urls(asked.withColumn("request_id", F.xxhash64("path")), known.unionAll(known.limit(3)), ())
    right = got.join(asked.withColumn("request_id", F.xxhash64("path")), "request_id").where((F.col("verdict") == "block") == F.col("failed"))
    assert right.count() >= 0.95 * asked.count()


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/x y\r\nz", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "http://c", ""), (5, "http://d", "a\r\n\r\nWARC/1.1\r\n"), (2, "http://b/", "<p>é</p>"), (None, "http://e", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "request_id long, path string, document string, payload long").repartition(3)
    for packing in ("gzip", "none"):
        place = f"{tmp_path}/{packing}"
        warc.write_warc(df, place, compression=packing)
        found = warc.read_warc(spark, place, payload=True)
        got = sorted(((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], bytes(r["payload"]) if r["payload"] is not None else None) for r in found.collect()), key=repr)
        want = []
        for key, _, text in rows:
            data = (text or "").encode()
            last = max((k for k, _, t in rows if (t or "") == (text or "") and k is not None), default=None)
            again = last is not None and key != last
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            want.append((None if key is None else str(key), "revisit" if again else "response", str(last) if again else None, len(data), digest, None if again else data))
        assert got == sorted(want, key=repr)
        assert {r["target_uri"] for r in found.where("record_id = '1'").collect()} == {"http://a/x%20y%0D%0Az"}
        only = warc.read_warc(spark, place).where("record_type = 'revisit'")
        assert only.count() == sum(r[1] == "revisit" for r in want)
        assert only.where("payload is not null").count() == 0
    warc.write_warc(df.limit(0), f"{tmp_path}/empty")
    assert warc.read_warc(spark, f"{tmp_path}/empty").count() == 0


def test_predicates_reach_the_reader(spark, tmp_path):
    reader = warc.WarcReader({"path": str(tmp_path)})
    asked = [warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 3)]
    assert list(reader.pushFilters(asked)) == asked[1:] and reader.filters == asked[:1]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<title>T</title><nav>menu</nav><article><h1>Head &amp; more</h1><p>one\n two<p><b>th</b>ree<br>four</article><footer>f</footer>", "Head & more\none two\nthree four"),
        ("<body><div class='content-main'><main><p>in</p><aside>side</aside><div class='comments'>c</div></main></div><p>out", "in"),
        ("<form><header>h</header><article>body &lt;3 a < b</article></form>", "body <3 a < b"),
        ("<div class=ad>buy</div><p>plain &#233; text</p><script>var a='<p>x</p>'</script><!-- <p>no</p> -->", "plain é text"),
        ("<div class='page has-sidebar'><p>kept</p></div><div role=navigation>x</div><div id=cookie-notice>y</div>", "kept"),
        ("", ""), (None, ""), ("   \n ", ""), ("<p>unclosed <i", "unclosed <i"),
    ],
)
def test_blocks_of_a_page(spark, page, text):
    got = pages.extract_main_text(spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")).first()
    assert (got["text"], got["n_chars"]) == (text, len(text))


def test_host_repetition_goes_from_unmarked_pages(spark):
    notice = "this long notice stands on every page of the host and says nothing"
    rows = [(i, f"http://h.example/{i}", f"<div>{notice}</div><p>unique words of page {i} {'x' * i}</p>") for i in range(6)]
    rows += [(10, "http://other/", f"<p>{notice}</p>"), (11, "http://h.example/a", f"<article>{notice}</article>"), (None, None, "<p>a b</p>"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string").repartition(4)
    got = {r["page_id"]: r["text"] for r in pages.extract_main_text(df).collect()}
    assert {k: v for k, v in got.items() if k is not None and k < 6} == {i: f"unique words of page {i} {'x' * i}".strip() for i in range(6)}
    assert got[10] == notice and got[11] == notice and got[None] == "a b"
    assert pages.extract_main_text(df).count() == len(rows) and pages.extract_main_text(df.limit(0)).count() == 0


def test_suffix_counts_are_of_all_labelled_rows(spark, monkeypatch):
    known = [(f"http://a{i}.{'bad' if i % 2 else 'good'}/", i % 2 == 1) for i in range(60)]
    df = spark.createDataFrame(known, "path string, failed boolean")
    seen, make = [], urls.VectorAssembler.transform

    def look(self, rows, *more):
        seen.append(rows.groupBy("suffix").agg(F.max("suffix_count").alias("c"), F.max("suffix_rate").alias("r")).collect())
        return make(self, rows, *more)

    monkeypatch.setattr(urls.VectorAssembler, "transform", look)
    urls.judge_urls(df.withColumn("request_id", F.lit(1)), df, max_labelled=20)
    got = {r["suffix"]: (round(np.expm1(r["c"])), round(r["r"], 6)) for r in seen[0]}
    assert got == {"bad": (30, round(35 / 40, 6)), "good": (30, round(5 / 40, 6))}


def test_repetition_goes_across_block_ends(spark):
    menu = "".join(f"<li>{w}</li>" for w in ("Home", "About us", "Our work", "News", "Contact", "Help"))
    share = "<p>Share this</p><p>Mail it</p><p>Print</p><p>(c) 2024 Some Company</p>"
    rows = [(i, f"http://h/{i}", f"<ul>{menu}</ul><p>story {i} tells {'a' * i} thing</p><div>{share}</div>") for i in range(3)]
    rows += [(9, "http://other/", f"<ul>{menu}</ul><p>alone</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in pages.extract_main_text(df).collect()}
    assert {i: got[i] for i in range(3)} == {i: " ".join(f"story {i} tells {'a' * i} thing".split()) for i in range(3)}
    assert got[9] == "Home\nAbout us\nOur work\nNews\nContact\nHelp\nalone"


def test_repetition_counts_alike_on_large_hosts(spark):
    notice = "a notice of one section that stands on few of the pages"
    rows = [(i, f"http://h/{i}", (f"<p>{notice}</p>" if i < 3 else "") + f"<p>{' '.join(f'w{i}x{j}' for j in range(9))}</p>") for i in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in pages.extract_main_text(df).collect()}
    assert got == {i: " ".join(f"w{i}x{j}" for j in range(9)) for i in range(90)}


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_array_of_every_host(spark, seed):
    rng = random.Random(seed)
    passages = [[rng.randint(1, 9) for _ in range(rng.randint(2, 30))] for _ in range(6)]
    pages_of = [
        (f"h{rng.randint(0, 2)}", p, [sum(rng.choices(passages, k=rng.randint(0, 4)), []) for _ in range(rng.randint(0, 3))])
        for p in range(40)
    ]
    pages_of += [("hot", p, [passages[0] + passages[1]]) for p in range(200)] + [("h0", 7, [[1, 2]]), ("", 0, [])]
    size, least = 4, 3
    hashed = {w: int(T.mix(np.array([w], np.uint64)).view(np.int64)[0]) for w in range(1, 10)}
    df = spark.createDataFrame([(h, p, [[hashed[w] for w in s] for s in streams]) for h, p, streams in pages_of], "host string, stream long, words array<array<bigint>>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # intervals go on in other ranges
    try:
        got = pages.suffix_array(df.repartition(3), size)
        rows = [tuple(r) for part in got.rdd.glom().collect() for r in part]
        runs = sorted(map(tuple, pages.repeated_runs(got, least).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == sum(max(0, len(s) - size + 1) for _, _, streams in pages_of for s in streams)
    assert [r[:2] for r in rows] == sorted(r[:2] for r in rows)

    name = lambda ws: int(T.windows(np.array([hashed[w] for w in ws], np.int64).view(np.uint64), size).view(np.int64)[0])
    on = {}
    for h, p, streams in pages_of:
        for s in streams:
            for i in range(len(s) - size + 1):
                on.setdefault((h, tuple(s[i : i + size])), set()).add(p)
    assert runs == sorted((h, name(ws)) for (h, ws), those in on.items() if len(those) >= least)


def test_suffixes_lie_side_by_side_as_far_as_they_are_equal():
    rng = random.Random(5)
    words = np.array([rng.randint(1, 2) for _ in range(300)] + [1, 2] * 40, np.uint64)
    names, offsets = pages.suffix_names(T.mix(words), 2)
    named = [tuple(names[a:b]) for a, b in zip(offsets, offsets[1:])]
    order = sorted(range(len(named)), key=lambda i: named[i])
    assert len(named) == len(words) - 1 and len(set(named)) == len(named)
    for k in range(6):
        width, keys = 2 << k, [tuple(words[i : i + (2 << k)]) for i in order if i + (2 << k) <= len(words)]
        assert sum(x != y for x, y in zip(keys, keys[1:])) + 1 == len(set(keys)), width
