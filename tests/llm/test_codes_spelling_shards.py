"""Feature codes, spelling variants and shards against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.llm import codes, shards, spelling


def brute_codes(rows, parts, entries, rounds, scale):
    """(key, label, vector) rows of one length, nothing missing."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    whole = [[math.floor(Fraction(x) * Fraction(scale)) for x in r[2]] for r in order]
    cuts = [a.tolist() for a in np.array_split(np.arange(len(whole[0])), parts)]
    vectors = [[tuple(v[i] for i in c) for c in cuts] for v in whole]
    books = [[v[p] for v in vectors[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in vectors:
                own[nearest(v[p], books[p])[1]].append(v[p])
            books[p] = [tuple(sum(c) // len(own[k]) for c in zip(*own[k])) if own[k] else e for k, e in enumerate(books[p])]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in vectors]
    errors, by_label = [sum(d for d, _ in f) for f in found], Counter()
    for r, e in zip(order, errors):
        by_label[r[1]] += e
    out = [(r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[1]]) for r, f, e in zip(order, found, errors)]
    return sorted(out, key=repr), [[list(e) for e in b] for b in books]


def vectors(spark, rows, more="x"):
    return spark.createDataFrame([(*r, more) for r in rows], "object_id long, class_id int, features array<double>, code string").repartition(4)


@pytest.mark.parametrize("size, parts, entries, spread", [(12, 3, 16, 0.02), (7, 3, 5, 0.001), (2, 4, 3, 0.01)])
def test_compress_features(spark, size, parts, entries, spread):
    rng = random.Random(size)
    centres = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(6)]
    good = [(i, rng.choice([0, 1, None]), [x + rng.gauss(0, spread) for x in rng.choice(centres)]) for i in range(300)]
    good += [(5, 1, good[7][2]), (6, 0, good[6][2]), (None, 1, centres[0])] + [(1000 + i, 2, centres[1]) for i in range(60)]
    bad = [(-1, 0, None), (-2, 0, [None] * size), (-3, 0, [float("nan")] * size), (-4, 0, [float("-inf")] * size), (77, 0, [0.5] * (size + 1))]
    found, books = codes.compress_features(vectors(spark, good + bad), features="features", parts=parts, entries=entries, rounds=6)
    want, want_books = brute_codes(good, parts, entries, 6, 4096)
    assert books == want_books and sorted(map(tuple, found.collect()), key=repr) == want


def test_compress_features_of_any_size(spark):
    """Components beyond 64 bits; errors that do not fit are null."""
    rng = random.Random(4)
    rows = [(i, 0, [rng.choice([1e30, -3e30, 2.5, 1e12]) * rng.random() for _ in range(4)]) for i in range(60)]
    found, books = codes.compress_features(vectors(spark, rows), features="features", parts=2, entries=4, rounds=6)
    want, want_books = brute_codes(rows, 2, 4, 6, 4096)
    assert books == want_books
    fits = sorted(((k, c, e if e < 1 << 63 else None, t if t < 1 << 63 else None) for k, c, e, t in want), key=repr)
    assert sorted(map(tuple, found.collect()), key=repr) == fits


def test_compress_features_of_columns_and_of_nothing(spark):
    rows = [(i, 0, i / 7, i % 3) for i in range(20)]
    df = spark.createDataFrame(rows, "object_id long, class_id int, chroma double, mean_gray long")
    found, books = codes.compress_features(df, features=("chroma", "mean_gray"), parts=2, entries=4, rounds=2)
    want, want_books = brute_codes([(a, b, [c, d]) for a, b, c, d in rows], 2, 4, 2, 4096)
    assert books == want_books and sorted(map(tuple, found.collect()), key=repr) == want
    found, books = codes.compress_features(vectors(spark, []), features="features", parts=2)
    assert found.columns == ["object_id", "code", "error", "label_error"] and found.count() == 0 and books == [[], []]
    assert codes.codebooks_sha256(books) == hashlib.sha256(b"").hexdigest()


def test_only_moved_entries_are_compared():
    """Stored distances stay exact: the same assignment as a full comparison, ties included."""
    rng = np.random.default_rng(5)
    data = rng.integers(-3, 4, (400, 6))
    books = [rng.integers(-3, 4, (9, 3)) for _ in range(2)]
    entry, distance = codes.Coder(books).assign(data, np.zeros((400, 2), int), np.zeros((400, 2), int))
    for _ in range(6):
        later = [b.copy() for b in books]
        for b in later:
            b[rng.integers(0, 9, 2)] = rng.integers(-3, 4, (2, 3))
        moved = [(a != b).any(axis=1) for a, b in zip(books, later)]
        entry, distance = codes.Coder(later, moved).assign(data, entry, distance)
        full = codes.Coder(later).assign(data, entry, distance)
        assert (full[0] == entry).all() and (full[1] == distance).all()
        books = later


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spellings(counts, ratio=10):
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("symbols", [2, 3])
def test_group_spellings(spark, symbols):
    rng = random.Random(symbols)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 6))) for _ in range(150)} | {"ÿ", "aa", "aaa", "aaaa"}
    for base in ("recognise", "naïveté", "aaaaaaaaaa", "abcabcabcabc"):
        words |= {base} | {base[:i] + rng.choice(["", "x", base[i : i + 1] * 2]) + base[i + 1 :] for i in range(len(base) + 1)}
    long = "".join(rng.choices("xyz", k=3000))
    words |= {long, long[:70] + long[71:], long[:-1] + "q", "q" + long}
    words.discard("")
    counts = {w: rng.choice([1, 2, 3, 20, 35, 400, 5000]) for w in words}
    rows = [(w, n, "x") for w, n in counts.items() if w != "aaa"] + [("aaa", counts["aaa"] - 1, "x"), ("aaa", 1, "x")][counts["aaa"] < 2 :]
    df = spark.createDataFrame(rows + [(None, 5, "x"), ("", 5, "x"), ("zzz", None, "x")], "word string, n long, root string").repartition(3)
    assert sorted(map(tuple, spelling.group_spellings(df, symbols=symbols).collect())) == brute_spellings(counts)
    assert spelling.group_spellings(df.limit(0)).count() == 0


def brute_counts(rows, least, min_count, slip):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= min_count}


@pytest.mark.parametrize("least, slip", [(7, 3), (1, 2), (4, None)])
def test_count_words(spark, least, slip):
    rng = random.Random(least)
    pool = ["Recognise", "recognised", "ÉCLAIR", "éclairs", "x", "Ünïcödé", "tail-end", "a×b÷c", "ſhort", "naïveté", "B" * 5000, "мир"]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(80)] + [(None, "Recognise x"), (3, None), (3, ""), (4, "éclairs")] * 2
    df = spark.createDataFrame([(*r, "x") for r in rows], "request_id long, error_message string, word string")
    got = {r["word"]: r["n"] for r in spelling.count_words(df, min_letters=least, min_count=2, slip=slip).collect()}
    assert got == brute_counts(rows, least, 2, slip)


def brute_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("count", [1, 2, 16, 1000])
def test_shard_records(spark, count):
    rng = random.Random(count)
    rows = [(i, "é" * rng.randint(0, 5)) for i in range(400)] + [(7, "hot")] * 300 + [(None, None), (None, "z"), (-1, "long " * 5000), (3, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "request_id long, error_message string, shard string").repartition(6)
    got = shards.shard_records(df, shards=count).collect()
    want = []
    for key, text in rows:
        data = (text or "").encode()
        h = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16)
        want.append((key, len(data) + 1, zlib.crc32(data), brute_jump(h, count), brute_jump(h, count + 1)))
    fields = ("request_id", "size", "text_crc32", "shard", "grown_shard")
    assert Counter(tuple(r[f] for f in fields) for r in got) == Counter(want)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append((r["slot"], r["request_id"] is not None, r["request_id"] or 0, r["size"], r["text_crc32"]))
        assert r["grown_shard"] in (r["shard"], count)
    for found in slots.values():
        found.sort()
        assert [s[0] for s in found] == list(range(len(found))) and [s[1:] for s in found] == sorted(s[1:] for s in found)


def test_shards_of_strings_and_of_nothing(spark):
    df = spark.createDataFrame([("r-1", "a"), ("", "b"), (None, "c")], "request_id string, error_message string")
    got = {r["request_id"]: r["shard"] for r in shards.shard_records(df).collect()}
    assert got[""] == got[None] and shards.shard_records(df.limit(0)).count() == 0


def test_one_more_shard_moves_few(spark):
    df = spark.range(20000).select(F.col("id").alias("request_id"), F.lit("").alias("error_message"))
    got = shards.shard_records(df, shards=16).groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("grown_shard") == 16).alias("moved")).collect()
    assert len(got) == 16 and all(1050 < r["n"] < 1450 and 20 < r["moved"] < 150 for r in got)
