"""Near copies, repeated lines, mixtures and the pipeline against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.llm import lines, links, mixture, queries, similarity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOC = [f"w{i}" for i in range(300)]


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def family(rng, n, size, edits):
    """Near copies of one text."""
    base, out = [rng.choice(VOC) for _ in range(size)], []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            i = rng.randrange(len(words))
            words[i : i + rng.randint(0, 1)] = [rng.choice(VOC)] * rng.randint(0, 2)
        out.append(" ".join(words))
    return out


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall(fold(text))
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if both and 100 * both >= 75 * either:
            root[max(find(a), find(b))] = min(find(a), find(b))
    members = defaultdict(list)
    for x, (key, _) in enumerate(rows):
        members[find(x)].append(key)
    least = {r: min((k for k in keys if k is not None), default=None) for r, keys in members.items()}
    return sorted(((key, len(sets[x]), least[find(x)] if sets[x] else key) for x, (key, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("seed", [3, 8])
def test_link_similar(spark, seed, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 4)  # lists of many blocks
    rng = random.Random(seed)
    texts = [t for n, size, edits in ((60, 60, 3), (40, 90, 6), (20, 150, 12), (30, 12, 2)) for t in family(rng, n, size, edits)]
    passage = " ".join(rng.choices(VOC, k=30))
    texts += [f"{passage} {' '.join(rng.choices(VOC, k=rng.randint(3, 60)))}" for _ in range(60)]
    texts += ["a b", "A B", "", None, "  \t", "one"] * 2
    rows = list(enumerate(texts)) + [(None, texts[0]), (5, texts[5]), (None, None), (None, "p q r s t u"), (9999, "P q r s t u")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "request_id long, error_message string, n_shingles long").repartition(5)
    got = sorted(map(tuple, similarity.link_similar(df).collect()), key=repr)
    assert got == brute_components(rows)


def test_link_similar_of_nothing(spark):
    assert similarity.link_similar(spark.createDataFrame([], "request_id long, error_message string")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(rows, least=8):
    places = defaultdict(list)
    for key, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            words = tuple(WORD.findall(fold(line)))
            if len(words) >= least:
                places[words].append((-(1 << 63) if key is None else key, no))
    first = {w: min(p) for w, p in places.items()}
    limit = {w: min(first[x] for x in first if near(list(w), list(x))) for w in first}
    out = []
    for key, text in rows:
        kept, every = [], (text or "").split("\n")
        for no, line in enumerate(every):
            words = tuple(WORD.findall(fold(line)))
            if words not in limit or (-(1 << 63) if key is None else key, no) <= limit[words]:
                kept.append(line)
        out.append((key, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_drop_repeated_lines(spark):
    rng = random.Random(9)
    pool = [t for n, size, edits in ((30, 12, 1), (20, 9, 2), (10, 30, 3), (20, 8, 1)) for t in family(rng, n, size, edits)]
    pool += ["a a a a a a a a", "a a a a a a a a a", "a a a a a a a b", "short line", "", "x"] * 2
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 5)))) for i in range(90)]
    rows += [(None, pool[0]), (3, f"{pool[1]}\n{pool[2]}"), (3, f"{pool[1]}\n{pool[2]}"), (7, None), (-5, pool[3])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "request_id long, error_message string, line string").repartition(4)
    assert sorted(map(tuple, lines.drop_repeated_lines(df).collect()), key=repr) == brute_lines(rows)
    assert lines.drop_repeated_lines(df.limit(0)).count() == 0


def brute_all_lines(rows, least=8):
    """Every line with a word: equal to an earlier one, or within one word of it if the longer has ``least``, both for a change."""
    places = defaultdict(list)
    for key, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            if words := tuple(WORD.findall(fold(line))):
                places[words].append((-(1 << 63) if key is None else key, no))
    first = {w: min(p) for w, p in places.items()}
    limit = {w: min(first[x] for x in first if x == w or (max(len(w), len(x)) >= least and near(list(w), list(x)))) for w in first}
    out = []
    for key, text in rows:
        every = (text or "").split("\n")
        places_of = [(tuple(WORD.findall(fold(line))), (-(1 << 63) if key is None else key, no)) for no, line in enumerate(every)]
        kept = [line for line, (words, place) in zip(every, places_of) if not words or place <= limit[words]]
        out.append((key, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_drop_repeated_lines_of_any_length(spark):
    rng = random.Random(19)
    pool = [t for n, size, edits in ((20, 12, 1), (12, 8, 1), (12, 7, 1), (12, 6, 1), (10, 3, 1)) for t in family(rng, n, size, edits)]
    pool += ["Released under the MIT license.", "released under  the MIT License.", "x", "X", "", " \t", "a a a a a a a", "a a a a a a a a"] * 2
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(90)] + [(None, "x\nx"), (3, "x"), (-5, "b"), (7, None)]
    df = spark.createDataFrame(rows, "request_id long, error_message string").repartition(4)
    got = sorted(map(tuple, lines.drop_repeated_lines(df, exact_words=1).collect()), key=repr)
    assert got == brute_all_lines(rows)


def test_query_drops_repeated_short_lines(spark, tmp_path):
    share = "Share this page"
    rows = [(1, f"{share}\none"), (2, f"two\n{share}"), (3, f"a b c d e f g\n{share}"), (4, "a b c d e f g h")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in queries.line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: f"{share}\none", 2: "two", 3: "a b c d e f g", 4: ""}


def test_targets_stop_at_twice_the_size():
    sizes = [("a", 1000), ("b", 10), ("c", 500), (None, 0)]
    got = mixture.targets(sizes, (5, 2, 1), 1.5, 2.0)
    assert got[1] == 20 and got[3] == 0 and sum(got) == pytest.approx(1.5 * 1510)
    assert all(t <= 2 * n + 1e-9 for t, (_, n) in zip(got, sizes))


def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 7, 64, 1000):
        p = mixture.Permutation(n, 5)
        out = p(np.arange(n))
        assert sorted(out.tolist()) == list(range(n)) and p(out, back=True).tolist() == list(range(n))


def test_shards_draw_all_slots():
    counts = np.array([500, 0, 37, 1200])
    size, shards = 100, -(-counts.sum() // 100)
    parts = [mixture.shard_counts(counts, s, shards, size, 3) for s in range(shards)]
    assert sum(own for _, own in parts).tolist() == counts.tolist()
    assert all(own.sum() == size for _, own in parts[:-1])
    assert all((parts[i][0] + parts[i][1]).tolist() == parts[i + 1][0].tolist() for i in range(shards - 1))


def test_mix_sources(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choices(VOC, k=rng.randint(0, 200))), rng.choice(["a", "b", "c", "Z", None])) for i in range(300)]
    rows += [(5, "x y", "a"), (5, "x y", "a"), (None, "one two", "b"), (900, None, "c"), (901, "lone", "tiny")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "request_id long, error_message string, route string, target double")
    got = mixture.mix_sources(df).collect()
    again = mixture.mix_sources(df.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    size = Counter()
    for key, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    taken, targets = Counter(), {}
    for r in got:
        taken[r["source_size"]] += r["taken"]
        targets[r["source_size"]] = r["target"]
    assert sorted(targets) == sorted(size.values())
    assert all(abs(taken[n] - t) <= 1 for n, t in targets.items())
    mixed = mixture.mixed_blocks(df)
    words = mixed.select(F.explode("words").alias("w")).groupBy("w").count()
    assert words.agg(F.sum("count")).first()[0] == sum(taken.values())
    assert mixed.select("shard", "place").distinct().count() == mixed.count()
    assert mixture.mix_sources(df.limit(0)).count() == 0


def test_taken_words_are_those_of_the_mixed_blocks(spark):
    """Every word names its record, so the mix itself says how many words of which record it holds."""
    rng = random.Random(12)
    sizes = {i: rng.choice([0, 1, 5, 63, 64, 65, rng.randint(0, 700)]) for i in range(120)}
    rows = [(i, " ".join(f"{i}:{j}" for j in range(n)), rng.choice(["a", "a", "b", None])) for i, n in sizes.items()]
    df = spark.createDataFrame(rows, "request_id long, error_message string, route string")
    words = [w for r in mixture.mixed_blocks(df, shard_slots=16).collect() for w in r["words"]]
    held = Counter(int(w.split(":")[0]) for w in words)
    assert {r["request_id"]: r["taken"] for r in mixture.mix_sources(df, shard_slots=16).collect()} == {i: held[i] for i in sizes}
    assert max(Counter(words).values()) <= 2


def test_draws_follow_the_exact_law_at_every_size():
    for good, other, take in ((5, 7, 4), (3, 200, 60), (40, 2, 30), (1, 0, 1), (500, 900, 13)):
        ways = [math.comb(good, x) * math.comb(other, take - x) if take >= x else 0 for x in range(good + 1)]
        edges, whole, below = [], sum(ways), 0
        for x, n in enumerate(ways):
            if n / whole > 1e-12:  # just above and below each step of the distribution
                edges += [(x, below / whole + n / whole * 1e-3), (x, below / whole + n / whole * 0.999)]
            below += n
        assert all(mixture._drawn_of(good, other, take, u) == x for x, u in edges)
    good, other, take = 3 * 10**9, 5 * 10**9, 4 * 10**9
    rng = np.random.default_rng(4)
    drawn = np.array([mixture._drawn_of(good, other, take, u) for u in rng.random(200)], float)
    spread = (take * 3 / 8 * 5 / 8 * 0.5) ** 0.5
    assert abs(drawn.mean() - take * 3 / 8) < 4 * spread / 200**0.5 and 0.8 < drawn.std() / spread < 1.2


def test_pipeline_stages(spark):
    """Each stage on a small corpus; whole corpora: the check of every stage's operator above."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf_dir, before = "/root/testdata/sf0.001", docs
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name, stage in pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, sf_dir).toPandas(), docs.schema)
        assert after.columns == docs.columns
        if name == "line dedup":
            want = {k: t for k, _, _, t in brute_all_lines([(r["doc_id"], r["text"]) for r in before.collect()]) if WORD.search(t)}
            assert {r["doc_id"]: r["text"] for r in after.collect()} == want
        elif name == "n-gram Jaccard join":
            want = {k for k, n, c in brute_components([(r["doc_id"], r["text"]) for r in before.collect()]) if k == c}
            assert {r["doc_id"] for r in after.collect()} == want
        before = after
    mixed = pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert mixed.count() == before.count() and len(rows) >= before.count() > 0


def test_sketches_differ_no_more_than_their_sets():
    rng = np.random.default_rng(4)
    for size, changed in ((0, 3), (40, 0), (200, 30), (5000, 900)):
        x = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        y = np.concatenate([x[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)])
        bits = sum(int(v).bit_count() for v in (similarity._sketch(x) ^ similarity._sketch(y)).view(np.uint64))
        assert bits <= len(np.setxor1d(x, y))
        assert bits > 0 or not changed
