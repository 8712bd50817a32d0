"""A large family of near copies is not compared pair by pair."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from sievekit.llm import similarity
from sievekit.llm import texts as T


def family(n, words=150):
    """Texts that differ in two to four words from one that is not among them."""
    rng = random.Random(1)
    base, out = [f"b{rng.randrange(10**6)}" for _ in range(words)], []
    for _ in range(n):
        own = list(base)
        for k in rng.sample(range(words), rng.choice((2, 3, 4))):
            own[k] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def test_few_pairs_of_a_family_are_met(spark, monkeypatch):
    texts, met = family(1200), []
    leftover, verified = similarity._leftover, similarity._verified

    def look(found):
        met.append(found.count())
        return found

    monkeypatch.setattr(similarity, "_leftover", lambda *a: look(leftover(*a)))
    monkeypatch.setattr(similarity, "_verified", lambda pairs, *a: verified(look(pairs), *a))
    df = spark.createDataFrame(list(enumerate(texts)), "request_id long, error_message string")
    got = {r["request_id"]: r["component_id"] for r in similarity.link_similar(df).collect()}

    sets = [set(s.tolist()) for p in T.pieces(pa.array(texts)) for s in similarity.shingle_sets(p, 5)]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if root[i] != root[j] and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert got == dict(enumerate(root))
    assert sum(met) <= 10 * len(texts), met


def test_windows_stay_within_their_text():
    texts = ["a b c d e f", "", None, "a b", " ", "x a b c d e f g", "d e", "a b c d e a b c d e"]
    got = [s.tolist() for p in T.pieces(pa.array(texts)) for s in similarity.shingle_sets(p, 5)]
    for text, own in zip(texts, got, strict=True):
        alone = [s for p in T.pieces(pa.array([text], pa.string())) for s in similarity.shingle_sets(p, 5)][0]
        words = (text or "").split()
        runs = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert own == alone.tolist() == np.unique(alone).tolist() and len(own) == len(runs)
