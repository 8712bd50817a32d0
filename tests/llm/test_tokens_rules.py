"""Token counts, quality rules, passages and personal data against brute force."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from sievekit.llm import passages, personal, repetition, texts, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, rows, extra="n_words"):
    """Log records with a column whose name clashes with a result's."""
    return spark.createDataFrame([(*r, 1) for r in rows], f"request_id long, error_message string, {extra} long")


def test_words_and_lines_of_pieces():
    rng = random.Random(1)
    docs = ["".join(rng.choice(["a", "é", "\n", " ", "\t", "xy"]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    docs += ["", None, "\n"]
    for p in texts.pieces(pa.array(docs), 100):
        start, end, first = p.words()
        l_start, l_end, l_first = p.lines()
        for r in range(len(p)):
            text = docs[p.first + r] or ""
            words = [bytes(p.buf[a:b]).decode() for a, b in zip(start[first[r] : first[r + 1]], end[first[r] : first[r + 1]])]
            rows = [bytes(p.buf[a:b]).decode() for a, b in zip(l_start[l_first[r] : l_first[r + 1]], l_end[l_first[r] : l_first[r + 1]])]
            assert words == BLANK.findall(text) and rows == text.split("\n")


def test_spliced_chunks_count_as_the_whole_text():
    rng, model = random.Random(2), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = tokens.Encoder(MODEL)
    parts = list("abc 12 é漢🙂\n▁") + ["the ", "  ", "illlll", "token"]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(50, 900)))
        for chunk, overlap in ((64, 4), (200, 16)):
            assert encoder.count_long(text, chunk, overlap) == len(model.encode(text))
    assert encoder.count_long("a" * 3000, 256, 8) == len(model.encode("a" * 3000))  # no stable place at all


def test_token_counts(spark):
    rows = [(1, "one two three"), (2, ""), (3, None), (None, "é" * 50), (1, "one two three"), (4, "<s> word " * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "sample_id long, document string, n_tokens long")
    got = tokens.count_tokens(df, MODEL, chunk_bytes=500, overlap_bytes=16).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(k, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for k, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tokens.count_tokens(df.limit(0), MODEL).count() == 0


def brute_runs(words, least):
    covered, longest = set(), 0
    for size in range(least, len(words)):
        seen = {}
        for i in range(len(words) - size + 1):
            seen.setdefault(tuple(words[i : i + size]), []).append(i)
        again = [v for v in seen.values() if len(v) > 1]
        longest = size if again else longest
        covered.update(x for v in again for i in v for x in range(i, i + size))
    return len(covered), longest


def test_suffix_array_repeats():
    rng = random.Random(3)
    for _ in range(300):
        words = np.array([rng.randint(0, 3) for _ in range(rng.randint(0, 40))], np.uint64)
        least = rng.randint(1, 7)
        assert repetition.repeats(words, least) == brute_runs(words.tolist(), least)


def test_quality_rules(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    once = " ".join(rng.sample(base, 60))
    copied = " ".join(base[:12])
    rows = [(1, once), (2, None), (3, ""), (4, "a b # c\na b # c\n\n x"), (5, "x " * 40), (None, once), (1, once)]
    rows += [(6, f"{' '.join(base[20:90])} {copied} {' '.join(base[100:150])} {copied}"), (7, " ".join(base) + "\n" + " ".join(base[:11]))]
    got = sorted(map(tuple, repetition.quality_rules(table(spark, rows)).collect()), key=repr)
    want = []
    for key, text in rows:
        text = text or ""
        words = BLANK.findall(text)
        seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        again = {x for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for x in range(i, i + 5)}
        lines = [x for x in text.split("\n") if BLANK.search(x)]
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        run, longest = brute_runs(words, 10) if len(words) < 300 else (0, 0)
        kept = not failed and 100 * run <= 15 * len(words) and longest <= 200
        symbols = sum(text.count(c) for c in "#*$%&|<>")
        want.append((key, len(words), len("".join(words)), symbols, len(lines) - len(set(lines)), len(again), failed, run, longest, kept))
    assert got == sorted(want, key=repr)
    assert {r[-1] for r in got} == {True, False}
    assert repetition.quality_rules(table(spark, [])).count() == 0


def test_passages(spark):
    rng = random.Random(5)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    voc = [f"v{i}" for i in range(40)]
    items = [("a", " ".join(rng.choices(voc, k=30))), ("b", "Short, passage HERE"), (None, "only this one"), ("c", None), ("d", ""), ("b", "zz")]
    items += [("e", items[0][1])]
    docs = [(i, " ".join(rng.choices(voc, k=rng.randint(0, 40)))) for i in range(40)]
    docs += [(50, "x " * 10 + items[0][1].upper().replace(" ", ", ")), (51, "a short-passage here; Zz"), (None, "only THIS one"), (52, None), (50, "é")]
    windows = {}
    for item, text in items:
        words = word.findall(fold(text))
        size = min(13, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(item)
    want = []
    for key, text in docs:
        words, hit, found = word.findall(fold(text)), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                owners = windows.get(tuple(words[i : i + size]))
                if owners:
                    hit.update(range(i, i + size))
                    found |= owners - {None}
        want.append((key, len(words), len(hit), len(found), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(words)))
    bench = spark.createDataFrame(items, "parameter string, limitation string")
    for block in (1 << 20, 40):  # one block of passages, and several
        got = passages.find_passages(table(spark, docs, "n_hit"), bench, block_chars=block).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert passages.find_passages(table(spark, []), bench).count() == 0
    assert passages.find_passages(table(spark, docs), bench.limit(0)).where("contaminated").count() == 0


def test_personal_data(spark):
    text = "mail a.b+c@x-1.example.org, ip 1.2.3.4 bad 1.2.3.400 card 4111 1111 1111 1111 not 4111111111111112 tel +1 (202) 555-0143"
    rows = [(1, text), (2, None), (3, ""), (None, "é\nx@y.zz"), (1, text), (4, "nothing to see here"), (5, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"')]
    got = personal.find_personal_data(table(spark, rows, "spans")).collect()
    by_key = {r["request_id"]: r for r in got}
    assert len(got) == len(rows)
    values = [(s["kind"], text[s["start"] : s["end"]]) for s in by_key[1]["base"]]
    assert values == [("email", "a.b+c@x-1.example.org"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (202) 555-0143")]
    assert all(s in by_key[1]["spans"] for s in by_key[1]["base"])
    assert [tuple(s) for s in by_key[None]["base"]] == [("email", 2, 8)]
    assert not by_key[2]["spans"] and not by_key[3]["spans"] and not by_key[4]["spans"]
    assert [s["kind"] for s in by_key[5]["spans"]] == ["secret"]
    assert personal.find_personal_data(table(spark, [])).count() == 0


def test_field_on_held_out_lines():
    lines = personal.labelled_lines()
    held = lines[::4]
    model = personal.train([x for i, x in enumerate(lines) if i % 4])
    right = total = 0
    for text, tags in held:
        buf = np.frombuffer(text.encode(), np.uint8)
        start, end, first = texts.Piece(0, 1, buf, np.array([0, len(buf)])).words()
        found = model.decode(personal.shapes(buf, start, end), first[:1], first[1:])
        right += int((found == np.array(tags)).sum())
        total += len(tags)
    assert right >= 0.9 * total


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(6)
    field = personal.Field(rng.normal(size=(3, personal._CODES, 6)).astype(np.float32), rng.normal(size=(6, 6)).astype(np.float32), rng.normal(size=(2, 6)).astype(np.float32))
    codes, first, last = rng.integers(0, 50, 9), np.array([0, 4, 4]), np.array([4, 4, 9])
    got = field.decode(codes, first, last)
    scores = field.scores(codes, first)
    for a, b in ((0, 4), (4, 9)):
        best = max(
            np.ndindex(*[6] * (b - a)),
            key=lambda p: field.ends[0][p[0]] + field.ends[1][p[-1]] + sum(scores[a + i][x] for i, x in enumerate(p)) + sum(field.moves[x][y] for x, y in zip(p, p[1:])),
        )
        assert tuple(got[a:b]) == best


def test_patterns_equal_plain_ones():
    rng = random.Random(7)
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(2000):
        text = "".join(rng.choice("a1.@-+_ %") for _ in range(30))
        assert [(m.start(), m.end()) for m in plain.finditer(text)] == [(s, e) for s, k, e in personal.base_spans(text) if k == 0]


def plain_spans(text):
    """All kinds by their plain patterns and tests."""

    def check_digit(d):
        return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0

    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and check_digit(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_all_patterns_equal_plain_ones():
    rng = random.Random(11)
    pools = ("01.", "0123456789 -", "+12() .-", "a@.1-_", "12.@a+ -(9", "0255.")
    for i in range(6000):
        text = "".join(rng.choice(pools[i % len(pools)]) for _ in range(rng.choice([12, 40])))
        assert personal.base_spans(text) == plain_spans(text), text
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "6011000990139424", "4111 1111 1111 1112", "1" * 14, "0" * 19, "0" * 20]
    for text in [f"x {c} {c}-{c}" for c in cards] + ["300.1.1.1.1", "1.2.3.256.9.9.9.9", "000001.2.3.0255", "a@b.c_d@e.f@g.h"]:
        assert personal.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", [
    "1.2.3." + "4" * 4400, "7" * 10**6, "a" * 10**6 + "@", "a@" * 500_000, "1." * 500_000, "+1" + "(" * 10**6, "a@b." * 250_000,
    "@" + "x" * 10**6, "+1 " * 300_000, "1 - " * 250_000, "9." + "1" * 10**6 + ".1.1", "a@" + "b-" * 500_000,
])
def test_patterns_read_long_texts_in_linear_time(text):
    began = time.process_time()
    found = personal.base_spans(text)
    assert time.process_time() - began < 5
    assert all(0 <= s < e <= len(text) for s, _, e in found)


def test_personal_data_in_long_texts(spark):
    rows = [(1, "1.2.3." + "4" * 4400), (2, "7" * 300_000), (3, "a@" * 150_000), (4, "x" * 300_000 + " 10.0.0.1")]
    got = {r["request_id"]: r["base"] for r in personal.find_personal_data(spark.createDataFrame(rows, "request_id long, error_message string")).collect()}
    assert [got[1], got[2], got[3]] == [[], [], []] and [tuple(x) for x in got[4]] == [("ip", 300_001, 300_009)]
