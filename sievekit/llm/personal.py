"""Personal data in messages: fixed patterns, and a linear-chain conditional random field for what they miss."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import texts as T

#: Kinds in the order in which spans of one start are listed; the patterns know the first four.
KINDS = ("email", "ip", "card", "phone", "secret")

# Possessive where giving back could not help, and tried only where a run starts: what fails there
# fails in all of the run, so that each run is read a fixed number of times.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_EMAIL_RUN = re.compile(rf"(?<![A-Za-z0-9._%+-]){_EMAIL.pattern}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: A small labelled table: lines in which personal data stand in braces behind their kind.
LABELLED = (
    "please write to {email jane.roe@example.org} about the sample",
    "contact: {email ops.team+42@mail.example.net} for access",
    "mail sent from {email x_1%y@sub.example.co.uk} yesterday",
    "reply to {email <admin@example.com>,} not to the list",
    "ask {email jane_roe@localhost} about it",
    "login from {ip 10.20.30.40} failed twice",
    "host {ip 192.168.1.77,} port open",
    "client {ip (172.16.254.1)} dropped the request",
    "request by {ip 8.8.4.4} took long",
    "card {card 4111 1111 1111 1111} was declined",
    "paid with {card 5500-0000-0000-0004} at noon",
    "number {card 340000000000009} on file",
    "charge {card 6011000990139424,} then refund",
    "call {phone +1 (202) 555-0143} after ten",
    "phone: {phone +44 20 7946 0958} or desk",
    "dial {phone +49-30-901820-15} now",
    "tel {phone +33.1.99.00.11.22} office",
    "call {phone (202) 555-0143} before noon",
    "desk {phone 202-555-0197} or mail",
    "phone {phone 030 901 820 15} please",
    'token = {secret "3f9a61c07be24d5892ac01ffdd43be6790aa51c2"} in config',
    "{secret api_key=a81bc81b9f3e47d2a6c4e5f60718293a} leaked here",
    "secret: {secret 9b74c9897bac770ffc029102a200c5de9b74c989} was set",
    'password = {secret "77de68daecd823babbb58edb1c8e14d7106e83bb"} found',
    "the kernel length was 6.8 mm in sample 12",
    "run 003_14_10_26 took 1210 ms and 512.5 mb",
    "there were 35 broken and 10 whole items of 45",
    "in 1999 and 2004 the limit of 3.0 percent was changed",
    "version 2.4.1 of the model loaded in 0.5 s",
    "see section 4 and table 2-1 for details",
    "stage segmentation failed with ValueError at line 120",
    "A long plain sentence without any figures stands here.",
    "the of and with for this that are from on at by",
    "Thereafter some lengthier expressions, separated by commas, followed.",
    "Short one. Another. And more words, then the end of it.",
    "numbers like 4785380592391141 or 12345678901234567890 mean nothing",
    "count 8836152 rows, 1048576 bytes, id 90210",
    "These words*** are%%% junk&&& but### not$$$ private!!",
    "Prices rose by 12 % (from 100 to 112) this year",
    "le texte était très long et à peine lisible",
    "die Größe der Körner wurde über Nacht geprüft",
    "el arroz está limpio y la muestra también",
    "THE!! SHOUTED!! LINE!! GOES!! ON!! FOR!! LONG!!",
    "name | value | unit | note | other",
    "(see above) and (see below) in the text",
    "ratio = length / breadth for every item",
    "pages 10-20, 33-35 and 101 were read",
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and int(digits) <= 255)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, by start and kind."""
    found = []
    if "@" in text:
        end = 0
        while m := _EMAIL.match(text, end) or _EMAIL_RUN.search(text, end):
            found.append((m.start(), 0, end := m.end()))  # the next address may start inside the run that this one ends in
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- word shapes -------------------------------------------------------------

_CLASS = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "high": [*range(128, 256)],
    "hex": [*range(48, 58), *range(97, 103)], "at": [64], "dot": [46], "dash": [45], "round": [40, 41], "equals": [61, 58],
    "quote": [34, 39], "other": [c for c in range(33, 127) if chr(c) in "#*$%&|!<>/_~^;,?"],
}
_MASKS = {name: np.isin(np.arange(256), codes) for name, codes in _CLASS.items()}
#: Fields of a shape and the number of their values; a code packs them all.
_FIELDS = (
    ("upper", 2), ("lower", 2), ("high", 2), ("digits", 5), ("at", 2), ("dots", 3), ("dash", 2), ("round", 2),
    ("equals", 2), ("quote", 2), ("other", 2), ("plus", 2), ("length", 4), ("hex", 2),
)
_CODES = int(np.prod([n for _, n in _FIELDS]))


def shapes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Shape code of every word of a piece."""

    def count(name: str) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(_MASKS[name][buf], out=sums[1:])
        return sums[end] - sums[start]

    length = end - start
    values = {name: np.minimum(count(name), 1) for name in ("upper", "lower", "high", "at", "dash", "round", "equals", "quote", "other")}
    values["digits"] = np.digitize(count("digit"), [1, 4, 8, 16])
    values["dots"] = np.digitize(count("dot"), [1, 3])
    values["plus"] = (buf[start] == 43).astype(np.int64)
    values["length"] = np.digitize(length, [4, 8, 20])
    hexes = count("hex")
    values["hex"] = ((hexes >= 16) & (hexes * 10 >= length * 7) & (values["digits"] > 2)).astype(np.int64)
    code = np.zeros(len(start), np.int64)
    for name, n in _FIELDS:
        code = code * n + values[name]
    return code


def _features(codes: np.ndarray) -> np.ndarray:
    """(words, fields): the feature number of each field's value."""
    out, base, rest = np.zeros((len(codes), len(_FIELDS)), np.int64), 0, codes.copy()
    values = []
    for _, n in reversed(_FIELDS):
        values.append(rest % n)
        rest = rest // n
    for i, ((_, n), v) in enumerate(zip(_FIELDS, reversed(values))):
        out[:, i] = base + v
        base += n
    return out


_WIDTH = sum(n for _, n in _FIELDS)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Field:
    """A linear-chain conditional random field over the shapes of a word and its two neighbours."""

    words: np.ndarray  # (3, shape codes, labels): as previous, own and next word's shape
    moves: np.ndarray  # (labels, labels)
    ends: np.ndarray  # (2, labels): at the begin and at the end of a line

    def scores(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(words, labels) for lines that begin at ``first`` (without the final end)."""
        out = self.words[1][codes].copy()
        before = np.ones(len(codes), bool)
        before[first[first < len(codes)]] = False
        inner = np.flatnonzero(before)
        out[inner] += self.words[0][codes[inner - 1]]
        out[inner - 1] += self.words[2][codes[inner]]
        return out

    def decode(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Viterbi labels of all words; lines (first, last) advance together, longest first."""
        score = self.scores(codes, first)
        size = last - first
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        first, size = first[order], size[order]
        labels = np.zeros(len(codes), np.int8)
        if not len(order):
            return labels
        back = np.zeros((len(codes), len(self.moves)), np.int8)
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # lines longer than t
        best = self.ends[0] + score[first]
        final = best.copy()
        for t in range(1, int(size[0])):
            k = active[t]
            at = first[:k] + t
            paths = best[:k, :, None] + self.moves
            choice = paths.argmax(axis=1)
            back[at] = choice
            best = np.take_along_axis(paths, choice[:, None, :], 1)[:, 0] + score[at]
            final[:k] = best
        label = (final + self.ends[1]).argmax(axis=1)
        for t in range(int(size[0]) - 1, -1, -1):
            k = active[t]
            at = first[:k] + t
            labels[at] = label[:k]
            label[:k] = back[at, label[:k]]
        return labels


def labelled_lines(table: Sequence[str] = LABELLED) -> list[tuple[str, list[int]]]:
    """Each line's text, and the label of each of its words."""
    found = []
    for line in table:
        words, tags = [], []
        for i, part in enumerate(re.split(r"[{}]", line)):
            kind, _, inner = part.partition(" ") if i % 2 else ("", "", part)
            own = inner.split()
            words += own
            tags += [1 + KINDS.index(kind) if i % 2 else 0] * len(own)
        found.append((" ".join(words), tags))
    return found


def train(lines: Sequence[tuple[str, Sequence[int]]], rounds: int = 150, penalty: float = 0.02, rate: float = 0.3) -> Field:
    """Fit by full-batch gradient ascent of the penalised likelihood (forward-backward); no randomness."""
    n = len(KINDS) + 1
    examples = []
    for text, tags in lines:
        buf = np.frombuffer(text.encode(), np.uint8)
        piece = T.Piece(0, 1, buf, np.array([0, len(buf)]))
        start, end, _ = piece.words()
        if len(start):
            examples.append((_features(shapes(buf, start, end)), np.asarray(tags, np.int64)))
    weight, moves, ends = np.zeros((3, _WIDTH, n)), np.zeros((n, n)), np.zeros((2, n))
    parts = [weight, moves, ends]
    squares = [np.full_like(p, 1e-8) for p in parts]
    for _ in range(rounds):
        grads = [-penalty * p for p in parts]
        for feats, tags in examples:
            score = weight[1][feats].sum(1)
            score[1:] += weight[0][feats[:-1]].sum(1)
            score[:-1] += weight[2][feats[1:]].sum(1)
            size = len(tags)
            ahead, behind = np.zeros((size, n)), np.zeros((size, n))
            ahead[0] = ends[0] + score[0]
            for t in range(1, size):
                ahead[t] = _logsum(ahead[t - 1][:, None] + moves, 0) + score[t]
            behind[-1] = ends[1]
            for t in range(size - 2, -1, -1):
                behind[t] = _logsum(moves + score[t + 1] + behind[t + 1], 1)
            total = _logsum(ahead[-1] + ends[1], 0)
            node = -np.exp(ahead + behind - total)
            node[np.arange(size), tags] += 1
            for k, (shift, rows) in enumerate(((0, node[1:]), (0, node), (1, node[:-1]))):
                own = (feats[:-1], feats, feats[1:])[k]
                for f in range(own.shape[1]):
                    np.add.at(grads[0][k], own[:, f], rows)
            for t in range(1, size):
                grads[1] -= np.exp(ahead[t - 1][:, None] + moves + score[t] + behind[t] - total)
                grads[1][tags[t - 1], tags[t]] += 1
            grads[2][0] += node[0]
            grads[2][1] += node[-1]
        for p, g, s in zip(parts, grads, squares):
            s += g * g
            p += rate * g / np.sqrt(s)
    feats = _features(np.arange(_CODES))
    table = np.stack([weight[k][feats].sum(1) for k in range(3)]).astype(np.float32)
    return Field(table, moves.astype(np.float32), ends.astype(np.float32))


def _sound(kind: int, value: str) -> bool:
    """What the field calls a datum of this kind could be one; the tests of the patterns hold for it too."""
    digits = "".join(_DIGIT.findall(value))
    if kind == 0:
        return 0 < value.find("@") < len(value) - 1
    if kind == 1:
        return value.count(".") == 3 and all(x.isdecimal() and _octet(x) for x in value.split("."))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 10 <= len(digits) <= 15 and len(digits) < len(value) and not re.search(r"[A-Za-z@]", value)
    return len(value) >= 16 and len(digits) >= 4 and bool(re.search(r"[A-Za-z]", value))


_TRIM = ' \t.,;:!?"\'<>[]{}*#$%&|=~`'


def _spans(piece: T.Piece, row: int, text: str, start, end, first, labels, chars) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points of the runs of one label, without marks around them."""
    a, b = int(first[row]), int(first[row + 1])
    own = labels[a:b]
    hit = np.flatnonzero(own)
    out = []
    if not len(hit):
        return out
    cut = np.flatnonzero((np.diff(hit) > 1) | (own[hit[1:]] != own[hit[:-1]])) + 1
    zero = chars[piece.offsets[row]]
    for run in np.split(hit, cut):
        lo, hi = int(chars[start[a + run[0]]] - zero), int(chars[end[a + run[-1]]] - zero)
        while lo < hi and text[lo] in _TRIM:
            lo += 1
        while hi > lo and text[hi - 1] in _TRIM:
            hi -= 1
        if lo < hi and _sound(int(own[run[0]]) - 1, text[lo:hi]):
            out.append((lo, int(own[run[0]]) - 1, hi))
    return out


def find_personal_data(
    records: DataFrame,
    key: str = "request_id",
    text: str = "error_message",
    labelled: Sequence[tuple[str, Sequence[int]]] | None = None,
) -> DataFrame:
    """Personal data in the message of every log record.

    ``records`` has ``key`` (the ``request_id``) and ``text`` (a free text such as
    ``error_message``). Returns ``key, spans, base``: arrays of ``(kind, start, end)`` in code
    points, end exclusive, by start and then in the order of ``KINDS``. ``base`` are those of
    the fixed patterns: email, ip (parts up to 255), card (14 to 19 digits with a right check
    digit) and phone (10 to 15 digits); matches that fail their test are dropped. ``spans`` also
    has what the conditional random field adds where no pattern matched, such as secrets,
    phone numbers without a plus, and addresses without a domain; what it adds must pass the
    same tests of digits.

    The field is trained on the driver from ``labelled``, a small table of lines and a label per
    word (0 or 1 + the place in ``KINDS``; by default the one in this module), over the shapes
    of words (character classes, digits, length) and of their neighbours. A line of a text is a
    sequence; Viterbi runs over all lines of a batch at once.

    Null and empty texts have no spans. Time grows with a text's length, whatever it holds. Repeated rows and null keys stay. Only two columns are
    read, so other names cannot clash. An empty table gives an empty result.
    """
    model = train(labelled_lines() if labelled is None else labelled)
    sent = records.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def named(found: list[tuple[int, int, int]]) -> list[dict]:
        return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            base, both = [], []
            texts = batch.column(1)
            for p in T.pieces(texts):
                start, end, first = p.words()
                l_start, l_end, _ = p.lines()
                labels = field.decode(shapes(p.buf, start, end), np.searchsorted(start, l_start), np.searchsorted(start, l_end))
                chars = np.concatenate([[0], np.cumsum(p.buf & 0xC0 != 0x80)])
                for r in range(len(p)):
                    value = texts[p.first + r].as_py() or ""
                    known = base_spans(value)
                    more = _spans(p, r, value, start, end, first, labels, chars)
                    if known and more:
                        more = [x for x in more if all(x[2] <= s or e <= x[0] for s, _, e in known)]
                    base.append(named(known))
                    both.append(named(sorted(known + more)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both, kinds), pa.array(base, kinds)], ["key", "spans", "base"])

    kind = records.schema[key].dataType.simpleString()
    rows = records.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(find, f"key {kind}, spans {span}, base {span}").withColumnRenamed("key", key)
