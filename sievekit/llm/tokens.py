"""Token counts of result documents, also of huge ones."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder:
    """A sentencepiece model, and which neighbouring characters none of its pieces joins."""

    def __init__(self, model: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        joined = set()
        for i in range(self.model.vocab_size()):
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)):
                piece = self.model.id_to_piece(i).replace("▁", " ")
                joined.update(zip(piece, piece[1:]))
        self.joined = joined

    def ends(self, text: str) -> np.ndarray:
        """End byte of every token."""
        return np.fromiter((p.end for p in self.model.encode(text, return_type="proto").pieces), np.int64)

    def stable(self, left: str, right: str) -> bool:
        """No piece holds these characters side by side, so no merge ever crosses this place."""
        return (left.replace("▁", " "), right.replace("▁", " ")) not in self.joined

    def count_long(self, text: str, chunk: int, overlap: int) -> int:
        """Tokens of a text that is encoded in overlapping chunks of about ``chunk`` bytes.

        Neighbouring chunks are spliced at the first token boundary that both have in their
        overlap and that is proven stable. Where there is none, the overlap of that seam is
        widened fourfold; a seam whose overlap reaches its neighbours' is given up, and the
        two chunks become one.
        """
        data = text.encode()

        def whole(at: int) -> int:  # the start of the character at a byte
            at = min(max(at, 0), len(data))
            while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
                at -= 1
            return at

        seams = [(whole(at), overlap) for at in range(chunk, len(data), chunk)]
        encoded: dict[tuple[int, int], np.ndarray] = {}

        def tokens(start: int, end: int) -> np.ndarray:
            if (start, end) not in encoded:
                encoded[start, end] = start + self.ends(data[start:end].decode())
            return encoded[start, end]

        while True:
            reach = [(0, 0), *((whole(at - wide), whole(at + wide)) for at, wide in seams), (len(data), len(data))]
            spans = [(reach[i][0], reach[i + 1][1]) for i in range(len(reach) - 1)]
            encoded = {k: v for k, v in encoded.items() if k in set(spans)}
            splices, again = [0], []
            for i, (at, wide) in enumerate(seams):
                lo, hi = reach[i + 1]
                both = np.intersect1d(tokens(*spans[i]), tokens(*spans[i + 1]))
                both = both[(both > lo) & (both < hi)]
                place = next((int(b) for b in both if self._proven(data, int(b))), None)
                if place is not None:
                    splices.append(place)
                    again.append((at, wide))
                elif 4 * wide < chunk // 2:
                    again.append((at, 4 * wide))
            if len(splices) == len(seams) + 1:
                break
            seams = again
        splices.append(len(data))
        total = 0
        for i, span in enumerate(spans):
            ends = tokens(*span)
            total += int(np.sum((ends <= splices[i + 1]) & ((ends > splices[i]) | (i == 0))))
        return total

    def _proven(self, data: bytes, at: int) -> bool:
        start = at - 1
        while data[start] & 0xC0 == 0x80:
            start -= 1
        return self.stable(data[start:at].decode(), data[at : at + 4].decode(errors="ignore")[:1])


@lru_cache(maxsize=2)
def _encoder(model: str) -> Encoder:
    return Encoder(model)


def count_tokens(
    documents: DataFrame,
    model: str,
    key: str = "sample_id",
    text: str = "document",
    limit: int = 4096,
    chunk_bytes: int = 1 << 15,
    overlap_bytes: int = 256,
) -> DataFrame:
    """Bytes and tokens of the result document of every sample.

    ``documents`` has a row per result document: ``key`` (the ``sample_id``) and ``text`` (the
    ``document``, a JSON text that grows with the instances of its sample). ``model`` is the
    path of a sentencepiece model that every executor can read. Returns ``key, n_bytes,
    n_tokens, over_limit``; tokens as the library gives them, without begin and end tokens.

    Documents of more than ``chunk_bytes`` bytes are encoded in overlapping chunks (see
    ``Encoder.count_long``), so that memory does not grow with the document's tokens.
    Null and empty texts have 0 bytes and 0 tokens. Rows are handled one by one: repeated
    rows and null keys come out as often as they went in. Other columns are not read, so
    their names cannot clash. An empty table gives an empty result.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            counts = np.zeros(len(texts), np.int64)
            short = np.flatnonzero(sizes <= chunk_bytes)
            for part in np.array_split(short, max(1, len(short) // 256)):
                found = encoder.model.encode([texts[i] for i in part], out_type=int, num_threads=1)
                counts[part] = [len(x) for x in found]
            for i in np.flatnonzero(sizes > chunk_bytes):
                counts[i] = encoder.count_long(texts[i], chunk_bytes, overlap_bytes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts)], ["key", "n_bytes", "n_tokens"])

    value = F.coalesce(F.col(text), F.lit(""))
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(
        F.col(key).alias("key"), value.alias("text"), F.octet_length(value).cast("long").alias("n_bytes")
    )
    found = rows.mapInArrow(counted, f"key {kind}, n_bytes bigint, n_tokens bigint")
    return found.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
