"""Token counts by overlap resynchronisation.

Texts up to ``CHUNK`` characters are encoded whole by the sentencepiece library. A longer one is
encoded in overlapping chunks whose tokens carry their offsets. Two encodings are spliced behind
a token that both have at the same offsets. That is proven to give the encoding of the whole:
a sequence of BPE tokens is the encoding of its text exactly if every two neighbours are the
encoding of theirs, and behind a common token each pair of neighbours of the spliced sequence
stands in one of the two encodings. Where the overlap holds no common token it is doubled, back to
the start of the text if need be. Byte tokens do not count as common ones, as several share an offset.

Nothing is shuffled; a task holds one Arrow batch and the tokens of one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from crossbasket.llm.batches import arrow_schema, map_batches, pieces, texts

CHUNK = 16_384
OVERLAP = 256
LIMIT = 4096
# a normalizer_spec with add_dummy_prefix off; messages of one field merge when a model is read
_NO_PREFIX = b"\x1a\x02\x18\x00"


class ChunkedEncoder:
    """A sentencepiece BPE model that can encode texts in pieces."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        with open(path, "rb") as file:
            model = file.read()
        self.chunk, self.overlap = chunk, overlap
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model + _NO_PREFIX)
        size = self.model.get_piece_size()
        self.chars = np.zeros(size, np.int64)  # characters a token stands for
        self.plain = np.zeros(size, bool)
        for i in range(size):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):  # the first byte of a character counts for it
                self.chars[i] = int(piece[1:-1], 16) & 0xC0 != 0x80
            elif not (self.model.is_control(i) or self.model.is_unknown(i)):
                self.chars[i], self.plain[i] = len(piece), True

    def _part(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.bare.encode(text[start:end]), np.int64)
        return ids, start + np.cumsum(self.chars[ids])

    def _keys(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.where(self.plain[ids], (ends - self.chars[ids]) * len(self.chars) + ids, -1)

    def encode_long(self, text: str) -> np.ndarray:
        """Token ids of a text of any length, encoded chunk by chunk."""
        if not text:
            return np.empty(0, np.int64)
        text = " " + text  # what the model itself puts in front
        end = min(len(text), self.chunk)
        before: list[tuple[np.ndarray, np.ndarray]] = []  # what no later chunk is expected to reach
        done, ends = self._part(text, 0, end)
        while end < len(text):
            upto, overlap = min(len(text), end + self.chunk), self.overlap
            while True:
                while before and (not len(ends) or ends[0] > end - overlap):
                    earlier = before.pop()
                    done, ends = np.concatenate([earlier[0], done]), np.concatenate([earlier[1], ends])
                # from a boundary of what is done: texts that repeat themselves go on in step
                last = int(np.searchsorted(ends, end - overlap, side="right")) - 1
                start = int(ends[last]) if last >= 0 else 0
                ids, id_ends = self._part(text, start, upto)
                if not start:
                    before, done, ends = [], ids, id_ends
                    break
                first = int(np.searchsorted(ends, start))
                tail, keys = self._keys(done[first:], ends[first:]), self._keys(ids, id_ends)
                common = np.intersect1d(tail[tail >= 0], keys[keys >= 0])
                if len(common):
                    a = first + int(np.flatnonzero(tail == common[0])[0])
                    b = int(np.flatnonzero(keys == common[0])[0])
                    before.append((done[: a + 1], ends[: a + 1]))
                    done, ends = ids[b + 1 :], id_ends[b + 1 :]
                    break
                overlap *= 2
            end = upto
        return np.concatenate([*[ids for ids, _ in before], done])

    def counts(self, batch: list[str]) -> list[int]:
        out = [0] * len(batch)
        short = [i for i, text in enumerate(batch) if len(text) <= self.chunk]
        encoded = self.model.encode([batch[i] for i in short], num_threads=1)
        for i, ids in zip(short, encoded):
            out[i] = len(ids)
        for i, text in enumerate(batch):
            if len(text) > self.chunk:
                out[i] = len(self.encode_long(text))
        return out


@lru_cache(maxsize=2)
def _encoder(path: str, chunk: int, overlap: int) -> ChunkedEncoder:
    return ChunkedEncoder(path, chunk, overlap)


def token_counts(
    documents: DataFrame, model: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row of ``documents``.

    ``model`` is the path of a sentencepiece BPE model that every executor has. No begin, end or
    other special tokens are added. Null and empty texts have no bytes and no tokens; repeated
    rows give repeated results; other columns are ignored; an empty table gives an empty result.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    out = arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, chunk, overlap)
        for batch in batches:
            for piece in pieces(batch):
                values = texts(piece.column(1))
                n_tokens = encoder.counts(values)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array([len(text.encode()) for text in values], pa.int64()),
                        pa.array(n_tokens, pa.int64()),
                        pa.array([n > limit for n in n_tokens], pa.bool_()),
                    ],
                    schema=out,
                )

    return map_batches(documents.select("doc_id", documents["text"].cast("string").alias("text")), count, schema)
