"""Byte-level BPE through a sentencepiece model written straight from the vocabulary.

Every token becomes a piece: its bytes as printable characters, one each, scored by its negative
rank, under identity normalisation. The sentencepiece library then merges as byte-level BPE
does, the pair of lowest rank first and the leftmost of equals. A text is cut by the vocabulary's
pattern and each match, a pre-token, is encoded on its own; one that is a token itself is taken
whole. Decoding maps ids to pieces and their characters back to bytes.

Nothing is shuffled. A task keeps the ids of pre-tokens it has met, at most ``CACHE`` of them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from crossbasket.llm.batches import arrow_schema, map_batches, pieces, texts

CACHE = 200_000


def byte_alphabet() -> list[str]:
    """A printable character for each byte; printable Latin-1 bytes keep their own."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens with their ranks from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        pairs = (line.split() for line in file if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The vocabulary as a serialised sentencepiece BPE model in which a token's id is its rank."""
    letters = byte_alphabet()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[token] for token in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2 and so on")

    def piece(text: str, score: float, kind: int) -> bytes:
        return _message(1, _message(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + _varint(kind))

    normal, unknown, bpe = 1, 2, 2
    body = [piece("".join(letters[b] for b in token), -float(rank), normal) for rank, token in enumerate(tokens)]
    body.append(piece("<unk>", 0.0, unknown))
    trainer = b"\x18" + _varint(bpe)
    # identity; no prefix, no removal and no escaping of white space
    normalizer = _message(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"
    return b"".join(body) + _message(2, trainer) + _message(3, normalizer)


class ByteBpe:
    """Encodes and decodes texts by the ranks of a byte-level BPE."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        back = {c: b for b, c in enumerate(byte_alphabet())}
        pieces_ = [self.model.id_to_piece(i) for i in range(len(ranks))]
        self.bytes_of = [bytes(back[c] for c in piece) for piece in pieces_]
        self.whole = {piece: i for i, piece in enumerate(pieces_)}
        self.cache: dict[str, bytes] = {}
        self.limit = cache

    def _learn(self, tokens: set[str]) -> None:
        if len(self.cache) + len(tokens) > self.limit:
            self.cache = {}
        new = [token for token in tokens if token not in self.cache]
        spelled = [token.encode().decode("latin-1").translate(self.letters) for token in new]
        whole = self.whole
        split = [i for i, piece in enumerate(spelled) if piece not in whole]
        for token, piece in zip(new, spelled):
            if piece in whole:
                self.cache[token] = struct.pack("<I", whole[piece])
        for i, ids in zip(split, self.model.encode([spelled[i] for i in split], num_threads=1)):
            self.cache[new[i]] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        tokens = self.split(text)
        seen = self.cache
        missing = {token for token in tokens if token not in seen}
        if missing:
            self._learn(missing)
            if self.cache is not seen:  # emptied on the way
                self._learn(set(tokens))
        return b"".join(map(self.cache.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def byte_bpe(documents: DataFrame, ranks: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encodes every text and decodes the ids again.

    ``ranks`` is the path of a rank file that every executor has, ``pattern`` cuts texts into
    pre-tokens. Returns ``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, with ``ids``
    (binary, little-endian 32-bit) on request. A null text is an empty one: no tokens, digests of
    nothing. Repeated rows give repeated results; other columns are ignored.
    """
    fields = [
        T.StructField("doc_id", documents.schema["doc_id"].dataType),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            for piece in pieces(batch):
                ids = [codec.encode(text) for text in texts(piece.column(1))]
                columns = [
                    piece.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                columns += [pa.array(ids, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return map_batches(documents.select("doc_id", documents["text"].cast("string").alias("text")), run, schema)
