"""Words and word sequences of a batch of texts as 64-bit hashes, in numpy.

All texts of a batch stand in one byte array. Words are told apart by their bytes, and each different
one is hashed once, by a keyed BLAKE2, so that no words can be made up that share a hash. Words are
split at the ASCII white space bytes 20 and 09-0D.
"""

from __future__ import annotations

from hashlib import blake2b

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_STEP = np.uint64(0xD6E8FEB86659FD93)
_KEY = b"crossbasket words"


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Text(NamedTuple):
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # where each text starts, and the end


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # the index of each text's first word, and the number of words


def text_bytes(column: pa.Array) -> Text:
    """A string column's bytes without copying; null as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return Text(np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    return Text(np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0])


def fold(text: Text) -> Text:
    """A-Z to a-z."""
    return Text(_FOLD[text.data], text.offsets)


def spans_coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different spans and each span's number among them; spans are in order and do not overlap."""
    edges = np.zeros(2 * len(starts) + 1, np.int64)
    edges[:-1:2], edges[1::2], edges[-1] = starts, ends, ends[-1] if len(ends) else 0
    buffers = [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]
    spans = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), buffers)  # and the gaps between them
    coded = spans.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans are in order and do not overlap."""
    spans, number = spans_coded(data, starts, ends)
    digests = b"".join([blake2b(span, digest_size=8, key=_KEY).digest() for span in spans.to_pylist()])
    return np.frombuffer(digests, "<u8").astype(np.uint64)[number]


def split(text: Text, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no separators, within single texts."""
    data, offsets = text
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gap = separator[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = gap[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    edge[inner] = True
    starts = np.flatnonzero(~gap & edge[:-1])
    edge[1:-1] = gap[1:]
    edge[0] = False
    edge[inner] = True
    ends = np.flatnonzero(~gap & edge[1:]) + 1
    return starts, ends


def words(text: Text) -> Words:
    starts, ends = split(text)
    return Words(starts, ends, spans_hash(text.data, starts, ends), np.searchsorted(starts, text.offsets))


def sequences(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a text, and the index of each one's first word."""
    n = len(found.hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * _STEP + found.hashes[i : i + n]
    inside = np.ones(n, bool)
    for back in range(1, width):  # a run that starts so few words before the next text crosses over
        at = found.first[1:] - back
        inside[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(inside)
    return mix(h[at]), at


def word_sequences(text: Text) -> list[bytes]:
    """Of each text a 128-bit hash of its words, in order; the same for other white space between them."""
    space = _SPACE[text.data]
    keep = ~space
    keep[1:] |= ~space[:-1]  # and the first byte of each gap
    plain = np.where(space, np.uint8(0x20), text.data)[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[text.offsets]
    return [
        blake2b(plain[a:b].tobytes().strip(b" "), digest_size=16, key=_KEY).digest() for a, b in zip(at[:-1], at[1:])
    ]
