"""Secret scan: fixed patterns, and character Markov models for random strings that no pattern names.

The base patterns find assignments, access keys and long hexadecimal runs. Beside them every run of
token characters, whatever its length and its characters, is scored by two first-order Markov models of
characters: one of random strings, one of ordinary identifiers and words. Where the log-likelihood
ratio reaches the threshold of its length and no base span overlaps, a span of the kind ``random`` is
added.

The models learn from labelled samples: the values that the base patterns mark, against all other
token runs. Their transitions are counted over all texts in the tasks; Spark adds the counts, two
tables of ``len(ALPHABET) + 1`` squared entries. A second scan counts the scores of the other runs by
length, and a length's threshold is what at most ``FALSE_ALARMS`` of them reach: at most ``THRESHOLD``,
which also holds where too few runs are there to tell.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossbasket.llm import wordhash
from crossbasket.llm.batches import arrow_schema, map_batches, pieces, texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
THRESHOLD = 12.0
FALSE_ALARMS = 1e-5
LEAST = 3.0  # no threshold is lower
SHORTEST = 6  # characters of a labelled value; shorter runs keep THRESHOLD
LENGTHS = 64  # longer runs count as this long
_BINS, _BIN = 64, 0.25  # of scores, from nothing to 16 nats
_STATES = len(ALPHABET) + 1  # 0 stands before the first character
_CODES = np.zeros(256, np.int64)
_CODES[list(ALPHABET.encode())] = np.arange(1, _STATES)
_NO_TOKEN = _CODES == 0
_NO_HEX = np.ones(256, bool)
_NO_HEX[list(b"0123456789abcdef")] = False
_NO_ACCESS = np.ones(256, bool)
_NO_ACCESS[[*range(0x30, 0x3A), *range(0x41, 0x5B)]] = False
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")

Span = tuple[int, int, int, str]  # start, kind, end, value


def base_spans(text: str) -> list[Span]:
    """What the base patterns find, each kind leftmost and not overlapping, by start and kind."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found)


def _runs(text: wordhash.Text) -> tuple[np.ndarray, np.ndarray]:
    return wordhash.split(text, _NO_TOKEN)


def _texts_at(text: wordhash.Text, at: np.ndarray) -> np.ndarray:
    """Which texts hold the bytes at these places."""
    flags = np.zeros(len(text.offsets) - 1, bool)
    flags[np.searchsorted(text.offsets[1:], at, side="right")] = True
    return flags


def _need_base(text: wordhash.Text) -> np.ndarray:
    """Which texts need the base patterns."""
    need = _texts_at(text, np.flatnonzero((text.data == ord("=")) | (text.data == ord(":"))))
    for separator, length in ((_NO_HEX, 24), (_NO_ACCESS, 20)):
        starts, ends = wordhash.split(text, separator)
        need |= _texts_at(text, starts[ends - starts >= length])
    return need


def _run_scores(text: wordhash.Text, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the runs of token characters start, how long they are and what they score."""
    codes = _CODES[text.data]
    starts, ends = _runs(text)
    before = np.zeros(len(codes), np.int64)
    before[1:] = codes[:-1]
    before[starts] = 0
    sums = np.zeros(len(codes) + 1)
    np.cumsum(ratios[before * _STATES + codes], out=sums[1:])
    return starts, ends - starts, sums[ends] - sums[starts]


def _transitions(codes: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], codes[:-1]])
    return before * _STATES + codes


def _string_codes(value: str) -> np.ndarray:
    codes = _CODES[np.frombuffer(value.encode(), np.uint8)]
    return codes[codes > 0]


def transition_counts(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Character transitions in secret values and in all other token runs, over all texts."""
    schema = T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType())])
    out = arrow_schema(schema)
    size = _STATES**2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        secret, every = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                bytes_ = wordhash.text_bytes(piece.column(0))
                codes = _CODES[bytes_.data]
                before = np.zeros(len(codes), np.int64)
                before[1:] = codes[:-1]
                inner = bytes_.offsets[:-1]
                before[inner[inner < len(codes)]] = 0
                token = codes > 0
                every += np.bincount(before[token] * _STATES + codes[token], minlength=size)
                need = _need_base(bytes_)
                for text in np.array(texts(piece.column(0)), object)[need]:
                    for _, _, _, value in base_spans(text):
                        for run in _RUN.findall(value):
                            secret += np.bincount(_transitions(_string_codes(run)), minlength=size)
        entries = np.concatenate([secret, every])
        at = np.flatnonzero(entries)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(entries[at], pa.int64())], schema=out)

    rows = map_batches(documents.select(F.col("text").cast("string").alias("text")), count, schema)
    totals = np.zeros(2 * size, np.int64)
    for row in rows.groupBy("entry").agg(F.sum("n").alias("n")).collect():  # at most 2 * size rows
        totals[row["entry"]] = row["n"]
    return totals[:size], np.maximum(totals[size:] - totals[:size], 0)


def log_ratios(secret: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """How much each transition speaks for a random string. Strings of the whole alphabet are mixed into
    both sides, into the secret one by half, as the samples need not hold all kinds of either."""

    def model(counts: np.ndarray, prior: float) -> np.ndarray:
        table = counts.reshape(_STATES, _STATES)[:, 1:].astype(np.float64)
        return (table + prior) / (table + prior).sum(1, keepdims=True)

    uniform = 1 / len(ALPHABET)
    table = np.zeros((_STATES, _STATES))
    random, plain = model(secret, 1.0), model(ordinary, 0.5)
    table[:, 1:] = np.log(0.5 * random + 0.5 * uniform) - np.log(0.9 * plain + 0.1 * uniform)
    return table.reshape(-1)


def _cells(lengths: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """A cell for each length and bin of scores; the first bin also holds lower ones, the last higher ones."""
    bins = np.clip(np.floor(scores / _BIN), 0, _BINS - 1).astype(np.int64)
    return np.minimum(lengths, LENGTHS) * _BINS + bins


def score_counts(documents: DataFrame, ratios: np.ndarray) -> np.ndarray:
    """How many token runs outside base spans have each length and score, over all texts."""
    shared = documents.sparkSession.sparkContext.broadcast(ratios)
    schema = T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType())])
    out = arrow_schema(schema)
    size = (LENGTHS + 1) * _BINS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = np.zeros(size, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                bytes_ = wordhash.text_bytes(piece.column(0))
                _, lengths, scores = _run_scores(bytes_, shared.value)
                entries += np.bincount(_cells(lengths, scores), minlength=size)
                for text in np.array(texts(piece.column(0)), object)[_need_base(bytes_)]:
                    base = base_spans(text)
                    covered = _Covered(base)
                    marked = [m[0] for m in _RUN.finditer(text) if covered.overlaps(m)] if base else []
                    if marked:
                        scores = np.array([run_score(run, shared.value) for run in marked])
                        entries -= np.bincount(_cells(np.array([len(run) for run in marked]), scores), minlength=size)
        at = np.flatnonzero(entries)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(entries[at], pa.int64())], schema=out)

    rows = map_batches(documents.select(F.col("text").cast("string").alias("text")), count, schema)
    totals = np.zeros(size, np.int64)
    for row in rows.groupBy("entry").agg(F.sum("n").alias("n")).collect():  # at most size rows
        totals[row["entry"]] = row["n"]
    return np.maximum(totals, 0).reshape(LENGTHS + 1, _BINS)


def thresholds(counts: np.ndarray, highest: float = THRESHOLD) -> np.ndarray:
    """The threshold of each length: the lowest that at most ``FALSE_ALARMS`` of the runs as long or
    longer reach. Where these are too few for such a share, shorter runs are taken in. Runs that reach
    ``highest`` count as random strings that no pattern names, so they do not raise it."""
    enough = 1 / FALSE_ALARMS
    counts = counts[:, : int(highest / _BIN)]
    longer = counts[::-1].cumsum(0)[::-1]
    out = np.full(len(counts), highest)
    supported = np.flatnonzero(longer.sum(1) >= enough)
    for length in range(SHORTEST, len(counts)):
        pool = supported[supported <= length]
        if len(pool):
            own = longer[pool[-1]]
            reach = own[::-1].cumsum()[::-1]  # runs in this bin or above
            lowest = np.flatnonzero(reach <= FALSE_ALARMS * own.sum())
            if len(lowest):
                out[length] = min(highest, max(LEAST, lowest[0] * _BIN))
    return out


def run_score(run: str, ratios: np.ndarray) -> float:
    return float(ratios[_transitions(_string_codes(run))].sum())


class _Covered:
    """What some spans, sorted by start, cover: stretches that are apart, so that one look finds an overlap."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, _, end, _ in spans:
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, m: re.Match) -> bool:
        last = bisect_left(self.starts, m.end()) - 1
        return last >= 0 and m.start() < self.ends[last]


def scan(text: str, ratios: np.ndarray, threshold: float | np.ndarray = THRESHOLD) -> list[Span]:
    """Base spans and those of random strings, by start and kind. ``threshold``: one, or one a length."""
    base = base_spans(text)
    found, covered = list(base), _Covered(base)
    limits = np.broadcast_to(threshold, LENGTHS + 1)
    for m in _RUN.finditer(text):
        if run_score(m[0], ratios) >= limits[min(len(m[0]), LENGTHS)] and not covered.overlaps(m):
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def find_secrets(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the number of base spans of each kind, a digest of the base spans and all spans.

    Places are code points, ends exclusive. A null text is an empty one: no spans. Repeated rows give
    repeated results; other columns are ignored. Without any secret to learn from, the model of random
    strings is that of the whole alphabet.
    """
    table = log_ratios(*transition_counts(documents))
    limits = thresholds(score_counts(documents, table), threshold)
    ratios = documents.sparkSession.sparkContext.broadcast(table)
    counts = [T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS[:3]]
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema["doc_id"].dataType),
            *counts,
            T.StructField("base_sha256", T.StringType()),
            T.StructField("spans", T.StringType()),
        ]
    )
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                bytes_ = wordhash.text_bytes(piece.column(1))
                starts, lengths, scores = _run_scores(bytes_, ratios.value)
                # sums are taken in another order here: what may reach the threshold is scored again
                random = starts[scores >= limits[np.minimum(lengths, LENGTHS)] - 1e-3]
                base, scored = _need_base(bytes_), _texts_at(bytes_, random)
                found: list[list[Span]] = [[] for _ in base]
                values = piece.column(1)
                for i in np.flatnonzero(base | scored).tolist():
                    found[i] = scan(values[i].as_py(), ratios.value, limits)
                own = [[s for s in spans if s[1] < 3] for spans in found]
                columns = [piece.column(0)]
                for kind in range(3):
                    columns.append(pa.array([sum(s[1] == kind for s in spans) for spans in own], pa.int64()))
                digests = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in own]
                columns += [pa.array(digests, pa.string()), pa.array([joined(s) for s in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return map_batches(documents.select("doc_id", F.col("text").cast("string").alias("text")), run, schema)
