"""Language identification with hyperdimensional letter profiles.

Every letter has a random vector of ``DIMENSIONS`` entries +1 or -1, made from its code point. A trigram's
vector binds (multiplies) the vectors of its letters, the first rotated by two places and the second
by one; a text's vector bundles (adds) those of its trigrams, and a language's prototype those
of all texts it is learned from. A text gets the language whose prototype has the largest cosine with it.

Trigrams are counted first, so a text's vector is one row of a matrix product. Prototypes are sums over
tasks, added up by Spark; only they, one vector a language, come to the driver and go out again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossbasket.llm.batches import arrow_schema, map_batches, pieces, texts

DIMENSIONS = 1024
UNDETERMINED = "und"
_POINTS = 0x110000
_ROWS_AT_ONCE = 256
_GRAMS_AT_ONCE = 2048  # trigrams whose vectors stand in memory together
_LETTERS_AT_ONCE = 32_768


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(_POINTS, bool)
    table[[c for c in range(_POINTS) if chr(c).isalpha()]] = True
    return table


@lru_cache(maxsize=65_536)
def letter_vector(point: int, dimensions: int) -> np.ndarray:
    """The vector of a code point; 0 is the edge of a word."""
    return np.random.default_rng([7, point]).integers(0, 2, dimensions).astype(np.int8) * np.int8(2) - np.int8(1)


def _letter_runs(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, an edge for each run of other characters, and text starts."""
    lowered = [text.lower() for text in values]
    points = np.frombuffer("".join(f"\x00{text}\x00" for text in lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(values)), [len(text) + 2 for text in lowered])
    kept = np.where(_letters()[points], points, 0).astype(np.int64)
    first = np.ones(len(kept), bool)
    first[1:] = (kept[1:] != 0) | (kept[:-1] != 0) | (owner[1:] != owner[:-1])
    return kept[first], np.searchsorted(owner[first], np.arange(len(values) + 1))


def trigram_counts(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (rows of three code points) of some texts and their counts, a row a text."""
    points, starts = _letter_runs(values)
    alphabet, symbols = np.unique(points, return_inverse=True)
    size = len(alphabet)
    if len(points) < 3:
        return np.empty((0, 3), np.int64), np.zeros((len(values), 0), np.float32)
    owner = np.repeat(np.arange(len(values)), np.diff(starts))
    codes = (symbols[:-2] * size + symbols[1:-1]) * size + symbols[2:]
    inside = (owner[:-2] == owner[2:]) & (points[1:-1] != 0)
    codes, owner = codes[inside], owner[:-2][inside]
    if size**3 <= 1 << 22:
        met = np.bincount(codes, minlength=size**3) > 0
        distinct = np.flatnonzero(met)
        place = np.cumsum(met) - 1
        columns = place[codes]
    else:
        distinct, columns = np.unique(codes, return_inverse=True)
    table = np.bincount(owner * len(distinct) + columns, minlength=len(values) * len(distinct))
    grams = np.stack([alphabet[distinct // size**2], alphabet[distinct // size % size], alphabet[distinct % size]], 1)
    return grams, table.reshape(len(values), len(distinct)).astype(np.float32)


def trigram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    alphabet, at = np.unique(grams, return_inverse=True)
    return _bound(*_rotated(alphabet, dimensions), at.reshape(grams.shape))


def _rotated(alphabet: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors as they stand in the first, second and third place of a trigram."""
    vectors = [letter_vector(int(p), dimensions) for p in alphabet]
    table = np.stack(vectors) if vectors else np.empty((0, dimensions), np.int8)
    return np.roll(table, 2, 1), np.roll(table, 1, 1), table


def _bound(first: np.ndarray, second: np.ndarray, third: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (first[at[:, 0]] * second[at[:, 1]] * third[at[:, 2]]).astype(np.float32)


def _bundled(counts: np.ndarray, grams: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of ``grams`` summed as often as each row of ``counts`` says, a block of trigrams at a time."""
    total = np.zeros((len(counts), dimensions), counts.dtype)
    alphabet, at = np.unique(grams, return_inverse=True)
    at = at.reshape(grams.shape)
    together = len(alphabet) <= _LETTERS_AT_ONCE
    letters = _rotated(alphabet, dimensions) if together else ()
    for i in range(0, len(grams), _GRAMS_AT_ONCE):
        own = slice(i, i + _GRAMS_AT_ONCE)
        vectors = _bound(*letters, at[own]) if together else trigram_vectors(grams[own], dimensions)
        total += counts[:, own] @ vectors
    return total


def bundles(values: list[str], dimensions: int) -> np.ndarray:
    """A vector for each text, zero where it has no letter."""
    out = np.zeros((len(values), dimensions), np.float32)
    for i in range(0, len(values), _ROWS_AT_ONCE):
        grams, counts = trigram_counts(values[i : i + _ROWS_AT_ONCE])
        if len(grams):
            out[i : i + _ROWS_AT_ONCE] = _bundled(counts, grams, dimensions)
    return out


def prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The bundle of each language in the column ``lang`` of ``labelled``, from all its texts."""
    schema = T.StructType(
        [
            T.StructField("lang", T.StringType()),
            T.StructField("place", T.IntegerType()),
            T.StructField("total", T.DoubleType()),
        ]
    )
    out = arrow_schema(schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch):
                langs = np.array(piece.column(1).to_pylist(), object)
                values = np.array(texts(piece.column(0)), object)
                for lang in set(langs.tolist()):
                    own = values[langs == lang].tolist()
                    total = sums.setdefault(lang, np.zeros(dimensions))
                    for i in range(0, len(own), _ROWS_AT_ONCE):
                        grams, counts = trigram_counts(own[i : i + _ROWS_AT_ONCE])
                        if len(grams):
                            total += _bundled(counts.sum(0, dtype=np.float64)[None, :], grams, dimensions)[0]
        for lang, total in sums.items():
            columns = [[lang] * dimensions, np.arange(dimensions), total]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    rows = labelled.filter(F.col("lang").isNotNull()).select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    summed = map_batches(rows, add, schema).groupBy("lang", "place").agg(F.sum("total").alias("total"))
    found = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("sums")).collect()
    return {row["lang"]: np.array([x["total"] for x in row["sums"]]) for row in found}


def identify(documents: DataFrame, learned: dict[str, np.ndarray], carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` with ``lang_pred`` and ``score``, the cosine with that language's prototype."""
    names = sorted(name for name in learned if np.any(learned[name]))
    matrix = np.array([learned[name] / np.linalg.norm(learned[name]) for name in names])
    dimensions = len(next(iter(learned.values()))) if learned else DIMENSIONS
    shared = documents.sparkSession.sparkContext.broadcast((names, matrix.astype(np.float32)))
    schema = T.StructType(
        [
            *[documents.schema[name] for name in carry],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            for piece in pieces(batch, "_text"):
                vectors = bundles(texts(piece.column(piece.num_columns - 1)), dimensions)
                size = np.linalg.norm(vectors, axis=1)
                known = size > 0
                pred, score = np.full(len(vectors), UNDETERMINED, object), np.zeros(len(vectors))
                if names and known.any():
                    cosine = (vectors[known] @ matrix.T) / size[known, None]
                    best = cosine.argmax(1)
                    pred[known] = np.array(names, object)[best]
                    score[known] = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                columns = [pa.array(pred.tolist(), pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(carry)], *columns], schema=out)

    columns = [F.col(f"`{name}`") for name in carry]
    return map_batches(documents.select(*columns, F.col("text").cast("string").alias("_text")), run, schema)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text modulo ``divisor``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def report(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of each row.

    Learns from rows whose crc32 remainder by 4 is not 2 and whose language is not null. A text
    that is null, empty or without a letter is ``und`` with score 0, and so is every text if nothing
    was learned. Repeated rows give repeated results; other columns are ignored.
    """
    held_out = remainder(F.col("doc_id"), 4) == 2
    learned = prototypes(documents.filter(~held_out))
    found = identify(documents, learned)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
