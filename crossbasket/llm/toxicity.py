"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are the density of lexicon terms, how strong the strongest are, how many stand near a
second-person pronoun, and the rates of capitals, exclamation and question marks, stretched
words and obfuscated words (signs or digits inside a word, read back as letters before the
lexicon is asked). The lexicon is learned: words and word beginnings that labelled toxic texts hold more
often, weighted by log odds. Trees are grown on quantile bins of the features; the calibration is fitted
on rows the trees have not seen.

The lexicon's terms are counted by Spark over all labelled texts. Trees and calibration are fitted on a
sample bounded by ``FIT_ROWS``, taken of each label by a hash of the id and weighted by what it stands
for, so that few toxic texts are not lost in it. Only the lexicon, at most ``LEXICON`` terms, and the
feature rows of the sample come to the driver. Every text is scored whole, in one scan.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossbasket.llm import wordhash
from crossbasket.llm.batches import arrow_schema, map_batches, pieces, texts
from crossbasket.llm.languages import remainder
from crossbasket.llm.shared import broadcast_if, written

FIT_ROWS = 30_000
BROADCAST_LABELS = 200_000
MIN_TOXIC_SHARE = 0.001  # of the toxic texts, that hold a term of the lexicon
MIN_TOXIC_TEXTS = 3  # so that no single text makes a term
MIN_ODDS = 3.0  # of a term's rate in toxic texts to that in others, as a logarithm
PREFIXES = (4, 5, 6)
NEAR = 5
TREES = 80
DEPTH = 3
BINS = 32
RATE = 0.15
TOXIC_SCORE = 0.7
_CACHE = 400_000

# fixed values: second-person words in English, French, German and Spanish
SECOND_PERSON = frozenset(
    "you your yours yourself ya u ur tu te toi ton ta tes vous votre vos du dich dir dein deine "
    "ihr euch euer tú ti tuyo tus usted ustedes vosotros".split()
)
# fixed values: signs that stand for letters in obfuscated words
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")

_STRETCHED = re.compile(r"(.)\1{2,}")

FEATURES = (
    "lexicon_density", "lexicon_weight", "strongest", "second_strongest", "hits", "near_second_person",
    "second_person", "capitals", "shouted_words", "exclamations", "questions", "stretched", "obfuscated",
    "obfuscated_hits", "log_words",
)


class Token(NamedTuple):
    weight: float
    second_person: bool
    stretched: bool
    obfuscated: bool
    obfuscated_hit: bool

    @property
    def plain(self) -> bool:
        return not (self.weight or self.second_person or self.stretched or self.obfuscated)


def _core(word: str) -> str:
    """A word without signs around it."""
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end]


def terms(core: str) -> list[str]:
    return [core, *(core[:n] + "*" for n in PREFIXES if len(core) > n)]


def _unmasked(core: str) -> str:
    letters = core.translate(LOOKALIKES)
    return "".join(c for c in letters if c.isalpha())


def _squeezed(core: str) -> str:
    """Letters written three times or more in a row, written once."""
    return _STRETCHED.sub(r"\1", core)


class Lexicon:
    """Looks tokens up; what is known about a token is kept, for at most ``_CACHE`` tokens."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.kinds: list[Token] = [Token(0.0, False, False, False, False)]
        self.numbers = {self.kinds[0]: 0}
        self.known: dict[str, int] = {}

    def _weight(self, core: str) -> float:
        return max((self.weights.get(term, 0.0) for term in terms(core)), default=0.0)

    def _read(self, token: str) -> Token:
        core = _core(token)
        squeezed = _squeezed(core)
        stretched = squeezed != core
        weight = max(self._weight(core), self._weight(squeezed) if stretched else 0.0)
        mixed = any(c.isalpha() for c in core) and not core.isalpha()
        obfuscated = mixed and any(not (c.isalpha() or c in "-'’.,_/:") for c in core[1:-1])
        hit = False
        if mixed and not weight:
            weight = self._weight(_unmasked(core))
            hit = weight > 0
        return Token(weight, core in SECOND_PERSON, stretched and core.isalpha(), obfuscated, hit)

    def numbers_of(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > _CACHE:
            self.known = {}
        known = self.known
        for token in {t for t in tokens if t not in known}:
            kind = self._read(token)
            number = 0 if kind.plain else self.numbers.setdefault(kind, len(self.kinds))
            if number == len(self.kinds):
                self.kinds.append(kind)
            known[token] = number
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def features(self, text: str) -> tuple[float, ...]:
        """The features that depend on words; capitals and marks are counted apart."""
        tokens = text.lower().split()
        n = max(1, len(tokens))
        numbers = self.numbers_of(tokens)
        at = np.flatnonzero(numbers)
        kinds = [self.kinds[i] for i in numbers[at].tolist()]
        person = at[[k.second_person for k in kinds]] if len(at) else at
        hit_at = at[[k.weight > 0 for k in kinds]] if len(at) else at
        weights = sorted((k.weight for k in kinds if k.weight > 0), reverse=True)
        near = 0
        if len(person) and len(hit_at):
            right = np.searchsorted(person, hit_at)
            after = np.abs(person[np.minimum(right, len(person) - 1)] - hit_at)
            before = np.abs(person[np.maximum(right - 1, 0)] - hit_at)
            near = int((np.minimum(after, before) <= NEAR).sum())
        return (
            len(hit_at) / n,
            sum(weights) / n,
            weights[0] if weights else 0.0,
            weights[1] if len(weights) > 1 else 0.0,
            math.log1p(len(hit_at)),
            near / n,
            len(person) / n,
            sum(k.stretched for k in kinds) / n,
            sum(k.obfuscated for k in kinds) / n,
            math.log1p(sum(k.obfuscated_hit for k in kinds)),
            math.log1p(len(tokens)),
        )


_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = True


def feature_rows(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    bytes_ = wordhash.text_bytes(column)
    data, offsets = bytes_

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums

    upper, lower = count(_UPPER[data]), count(_LOWER[data])
    marks = [count(data == ord(c)) for c in "!?"]
    starts, ends = wordhash.split(bytes_)
    shouted = (upper[ends] - upper[starts] >= 3) & (lower[ends] == lower[starts])
    first = np.searchsorted(starts, offsets)
    shouts = np.diff(count(shouted)[first]) / np.maximum(1, np.diff(first))
    size = np.maximum(1, np.diff(offsets))
    letters = np.maximum(1, np.diff((upper + lower)[offsets]))
    words = np.array([lexicon.features(text) for text in texts(column)]).reshape(len(column), 11)
    bytewise = np.stack([np.diff(upper[offsets]) / letters, shouts, *[np.diff(m[offsets]) / size for m in marks]], 1)
    return np.hstack([words[:, :7], bytewise, words[:, 7:]])


class Trees(NamedTuple):
    edges: np.ndarray  # of the bins, a row for each feature
    features: np.ndarray  # of each inner node, a row for each tree
    bins: np.ndarray  # a row goes right if its bin is above this one
    leaves: np.ndarray
    start: float


def _bins(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[j], rows[:, j], side="left") for j in range(rows.shape[1])], 1)


def raw_scores(trees: Trees, rows: np.ndarray) -> np.ndarray:
    binned = _bins(rows, trees.edges)
    out = np.full(len(rows), trees.start)
    at_row = np.arange(len(rows))
    for features, bins, leaves in zip(trees.features, trees.bins, trees.leaves):
        node = np.zeros(len(rows), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (binned[at_row, features[node]] > bins[node])
        out += leaves[node - (2**DEPTH - 1)]
    return out


def grow(
    rows: np.ndarray, labels: np.ndarray, trees: int = TREES, rate: float = RATE, weights: np.ndarray | None = None
) -> Trees:
    """Trees of fixed depth that lower the logistic loss, each by the best split of a node's bins."""
    weights = np.ones(len(rows)) if weights is None else weights
    width = rows.shape[1]
    edges = np.stack([np.quantile(rows[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(width)])
    binned = _bins(rows, edges)
    share = min(max(np.average(labels, weights=weights), 1e-4), 1 - 1e-4)
    start = math.log(share / (1 - share))
    score = np.full(len(rows), start)
    inner = 2**DEPTH - 1
    all_features, all_bins, all_leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = weights * (labels - p), weights * p * (1 - p)
        node = np.zeros(len(rows), np.int64)
        features, bins = np.zeros(inner, np.int64), np.full(inner, BINS)
        for level in range(DEPTH):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            for j in range(width):
                cell = (node - first) * BINS + binned[:, j]
                g = np.bincount(cell, gradient, n * BINS).reshape(n, BINS).cumsum(1)
                h = np.bincount(cell, hessian, n * BINS).reshape(n, BINS).cumsum(1)
                right_g, right_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + 1) + right_g**2 / (right_h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                top = gain.argmax(1)
                better = gain[np.arange(n), top] > best
                best[better] = gain[np.arange(n), top][better]
                features[first : first + n][better] = j
                bins[first : first + n][better] = top[better]
            node = 2 * node + 1 + (binned[np.arange(len(rows)), features[node]] > bins[node])
        leaf = node - inner
        leaves = rate * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, hessian, inner + 1) + 1)
        score += leaves[leaf]
        all_features.append(features)
        all_bins.append(bins)
        all_leaves.append(leaves)
    return Trees(edges, np.array(all_features), np.array(all_bins), np.array(all_leaves), start)


def isotonic(
    scores: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function closest to the labels, by pooling neighbours that violate it."""
    weights = np.ones(len(scores)) if weights is None else weights
    order = np.argsort(scores, kind="stable")
    values, at = np.unique(scores[order], return_inverse=True)
    pools: list[list[float]] = []  # sum of labels, weight of rows, last value
    for value, total, n in zip(values, np.bincount(at, (weights * labels)[order]), np.bincount(at, weights[order])):
        pools.append([total, n, value])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, n, value = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + n, value]
    return np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])


class Classifier(NamedTuple):
    weights: dict[str, float]
    trees: Trees | None
    upto: np.ndarray  # raw scores up to these ...
    level: np.ndarray  # ... mean this

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(rows):
            return np.zeros(len(rows))
        at = np.searchsorted(self.upto, raw_scores(self.trees, rows), side="left")
        return np.clip(self.level[np.minimum(at, len(self.level) - 1)], 0, 1)


def _labelled(labels: DataFrame) -> tuple[DataFrame, int, int]:
    """One row, ``doc_id`` and ``toxic``, for each labelled id, and how many are toxic and clean.

    Written, so that its grouping is not reused by a join, which then can split the rows of a hot id.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    one = written(one, "labels")
    row = one.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    return one, row["t"], row["n"] - row["t"]


def _rates(toxic: int, clean: int, rows: int) -> tuple[float, float]:
    """The shares of clean and of toxic ones to take for about ``rows``: all if there are fewer, else half
    of each label, and more of one where the other has less."""
    some = min(toxic, max(rows // 2, rows - clean))
    return min(1.0, (rows - some) / max(1, clean)), some / max(1, toxic)


def _term_counts(labelled: DataFrame) -> DataFrame:
    """``term``, ``toxic`` and ``clean``: how many texts of each label hold it."""
    schema = T.StructType(
        [T.StructField("term", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())]
    )
    out = arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found: tuple[dict[str, int], dict[str, int]] = ({}, {})
                for text, toxic in zip(texts(piece.column(0)), piece.column(1).to_pylist()):
                    cores = {_core(token) for token in set(text.lower().split())}
                    own = found[0 if toxic else 1]
                    for term in {t for core in cores if core for t in terms(core)}:
                        own[term] = own.get(term, 0) + 1
                names = list(found[0].keys() | found[1].keys())
                columns = [names, [found[0].get(t, 0) for t in names], [found[1].get(t, 0) for t in names]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return map_batches(labelled.select("text", "toxic"), count, schema).groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """The terms of high log odds for toxic texts. ``labelled``: ``text``, ``toxic``.

    A term has to be in a fixed share of the toxic texts, so there are at most so many times as a text has terms on
    average as that share goes into one, however many texts there are.
    """
    totals = labelled.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals["t"], totals["n"] - totals["t"]
    if not toxic or not clean:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    least = max(MIN_TOXIC_TEXTS, math.ceil(MIN_TOXIC_SHARE * toxic))
    scored = _term_counts(labelled).filter(F.col("toxic") >= least).withColumn("odds", odds)
    return {row["term"]: float(row["odds"]) for row in scored.filter(F.col("odds") >= MIN_ODDS).orderBy("term").collect()}


def learn(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Classifier:
    """A classifier from the rows of ``labels`` (``doc_id``, ``toxic``) that ``documents`` has a text for."""
    labelled, toxic, clean = _labelled(labels)
    labelled = broadcast_if(labelled, toxic + clean, BROADCAST_LABELS)
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(labelled, "doc_id")
    weights = learn_lexicon(rows.select("text", "toxic"))
    # a row for each id and text: repeated rows are sampled, and brought to the driver, once
    rows = rows.withColumn("print", F.xxhash64("text"))
    sizes = rows.select("doc_id", "print", "toxic").distinct().groupBy("toxic").count().collect()
    sizes = {row["toxic"]: row["count"] for row in sizes}
    rates = _rates(sizes.get(1, 0), sum(sizes.values()) - sizes.get(1, 0), fit_rows)
    unit = (F.xxhash64(F.lit(11), "doc_id", "print").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    rows = rows.filter(unit < F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0]))
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("print", T.LongType()),
            T.StructField("toxic", T.IntegerType()), T.StructField("row", T.ArrayType(T.DoubleType())),
        ]
    )
    out = arrow_schema(schema)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch in batches:
            for piece in pieces(batch):
                table = feature_rows(piece.column(0), lexicon)
                columns = [*piece.columns[1:], pa.array(table.tolist(), out.field("row").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    made = map_batches(rows.select("text", "doc_id", "print", "toxic"), features, schema).dropDuplicates(["doc_id", "print"])
    part = F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(4)).cast("int")
    found = made.select(part.alias("part"), "toxic", "row").orderBy("doc_id", "print").toPandas()
    if found["toxic"].nunique() < 2:
        return Classifier(weights, None, np.empty(0), np.empty(0))
    table, label = np.array(found["row"].tolist()), found["toxic"].to_numpy(np.float64)
    held = found["part"].to_numpy() == 3
    if not 0 < label[held].sum() < held.sum() or len(set(label[~held].tolist())) < 2:
        held = np.zeros(len(label), bool)  # too few rows to set some aside
    stands_for = np.where(label == 1, 1 / rates[1], 1 / rates[0])
    stands_for /= stands_for.mean()
    trees = grow(table[~held], label[~held], weights=stands_for[~held])
    side = held if held.any() else ~held
    return Classifier(weights, trees, *isotonic(raw_scores(trees, table[side]), label[side], stands_for[side]))


def score(documents: DataFrame, classifier: Classifier, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` with ``score`` and ``predicted``."""
    shared = documents.sparkSession.sparkContext.broadcast(classifier)
    schema = T.StructType(
        [
            *[documents.schema[name] for name in carry],
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
        ]
    )
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value.weights)
        for batch in batches:
            for piece in pieces(batch, "_text"):
                values = shared.value.scores(feature_rows(piece.column(len(carry)), lexicon))
                columns = [pa.array(values, pa.float64()), pa.array((values >= TOXIC_SCORE).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(carry)], *columns], schema=out)

    columns = [F.col(f"`{name}`") for name in carry]
    return map_batches(documents.select(*columns, F.col("text").cast("string").alias("_text")), run, schema)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row.

    Learns from labels of ids whose crc32 remainder by 3 is not 1; an id labelled twice counts as toxic
    if one label says so. Null and empty texts are scored as texts without words. Without labels of
    both kinds every score is 0. Repeated rows give repeated results; other columns are ignored.
    """
    held_out = remainder(F.col("doc_id"), 3) == 1
    classifier = learn(documents, labels.select("doc_id", "toxic").filter(~held_out))
    return score(documents, classifier).select("doc_id", held_out.alias("held_out"), "score", "predicted")
