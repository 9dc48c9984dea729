"""Quality rules: counts of each text, and the perplexity of its characters.

The model of a language is a modified Kneser-Ney trigram model of its code points, none of them folded, so it
grows with the corpus and tells letters of every script apart. Spark counts the trigrams of all texts;
discounts, continuation counts and the interpolation with shorter n-grams are aggregates and joins over the
distinct trigrams. A language's model is kept as arrays sorted by hash (a bijection of three code points, so
nothing collides) with the log probabilities of its trigrams. There is one for every language, however
many there are. The arrays are broadcast in shards of at most ``SHARD_ENTRIES`` trigrams; where there are more, the
texts are read once for each shard, and what the shards say of a window is added up.

A text is judged by its windows of about ``WINDOW_POINTS`` code points: by its median one, so that a passage in
another language, an address or a licence line does not condemn a clean text, and by its lower quartile, so that
one of which more than a quarter is junk does not pass. The bands of a language come from the distinct texts
that pass the base rules, so neither copies nor a source of failing texts move them: ``SPREAD`` (for the lower
quartile ``LOW_SPREAD``, downwards only) interquartile ranges around the median, and ``NOISE`` over the root of a
text's length further out, as short texts vary more; texts above or below are rejected.

Texts are not shuffled, but for the few columns a verdict needs; trigram counts are summed in tasks first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossbasket.llm import wordhash
from crossbasket.llm.batches import arrow_schema, map_batches, pieces
from crossbasket.llm.shared import broadcast_if, written

WINDOW_POINTS = 100
SPREAD = 1.0
LOW_SPREAD = 2.0
NOISE = 2.0
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
REPEAT_WIDTH = 5
SHARD_ENTRIES = 1 << 21
UNSEEN = -20.0  # the log probability of a trigram that the model does not hold
_NO_LANGUAGE = ""  # texts without a language
_BROADCAST_ROWS = 200_000
_HELD = 1 << 20  # different trigrams a task holds before it passes them on
_BITS = 21  # of a symbol: a code point plus one, or 0 for white space and the edge of a text
_TABLE = 1 << 22  # cells of a table of trigrams of a piece's own symbols; with more symbols they are sorted
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#*$%&|<>")] = True
_SPACES = wordhash._SPACE
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_WHITE = np.zeros(0x3002, bool)
_WHITE[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x2028, 0x2029, 0x3000]] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _doubled(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries equal another one, and which an earlier one, of the same owner."""
    keys = wordhash.mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    any_, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    earlier[order[1:]] = same
    return any_, earlier


class Counts(NamedTuple):
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def text_counts(text: wordhash.Text) -> Counts:
    data, offsets = text
    n = len(offsets) - 1
    found = wordhash.words(text)
    n_words = np.diff(found.first)
    points = (data & 0xC0) != 0x80
    word_chars = _per_text(points & ~_SPACES[data], offsets)
    n_symbols = _per_text(_MARKS[data], offsets)

    starts, ends = wordhash.split(text, _NEWLINE)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_SPACES[data], out=filled[1:])
    has_word = filled[ends] > filled[starts]
    starts, ends = starts[has_word], ends[has_word]
    owner = np.searchsorted(offsets[1:], starts, side="right")
    _, earlier = _doubled(wordhash.spans_hash(data, starts, ends), owner)
    n_dup_lines = np.bincount(owner[earlier], minlength=n)

    grams, at = wordhash.sequences(found, REPEAT_WIDTH)
    owner = np.searchsorted(found.first[1:], at, side="right")
    twice, _ = _doubled(grams, owner)
    covered = np.zeros(len(found.hashes) + 1, np.int64)
    if twice.any():
        hits = at[twice]
        size = len(covered)
        covered = np.cumsum(np.bincount(hits, minlength=size) - np.bincount(hits + REPEAT_WIDTH, minlength=size)[:size])
    n_repeat = _per_text(covered[:-1] > 0, found.first)
    return Counts(n_words, word_chars, n_symbols, n_dup_lines, n_repeat)


class Trigrams(NamedTuple):
    """All trigrams of some texts, one a code point and one for the end of each text."""

    codes: np.ndarray  # of the numbers of the three symbols in ``symbols``
    symbols: np.ndarray
    starts: np.ndarray  # where each text's begin

    def distinct(self, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different trigrams, spelled, which of them each one is, and their counts."""
        codes, size = self.codes[rows], len(self.symbols)
        if size**3 <= _TABLE:
            counts = np.bincount(codes, minlength=size**3)
            met = np.flatnonzero(counts)
            place = np.zeros(size**3, np.int64)
            place[met] = np.arange(len(met))
            which, counts = place[codes], counts[met]
        else:
            met, which, counts = np.unique(codes, return_inverse=True, return_counts=True)
        spelled = self.symbols[met // size**2] << 2 * _BITS | self.symbols[met // size % size] << _BITS
        return spelled | self.symbols[met % size], which, counts


def trigrams(text: wordhash.Text) -> Trigrams:
    data, offsets = text
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.int64)
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    starts = starts[offsets]
    # two edges stand before each text; the first of the next text's is the end of this one
    n = len(offsets) - 1
    symbols = np.zeros(len(points) + 2 * n + 1, np.int64)
    owner = np.repeat(np.arange(n), np.diff(starts))
    symbols[np.arange(len(points)) + 2 * owner + 2] = np.where(_WHITE[np.minimum(points, 0x3001)], 0, points + 1)
    met = np.zeros(0x110001, bool)
    met[symbols] = True
    number = (np.cumsum(met) - 1)[symbols]
    size = int(met.sum())
    codes = (number[:-2] * size + number[1:-1]) * size + number[2:]
    # the trigram over both edges belongs to no text
    keep = np.ones(len(codes), bool)
    first = starts[:-1] + 2 * np.arange(n)
    keep[first[1:] - 1] = False
    return Trigrams(codes[keep], np.flatnonzero(met), starts + np.arange(n + 1))


def gram_hash(spelled: np.ndarray) -> np.ndarray:
    return wordhash.mix(spelled.astype(np.uint64)).view(np.int64)


def _texts_columns() -> list[Column]:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(_NO_LANGUAGE)).alias("lang")
    return [F.col("text").cast("string").alias("text"), lang]


def trigram_counts(documents: DataFrame) -> DataFrame:
    """``lang``, ``gram`` (three symbols in one number) and ``n`` over all texts."""
    schema = T.StructType(
        [T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())]
    )
    out = arrow_schema(schema)

    def rows(lang: str, grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(grams), np.int64)))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(grams, pa.int64()), pa.array(counts, pa.int64())], schema=out)

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, which = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(which, np.concatenate([n for _, n in parts])).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches:
            for piece in pieces(batch):
                found = trigrams(wordhash.text_bytes(piece.column(0)))
                for lang, own in _by_language(piece.column(1), found.starts):
                    grams, _, counts = found.distinct(own)
                    held.setdefault(lang, []).append((grams, counts))
                    size += len(grams)
                if size > 2 * _HELD:
                    held = {lang: [merged(parts)] for lang, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                if size > _HELD:
                    yield from (rows(lang, *merged(parts)) for lang, parts in held.items())
                    held, size = {}, 0
        yield from (rows(lang, *merged(parts)) for lang, parts in held.items())

    return map_batches(documents.select(*_texts_columns()), count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _by_language(column: pa.Array, starts: np.ndarray) -> Iterator[tuple[str, np.ndarray | slice]]:
    """The languages of a piece's texts and which trigrams are theirs."""
    coded = column.dictionary_encode()
    names, number = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    if len(names) == 1:
        yield names[0], slice(None)
        return
    owner = np.repeat(number, np.diff(starts))
    for i, name in enumerate(names):
        yield name, np.flatnonzero(owner == i)


def _discounts(grams: DataFrame) -> DataFrame:
    """``lang`` and the modified Kneser-Ney discounts ``d`` for counts 1, 2 and above."""
    n = [F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in range(1, 5)]
    counted = grams.groupBy("lang").agg(*n)
    few = F.least("n1", "n2", "n3", "n4") == 0  # too few to estimate from
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = []
    for i in (1, 2, 3):
        estimate = i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        d.append(F.when(few, 0.5).otherwise(F.least(F.greatest(estimate, F.lit(0.05)), F.lit(i - 0.05))))
    return counted.select("lang", F.array(*d).alias("d"))


def _interpolated(grams: DataFrame, context: Column, ending: Column, lower: DataFrame) -> DataFrame:
    """``lang``, ``gram`` and probability ``p``, given that of their endings (``lang``, ``ending``, ``p_lower``)."""
    cut = F.col("d")[F.least(F.col("n"), F.lit(3)).cast("int") - 1]
    placed = grams.join(_discounts(grams), "lang").select(
        "lang", "gram", "n", cut.alias("cut"), context.alias("context"), ending.alias("ending")
    )
    contexts = placed.groupBy("lang", "context").agg(
        F.sum("n").cast("double").alias("total"), F.sum("cut").alias("taken")
    )
    joined = placed.join(contexts, ["lang", "context"]).join(lower, ["lang", "ending"])
    p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("taken") / F.col("total") * F.col("p_lower")
    return joined.select("lang", "gram", p.alias("p"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``lang``, ``gram`` and its interpolated probability ``p`` after its first two symbols, from
    ``counts`` (``lang``, ``gram``, ``n``; written)."""

    def last(symbols: int) -> Column:
        return F.col("gram").bitwiseAND(F.lit((1 << symbols * _BITS) - 1))

    def first() -> Column:
        return F.shiftright("gram", _BITS)

    def continued(grams: DataFrame, symbols: int) -> DataFrame:
        # how many different symbols stand before it
        return grams.groupBy("lang", last(symbols).alias("gram")).agg(F.count(F.lit(1)).alias("n"))

    pairs = continued(counts, 2)
    singles = continued(pairs, 1)
    uniform = singles.groupBy("lang").agg((1 / F.count(F.lit(1))).alias("p_lower")).withColumn("ending", F.lit(0))
    nothing = F.lit(0)
    p = _interpolated(singles, nothing, nothing, uniform)
    for grams, symbols in ((pairs, 1), (counts, 2)):
        lower = p.select("lang", F.col("gram").alias("ending"), F.col("p").alias("p_lower"))
        p = _interpolated(grams, first(), last(symbols), lower)
    return p


Model = dict[str, tuple[np.ndarray, np.ndarray]]


def language_models(documents: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``p`` of all trigrams of every language, written."""
    counts = written(trigram_counts(documents), "trigrams")
    return written(kneser_ney(counts), "models")


def _arrays(rows: DataFrame) -> Model:
    """Models as arrays: hashes, sorted, and log probabilities."""
    table = rows.select("lang", "gram", "p").toArrow().combine_chunks()
    if not len(table):
        return {}
    coded = table.column("lang").combine_chunks().dictionary_encode()
    number = coded.indices.to_numpy()
    hashes, log_p = gram_hash(table.column("gram").to_numpy()), np.log(table.column("p").to_numpy()).astype(np.float32)
    out = {}
    for i, lang in enumerate(coded.dictionary.to_pylist()):
        own = np.flatnonzero(number == i)
        own = own[np.argsort(hashes[own])]
        out[lang] = hashes[own], log_p[own]
    return out


def log_probabilities(model: tuple[np.ndarray, np.ndarray], spelled: np.ndarray, shards: int = 1, shard: int = 0) -> np.ndarray:
    """Of trigrams; 0 for those of other shards."""
    hashes, log_p = model
    out = np.where(spelled % shards == shard, UNSEEN, 0.0)
    if len(hashes):
        wanted = gram_hash(spelled)
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        known = hashes[at] == wanted
        out[known] = log_p[at[known]]
    return out


def windows(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose trigrams begin at ``starts``: first and end of their windows, about equal, and windows by text."""
    sizes = np.diff(starts)
    n = np.maximum(1, sizes // WINDOW_POINTS)
    owner = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    low = starts[owner] + sizes[owner] * rank // n[owner]
    high = starts[owner] + sizes[owner] * (rank + 1) // n[owner]
    return low, high, n


def window_quantiles(means: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The median and the lower quartile of each text's windows."""
    first = np.cumsum(n) - n
    means = means[np.lexsort((means, np.repeat(np.arange(len(n)), n)))]
    return (means[first + (n - 1) // 2] + means[first + n // 2]) / 2, means[first + n // 4]


_RESULT = [
    ("n_words", T.LongType(), pa.int64()),
    ("word_chars", T.LongType(), pa.int64()),
    ("n_symbols", T.LongType(), pa.int64()),
    ("n_dup_lines", T.LongType(), pa.int64()),
    ("n_repeat_words", T.LongType(), pa.int64()),
    ("lang", T.StringType(), pa.string()),
    ("n_points", T.LongType(), pa.int64()),
    ("log_p", T.DoubleType(), pa.float64()),
    ("low_log_p", T.DoubleType(), pa.float64()),
]


def measure(
    documents: DataFrame, models: DataFrame, carry: tuple[str, ...] = ("doc_id",), shard_entries: int = SHARD_ENTRIES
) -> DataFrame:
    """A struct ``quality`` of each row's counts and log probabilities, and in the struct ``row`` the columns ``carry``."""
    spark = documents.sparkSession
    shards = max(1, -(-models.count() // shard_entries))
    fields = T.StructType([T.StructField(name, kind) for name, kind, _ in _RESULT])
    names = [f"c{i}" for i in range(len(carry))]
    rows = documents.select(*[F.col(f"`{name}`").alias(new) for name, new in zip(carry, names)], *_texts_columns())
    sums = T.StructField("sums", T.ArrayType(T.DoubleType()))
    carried = T.StructType([*rows.schema.fields, sums])
    judged_ = T.StructType([*rows.schema.fields[: len(carry)], T.StructField("quality", fields)])
    for shard in range(shards):
        own = models if shards == 1 else models.filter(F.pmod("gram", F.lit(shards)) == shard)
        known = spark.sparkContext.broadcast(_arrays(own))
        last = shard == shards - 1
        schema = judged_ if last else carried
        out = arrow_schema(schema)

        def score(
            batches: Iterator[pa.RecordBatch], shard=shard, known=known, last=last, out=out
        ) -> Iterator[pa.RecordBatch]:
            nothing = np.empty(0, np.int64), np.empty(0, np.float32)
            for batch in batches:
                for piece in pieces(batch, "text"):
                    column, langs = piece.column("text"), piece.column("lang")
                    bytes_ = wordhash.text_bytes(column)
                    found = trigrams(bytes_)
                    log_p = np.zeros(len(found.codes))
                    for lang, rows_ in _by_language(langs, found.starts):
                        grams, which, _ = found.distinct(rows_)
                        log_p[rows_] = log_probabilities(known.value.get(lang, nothing), grams, shards, shard)[which]
                    total = np.concatenate([[0.0], np.cumsum(log_p)])
                    low, high, n = windows(found.starts)
                    sums = total[high] - total[low]
                    if shard:
                        sums += pa.compute.list_flatten(piece.column("sums")).to_numpy(zero_copy_only=False)
                    if last:
                        median, quartile = window_quantiles(sums / (high - low), n)
                        values = [*text_counts(bytes_), langs, np.diff(found.starts), median, quartile]
                        arrays = [v if isinstance(v, pa.Array) else pa.array(v, kind) for v, (_, _, kind) in zip(values, _RESULT)]
                        result = pa.StructArray.from_arrays(arrays, fields=list(out.field("quality").type))
                        yield pa.RecordBatch.from_arrays([*piece.columns[: len(carry)], result], schema=out)
                    else:
                        ends = np.cumsum(n).astype(np.int32)
                        parts = pa.ListArray.from_arrays(np.append(np.int32(0), ends), pa.array(sums))
                        columns = piece.columns if not shard else piece.columns[:-1]
                        yield pa.RecordBatch.from_arrays([*columns, parts.cast(out.field("sums").type)], schema=out)

        rows = map_batches(rows, score, schema)
        if not last:
            rows = written(rows, "windows")
    packed = F.struct(*[F.col(new).alias(name) for name, new in zip(carry, names)]) if carry else F.lit(None)
    return rows.select(packed.alias("row"), "quality")


def _failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED_PERCENT * q["n_words"])


def bands(measured: DataFrame) -> DataFrame:
    """Quartiles by language of the log probabilities of the distinct texts that pass the base rules.

    ``measured`` (written) has the struct ``quality`` and a 64-bit ``print`` of the text.
    """
    q = F.col("quality")
    texts = measured.filter(~_failed(q)).groupBy(q["lang"].alias("_lang"), "print").agg(
        F.min(q["log_p"]).alias("log_p"), F.min(q["low_log_p"]).alias("low")
    )
    at = [0.25, 0.5, 0.75]
    quartiles = [F.percentile_approx(name, at, 10_000).alias(alias) for name, alias in (("log_p", "_q"), ("low", "_low"))]
    return texts.groupBy("_lang").agg(*quartiles)


def judged(measured: DataFrame, limits: DataFrame, spread: float = SPREAD, low_spread: float = LOW_SPREAD, noise: float = NOISE) -> DataFrame:
    """``measured`` with ``base_failed``, ``perplexity`` and ``kept`` in the struct; ``limits`` (written) are its ``bands``.

    Without any text of a language that passes the base rules there is no band, and none of its texts is kept.
    """
    q, quartiles, low = F.col("quality"), F.col("_q"), F.col("_low")
    more = noise / F.sqrt(q["n_points"].cast("double"))
    inside = F.abs(q["log_p"] - quartiles[1]) <= spread * (quartiles[2] - quartiles[0]) + more
    inside = inside & (q["low_log_p"] >= low[1] - low_spread * (low[2] - low[0]) - 2 * more)
    joined = measured.join(broadcast_if(limits, limits.count(), _BROADCAST_ROWS), q["lang"] == F.col("_lang"), "left")
    kept = ~_failed(q) & F.coalesce(inside, F.lit(False))
    with_verdict = q.withField("base_failed", _failed(q)).withField("perplexity", F.exp(-q["log_p"])).withField("kept", kept)
    return joined.select(*[name for name in measured.columns if name != "quality"], with_verdict.alias("quality"))


def _printed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", "lang", F.xxhash64(F.col("text").cast("string")).alias("print"))


def _measured(documents: DataFrame, models: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    rows = measure(_printed(documents), models, (*carry, "print"))
    return written(rows.select(*[F.col(f"row.{name}") for name in (*carry, "print")], "quality"), "quality")


def kept_rows(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the rules keep, with all their columns as they are.

    The bands are taken in a pass of its own, so that texts are never written beside their verdicts.
    """
    models = language_models(documents)
    limits = written(bands(_measured(documents, models, ())), "bands")
    rows = judged(measure(documents, models, tuple(documents.columns)), limits)
    return rows.filter("quality.kept").select("row.*")


def report(documents: DataFrame) -> DataFrame:
    """The counts and the verdict of each row.

    A null text is an empty one: no words, so it fails the base rules. Texts of a null language have a model of
    their own, as those of an empty one. Repeated rows give repeated results; other columns are ignored; an empty
    table gives an empty result.
    """
    measured = _measured(documents, language_models(documents), ("doc_id",))
    result = judged(measured, written(bands(measured), "bands"))
    names = [name for name, _, _ in _RESULT[:5]]
    return result.select("doc_id", *[F.col(f"quality.{n}") for n in [*names, "base_failed", "kept", "perplexity"]])
