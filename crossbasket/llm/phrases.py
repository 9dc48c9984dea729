"""Collocations: frequent phrases of a language whose parts stand together more often than by chance.

Texts are split into pieces at punctuation and line ends, and pieces into words; A-Z are read as a-z.
Everything is counted by language. Words are counted first, and texts rewritten as the numbers of their
frequent words. Then come candidates by length: a phrase can only be frequent if the two phrases
without its last and without its first word are, so only places where both stand are looked at, and what
is there often enough is a candidate. All candidates go into a double-array trie over the digits of the word
numbers, which is broadcast: numpy advances the states of all places of a batch at once, word by word, and
counts the accepting states by ``bincount``; Spark sums the tasks' counts. A phrase is cut where its parts
bind least; it is dropped if a longer candidate around it is as frequent.

What a task or the driver holds is bounded: tries take at most ``SHARD_PHRASES`` phrases and the table of
words ``SHARD_WORDS`` words, and more are dealt to several, each with its own pass over the numbered
texts. Counts are summed in tasks before they are shuffled, and ranks are limited on the map side. Exact
throughout: words and phrases are compared, not hashed; scores are taken in 38-digit decimals.

A null text has no words; a null language is ``und``. Repeated rows count each time. An empty table, or one
without frequent phrases, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossbasket.llm import wordhash
from crossbasket.llm.batches import arrow_schema, map_batches, pieces
from crossbasket.llm.shared import LOWER, UPPER, broadcast_if, written

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
SHARD_WORDS = 1 << 20
SHARD_PHRASES = 1 << 19
_PIECE = 2 << 20
_PACK = 1024  # counts that go together
_PARTS = 256
_BROADCAST_ROWS = 200_000
_HELD = 1 << 20  # different pairs a task holds before it passes them on
_DIGIT = 64
_BLOCK = 8  # a node with so many children has a block of its own
_NO_WORD = -1
_FREE = -1

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


_LOST = 1  # the state of what is in no phrase; it has no children


class Trie(NamedTuple):
    """Transitions from state s by digit d to ``base[s] + d``, if that one's ``check`` is s. The root is 0."""

    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray  # the number of the phrase that ends in a state, or -1
    digits: int

    def advance(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The states a word further on."""
        for shift in range(self.digits - 1, -1, -1):
            after = self.base[states] + (words >> (6 * shift) & (_DIGIT - 1))
            states = np.where(self.check[after] == states, after, _LOST)
        return states


def double_array(phrases: list[np.ndarray], n_words: int) -> Trie:
    """A trie of ``phrases``, matrices of word numbers below ``n_words``, one for each length.

    Nodes with many children get a block each; the others are thrown at places until their children fall on
    free ones, all nodes of a depth at the same time, those with most children first.
    """
    digits = 1
    while _DIGIT**digits < n_words:
        digits += 1
    rng = np.random.default_rng(11)
    base, check = np.zeros(_DIGIT, np.int64), np.full(_DIGIT, _FREE, np.int64)
    numbers = np.cumsum([0] + [len(p) for p in phrases])
    states = [np.zeros(len(p), np.int64) for p in phrases]
    for level in range(max((p.shape[1] for p in phrases if len(p)), default=0)):
        live = [i for i, p in enumerate(phrases) if len(p) and p.shape[1] > level]
        cuts = np.cumsum([len(phrases[i]) for i in live])[:-1]
        for shift in range(digits - 1, -1, -1):
            edges = [states[i] * _DIGIT + (phrases[i][:, level] >> (6 * shift) & (_DIGIT - 1)) for i in live]
            edges, which = np.unique(np.concatenate(edges), return_inverse=True)
            parents, labels = edges // _DIGIT, edges % _DIGIT
            base, check = _place(parents, labels, base, check, rng)
            for i, part in zip(live, np.split((base[parents] + labels)[which], cuts)):
                states[i] = part
    accept = np.full(len(base), -1, np.int32)
    for i, s in enumerate(states):
        accept[s] = numbers[i] + np.arange(len(s))
    return Trie(base.astype(np.int32), check.astype(np.int32), accept, digits)


def _place(parents, labels, base, check, rng) -> tuple[np.ndarray, np.ndarray]:
    """Gives the ``parents`` (sorted, one for each child) bases so that their children stand apart."""
    nodes, first, size = np.unique(parents, return_index=True, return_counts=True)
    big = size >= _BLOCK
    n_big, old = int(big.sum()), len(base)
    total = old + n_big * _DIGIT + 3 * int(size[~big].sum()) + 2 * _DIGIT
    base = np.concatenate([base, np.zeros(total - old, np.int64)])
    check = np.concatenate([check, np.full(total - old, _FREE, np.int64)])
    base[nodes[big]] = old + _DIGIT * np.arange(n_big)
    rows = np.repeat(big, size)
    check[base[parents[rows]] + labels[rows]] = parents[rows]
    for children in range(_BLOCK - 1, 0, -1):
        waiting = np.flatnonzero(size == children)
        while len(waiting):
            at = rng.integers(_LOST + 1, total - _DIGIT, len(waiting))
            slots = at[:, None] + labels[first[waiting][:, None] + np.arange(children)]
            fits = (check[slots] == _FREE).all(axis=1)
            some, slots, at = waiting[fits], slots[fits], at[fits]
            check[slots] = nodes[some][:, None]  # of two that want one place the later has it
            won = (check[slots] == nodes[some][:, None]).all(axis=1)
            given_back = slots[~won][check[slots[~won]] == nodes[some[~won]][:, None]]
            check[given_back] = _FREE
            base[nodes[some[won]]] = at[won]
            waiting = np.concatenate([waiting[~fits], some[~won]])
    return base, check


class Places:
    """All places of a batch of numbered texts, advanced through a trie at the same time."""

    def __init__(self, trie: Trie, words: np.ndarray):
        self.trie, self.words, self.length = trie, words, 0
        self.at = np.arange(len(words))
        self.states = np.zeros(len(words), np.int64)

    def further(self) -> None:
        """On by a word; places that are in no phrase are left behind."""
        self._keep(self.at + self.length < len(self.words))
        after = self.words[self.at + self.length]
        self._keep(after >= 0)
        self.states = self.trie.advance(self.states, after[after >= 0].astype(np.int64))
        self._keep(self.states != _LOST)
        self.length += 1

    def _keep(self, kept: np.ndarray) -> None:
        self.at, self.states = self.at[kept], self.states[kept]

    def accepted(self) -> np.ndarray:
        """The numbers of the phrases that end here, -1 for none."""
        return self.trie.accept[self.states]


def _spans(column: pa.Array) -> tuple[wordhash.Text, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, starts and ends of their words, each word's text, and whether it begins a piece."""
    text = wordhash.fold(wordhash.text_bytes(column))
    starts, ends = wordhash.split(text, _GAP)
    row = np.searchsorted(text.offsets, starts, side="right") - 1
    breaks = np.cumsum(_BREAK[text.data])[starts] if len(starts) else starts
    begins = np.ones(len(starts), bool)
    begins[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
    return text, starts, ends, row, begins


def _distinct(text, starts, ends, row, langs: pa.Array):
    """Different (language, word) pairs: names of the languages, words, pairs as two codes, and each word's pair."""
    words, number = wordhash.spans_coded(text.data, starts, ends)
    named = langs.dictionary_encode()
    n = len(words)
    pair = named.indices.to_numpy(zero_copy_only=False)[row].astype(np.int64) * n + number
    pairs, which, counts = np.unique(pair, return_inverse=True, return_counts=True)
    return named.dictionary.to_pylist(), words, pairs // n, pairs % n, which, counts


def _texts(documents: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return documents.select(lang, F.col("text").cast("string").alias("text"))


def _word_counts(texts: DataFrame) -> DataFrame:
    """``lang``, ``word`` (bytes) and ``f``."""
    schema = T.StructType(
        [T.StructField("lang", T.StringType()), T.StructField("word", T.BinaryType()), T.StructField("f", T.LongType())]
    )
    out = arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=_PIECE):
                text, starts, ends, row, _ = _spans(piece.column(1))
                if not len(starts):
                    continue
                langs, words, lang, word, _, counts = _distinct(text, starts, ends, row, piece.column(0))
                columns = [
                    pa.array(langs, pa.string()).take(pa.array(lang)),
                    words.take(pa.array(word)).cast(pa.binary()),
                    pa.array(counts, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return map_batches(texts, count, schema).groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written with a gapless ``id`` from 0, and its number of rows."""
    rows = written(df.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("least"))
    # one row for each partition that was written
    before, starts = 0, []
    for part_, n, least in sorted(tuple(r) for r in counts.collect()):
        starts.append((part_, before - least))
        before += n
    if not before:
        return rows.select("*", F.lit(0).cast("int").alias("id")).drop("_at"), 0
    shifts = df.sparkSession.createDataFrame(starts, "_part long, _shift long")
    joined = rows.join(F.broadcast(shifts), part == F.col("_part"))
    return joined.select(*df.columns, (F.col("_at") + F.col("_shift")).cast("int").alias("id")), before


def _encoded(texts: DataFrame, words: DataFrame, n_words: int, shard_words: int) -> DataFrame:
    """Batches of texts as numbers: ``words``, where -1 stands for all that no frequent phrase can cross."""
    spark = texts.sparkSession
    schema = T.StructType([T.StructField("words", T.ArrayType(T.IntegerType()))])
    kept = T.StructType([T.StructField("lang", T.StringType()), T.StructField("text", T.StringType()), *schema.fields])
    shards = max(1, -(-n_words // shard_words))
    rows = texts
    for shard in range(shards):
        # a range of numbers: at most shard_words rows
        own = words.filter(F.col("id").between(shard * shard_words, (shard + 1) * shard_words - 1))
        known = spark.sparkContext.broadcast(_vocabulary(own))
        last = shard == shards - 1
        out = arrow_schema(schema if last else kept)

        def encode(
            batches: Iterator[pa.RecordBatch], first=shard == 0, last=last, out=out, known=known
        ) -> Iterator[pa.RecordBatch]:
            vocabulary = known.value
            for batch in batches:
                for piece in pieces(batch, limit=_PIECE):
                    numbers, cut = _piece_numbers(piece, vocabulary, first)
                    if last:
                        columns = [pa.array([_trimmed(numbers)], out.field(0).type)]
                    else:
                        parts = [numbers[a:b] for a, b in zip(cut[:-1], cut[1:])]
                        columns = [piece.column(0), piece.column(1), pa.array(parts, out.field(2).type)]
                    yield pa.RecordBatch.from_arrays(columns, schema=out)

        rows = written(map_batches(rows, encode, schema if last else kept), "numbers")
    return rows


def _vocabulary(words: DataFrame) -> dict[str, dict[bytes, int]]:
    found: dict[str, dict[bytes, int]] = {}
    table = words.select("lang", "word", "id").toArrow()
    for lang, word, number in zip(*[column.to_pylist() for column in table.columns]):
        found.setdefault(lang, {})[word] = number
    return found


def _piece_numbers(piece: pa.RecordBatch, vocabulary, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the piece's words, with a break before each text and each piece of one."""
    text, starts, ends, row, begins = _spans(piece.column(1))
    place = np.arange(len(starts)) + np.cumsum(begins)
    n = len(starts) + int(begins.sum())
    cut = np.concatenate([place - begins, [n]])[np.searchsorted(starts, text.offsets)] if len(starts) else np.zeros(len(piece) + 1, int)
    if first:
        numbers = np.full(n, _NO_WORD, np.int32)
    else:
        numbers = pa.compute.list_flatten(piece.column(2)).to_numpy(zero_copy_only=False).astype(np.int32)
    if len(starts):
        langs, words, lang, word, which, _ = _distinct(text, starts, ends, row, piece.column(0))
        own = [vocabulary.get(name, {}) for name in langs]
        values = words.to_pylist()
        found = np.array([own[a].get(values[b], _NO_WORD) for a, b in zip(lang.tolist(), word.tolist())], np.int32)[which]
        known = found >= 0
        numbers[place[known]] = found[known]
    return numbers, cut


def _trimmed(numbers: np.ndarray) -> np.ndarray:
    """Without words that have no known neighbour, breaks taken together, and one at the end."""
    known = np.concatenate([[False], numbers >= 0, [False]])
    beside = known[1:-1] & (known[:-2] | known[2:])
    kept = beside | np.concatenate([[False], beside[:-1]])
    return np.append(np.where(beside, numbers, _NO_WORD)[kept], np.int32(_NO_WORD)).astype(np.int32)


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    return pa.compute.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int32)


_RESULT = T.StructType(
    [
        T.StructField("lang", T.StringType()), T.StructField("rank", T.LongType()), T.StructField("phrase", T.StringType()),
        *[T.StructField(name, T.LongType()) for name in ("a", "l", "r", "n", "score")],
    ]
)
_FOUND = T.StructType([T.StructField("phrase", T.BinaryType()), T.StructField("f", T.LongType())])


def _rows(phrases: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Phrases as the big-endian bytes of their numbers."""
    data = np.ascontiguousarray(phrases.astype(">i4"))
    width = 4 * phrases.shape[1]
    offsets = np.arange(len(data) + 1, dtype=np.int32) * width
    column = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([column, pa.array(counts, pa.int64())], schema=arrow_schema(_FOUND))


def _summed(batches: Iterator[pa.RecordBatch], keys) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different keys of a task with their counts, passed on when there are many."""
    held, counts, size = [], [], 0
    for batch in batches:
        found, n = np.unique(keys(_flat(batch)), return_counts=True)
        held.append(found)
        counts.append(n)
        size += len(found)
        if size > 2 * _HELD:
            held, counts = _merged(held, counts)
            size = len(held[0])
            if size > _HELD:
                yield held[0], counts[0]
                held, counts, size = [], [], 0
    if held:
        held, counts = _merged(held, counts)
        yield held[0], counts[0]


def _merged(held, counts):
    found, which = np.unique(np.concatenate(held), return_inverse=True)
    return [found], [np.bincount(which, np.concatenate(counts), len(found)).astype(np.int64)]


def _shards(phrases: DataFrame, limit: int) -> Iterator[list[np.ndarray]]:
    """The phrases dealt to shards of about ``limit``, one at a time; a matrix for each length."""
    n = -(-phrases.count() // limit)
    for shard in range(n):
        own = phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(n)) == shard)
        column = own.select("phrase").toArrow().column(0).combine_chunks()
        sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
        out = []
        for size in np.unique(sizes).tolist():
            data = b"".join(column.filter(pa.array(sizes == size)).to_pylist())
            out.append(np.frombuffer(data, ">i4").reshape(-1, size // 4).astype(np.int64))
        yield out


def _word_pairs(texts: DataFrame) -> DataFrame:
    """Neighbouring frequent words, counted within tasks."""

    def pairs(numbers: np.ndarray) -> np.ndarray:
        a, b = numbers[:-1].astype(np.int64), numbers[1:].astype(np.int64)
        both = (a >= 0) & (b >= 0)
        return a[both] << 32 | b[both]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _summed(batches, pairs):
            yield _rows(np.stack([keys >> 32, keys & 0xFFFFFFFF], axis=1), counts)

    return map_batches(texts, search, _FOUND)


def _extended(texts: DataFrame, phrases: np.ndarray, n_words: int, whole: bool) -> DataFrame:
    """Phrases one word longer than ``phrases`` that begin with one of them - and, if those are the ``whole``
    set, end with one too - counted within tasks."""
    spark = texts.sparkSession
    width = phrases.shape[1]
    known = spark.sparkContext.broadcast((double_array([phrases], n_words), phrases))

    def keys(numbers: np.ndarray) -> np.ndarray:
        places = Places(known.value[0], numbers)
        for _ in range(width):
            places.further()
        number = np.full(len(numbers) + 1, -1, np.int64)
        number[places.at] = places.accepted()
        begins, ends = number[:-1], number[1:]
        after = np.append(numbers[width:], np.full(width, _NO_WORD))[: len(numbers)].astype(np.int64)
        both = (begins >= 0) & (after >= 0)
        if whole:
            both &= ends >= 0
        return begins[both] << 32 | after[both]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, counts in _summed(batches, keys):
            first = known.value[1][found >> 32]
            yield _rows(np.concatenate([first, (found & 0xFFFFFFFF)[:, None]], axis=1), counts)

    return map_batches(texts, search, _FOUND)


def _counted(texts: DataFrame, phrases: list[np.ndarray], n_words: int) -> DataFrame:
    """How often each of the phrases occurs: accepting states by task, summed.

    A task's counts are a row for each ``_PACK`` phrases, and rows are added up in two steps, so that no group has
    more than a part of the tasks' rows.
    """
    spark = texts.sparkSession
    known = spark.sparkContext.broadcast((double_array(phrases, n_words), phrases))
    longest = max(p.shape[1] for p in phrases)
    size = sum(len(p) for p in phrases)
    packed = T.StructType(
        [
            T.StructField("pack", T.IntegerType()), T.StructField("part", T.IntegerType()),
            T.StructField("counts", T.ArrayType(T.LongType())),
        ]
    )
    out = arrow_schema(packed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, _ = known.value
        total = np.zeros(-(-size // _PACK) * _PACK, np.int64)
        for batch in batches:
            places = Places(trie, _flat(batch))
            while places.length < longest and len(places.at):
                places.further()
                ended = places.accepted()
                total += np.bincount(ended[ended >= 0], minlength=len(total))
        packs = total.reshape(-1, _PACK)
        seen = np.flatnonzero(packs.any(axis=1))
        part = TaskContext.get().partitionId() % _PARTS
        columns = [pa.array(seen, pa.int32()), pa.array(np.full(len(seen), part), pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(packs[seen]), out.field(2).type)], schema=out)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, phrases = known.value
        first = np.cumsum([0] + [len(p) for p in phrases])
        for batch in batches:
            for pack, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                numbers = pack * _PACK + np.flatnonzero(np.array(counts))
                for matrix, low in zip(phrases, first):
                    own = numbers[(numbers >= low) & (numbers < low + len(matrix))]
                    if len(own):
                        yield _rows(matrix[own - low], np.array(counts)[own - pack * _PACK])

    nothing = F.array_repeat(F.lit(0).cast("bigint"), _PACK)
    added = F.reduce(F.collect_list("counts"), nothing, lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("counts")
    summed = map_batches(texts, count, packed).groupBy("pack", "part").agg(added).groupBy("pack").agg(added)
    return map_batches(summed, name, _FOUND)


def _candidates(
    texts: DataFrame, n_words: int, min_count: int, max_words: int, shard_phrases: int
) -> DataFrame:
    """``phrase`` of all phrases of two words and more that are there often enough."""
    level = written(_often(_word_pairs(texts), min_count), "phrases-2")
    found = [level]
    for width in range(3, max_words + 1):
        parts = []
        whole = level.count() <= shard_phrases
        for shard in _shards(level, shard_phrases):
            # a phrase begins with one phrase only, so its count is whole
            parts.append(written(_often(_extended(texts, shard[0], n_words, whole), min_count), f"phrases-{width}"))
        if not parts:
            break
        level = parts[0]
        for part in parts[1:]:
            level = level.unionByName(part)
        found.append(level)
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out.select("phrase")


def _often(found: DataFrame, min_count: int) -> DataFrame:
    return found.groupBy("phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)


def _words_of(phrase: Column) -> Column:
    """The word numbers of a phrase's bytes."""
    places = F.sequence(F.lit(1), F.length(phrase), F.lit(4))
    return F.transform(places, lambda i: F.conv(F.hex(F.substring(phrase, i, F.lit(4))), 16, 10).cast("int"))


def _scored(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """``candidates`` (``phrase``, ``a``, ``n``) with ``l``, ``r`` and ``score`` at the cut that binds least."""
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), (F.length("phrase") / 4).cast("int") - 1)))
    cuts = cuts.withColumns(
        {
            "left": F.substring(F.col("phrase"), F.lit(1), F.col("k") * 4),
            "right": F.substring(F.col("phrase"), F.col("k") * 4 + 1, F.length("phrase")),
        }
    )
    for side, name in (("left", "l"), ("right", "r")):
        counts = parts.select(F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(counts, side)
    whole = "CAST(a * 1000 AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))"
    score = F.expr(f"({whole}) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("phrase", "a", "n", "lang").agg(least).select(
        "phrase", "lang", "a", "n", "cut.l", "cut.r", "cut.score"
    )


def collocations(
    documents: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    shard_words: int = SHARD_WORDS,
    shard_phrases: int = SHARD_PHRASES,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's first ``top`` phrases.

    ``a`` counts the phrase, ``l`` and ``r`` its parts at the weakest cut, ``n`` all words of the language.
    """
    spark = documents.sparkSession
    texts = _texts(documents)
    counted = written(_word_counts(texts), "words")
    totals = written(counted.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    totals = broadcast_if(totals, totals.count(), _BROADCAST_ROWS)
    words, n_words = _numbered(counted.filter(F.col("f") >= min_count).join(totals, "lang"), "frequent")
    numbers = _encoded(texts, words, n_words, shard_words)
    candidates = _candidates(numbers, n_words, min_count, max_words, shard_phrases)
    counts = None
    for shard in _shards(candidates, shard_phrases):
        part = written(_counted(numbers, shard, n_words), "counts")
        counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        return spark.createDataFrame([], _RESULT)
    key = F.unhex(F.lpad(F.hex("id"), 8, "0"))
    parts = words.select(key.alias("phrase"), "f").unionByName(counts)
    # a longer candidate as frequent as what it holds implies one that is longer by a word
    long = counts.filter(F.length("phrase") > 8)
    size = F.length("phrase") - 4
    inner = F.array(F.substring(F.col("phrase"), F.lit(1), size), F.substring(F.col("phrase"), F.lit(5), size))
    around = long.select(F.explode(inner).alias("phrase"), "f").groupBy("phrase").agg(F.max("f").alias("around"))
    closed = counts.join(around, "phrase", "left").filter(F.col("around").isNull() | (F.col("around") < F.col("f")))
    first = words.select("id", "lang", "n")
    named = closed.select("phrase", F.col("f").alias("a"), F.get(_words_of(F.col("phrase")), F.lit(0)).alias("id")).join(first, "id")
    scored = _scored(named.drop("id"), parts)
    order = [F.desc("score"), F.desc("a")]
    by_lang = Window.partitionBy("lang").orderBy(*order)
    # with all that tie, which their texts decide
    listed = written(scored.withColumn("place", F.rank().over(by_lang)).filter(F.col("place") <= top), "listed")
    spelled = listed.select("phrase", F.posexplode(_words_of(F.col("phrase"))).alias("at", "id")).join(
        words.select("id", F.col("word").cast("string").alias("word")), "id"
    ).groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    text = F.array_join("words.word", " ")
    out = listed.join(spelled, "phrase").withColumn("phrase", text)
    by_text = Window.partitionBy("lang").orderBy(*order, F.asc("phrase"))
    ranked = out.withColumn("rank", F.row_number().over(by_text).cast("long")).filter(F.col("rank") <= top)
    return ranked.select(*_RESULT.fieldNames())


def oracle_sql(min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP) -> str:
    """The same in DuckDB's SQL, all phrases counted."""
    return rf"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
g AS (
  SELECT lang, m, array_to_string(w[s:s + m - 1], ' ') AS phrase, w[s:s + m - 1] AS p
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM w, range(1, {max_words + 1}) r(m) WHERE len(w) >= m)),
c AS (SELECT lang, m, phrase, any_value(p) AS p, count(*) AS f FROM g GROUP BY lang, m, phrase),
tot AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE m = 1 GROUP BY lang),
cand AS (SELECT * FROM c WHERE m > 1 AND f >= {min_count}),
cut AS (
  SELECT cand.lang, cand.phrase, cand.f AS a, k, x.f AS l, y.f AS r,
         (CAST(1000 AS HUGEINT) * cand.f * n) // (CAST(x.f AS HUGEINT) * y.f) AS score, n
  FROM cand JOIN tot USING (lang), range(1, {max_words}) q(k), c x, c y
  WHERE k < cand.m AND x.lang = cand.lang AND x.phrase = array_to_string(cand.p[1:k], ' ')
    AND y.lang = cand.lang AND y.phrase = array_to_string(cand.p[k + 1:cand.m], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cut),
inner_ AS (
  SELECT lang, array_to_string(p[s:s + z - 1], ' ') AS phrase, max(f) AS f
  FROM (SELECT lang, p, f, m, z, unnest(range(1, m - z + 2)) AS s FROM cand, range(2, {max_words}) r(z) WHERE z < m)
  GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase)
  WHERE nth = 1 AND (inner_.f IS NULL OR 100 * inner_.f < 100 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {top}
"""
