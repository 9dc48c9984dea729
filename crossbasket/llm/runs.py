"""Periodic runs in the word sequence of a text, by Lyndon roots.

A run is a stretch of words of smallest period q that no neighbour extends. Each holds, under the
order of the words or under its reverse, a Lyndon root of length q that is the longest Lyndon
word where it starts. Both Lyndon arrays come from the grouping phase of Baier's suffix sorter,
used for itself: groups of suffixes are taken from the highest down, and what stands right before a
group (and lower) grows by the group's own prefix, so that in the end every suffix's group has its
longest Lyndon prefix for a prefix. A root is then extended to both sides as far as words one
period apart agree: longest common extensions found for all roots at once by bisection over
fingerprints of prefixes (two prime moduli, a random base), and compared word by word afterwards.

Only repeated words are sorted. In a run of exponent at least e every word is there e times (rounded
down), so a rarer word of a text is in none and cuts it, again and again within what remains;
what a cut leaves holds all runs, with the neighbours that end them. Words of a batch get numbers by
comparing their bytes, so different words never share one.

One pass over the texts, no shuffle; a task holds one piece of about 1 MB of text, or one longer text,
and the arrays of its words. A null text has no words and no runs, as an empty one; a null doc_id is
kept. Repeated rows give repeated results, an empty table an empty one; other columns are ignored.
Of several longest runs the first counts, of those that start together the one of the shortest period.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossbasket.llm import wordhash
from crossbasket.llm.batches import arrow_schema, map_batches, pieces

MIN_LENGTH = 6
MIN_EXPONENT = 4
_PRIMES = (2147483647, 2147483629)
_BASES = tuple(int(b) for b in np.random.default_rng(13).integers(1 << 20, 1 << 30, 2))
_AT_ONCE = 1 << 20  # words compared at the same time
_NO_RUNS = np.empty((0, 3), np.int64)


def lyndon_array(ranks: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word that starts at each place of a sequence of numbers.

    ``order`` holds the suffixes by group, ascending; ``head`` is where a suffix's group starts in
    it, which compares groups. A group that was dealt with never changes again.
    """
    n = len(ranks)
    order = array("q", np.argsort(ranks, kind="stable").astype(np.int64).tobytes())
    sorted_ranks = np.asarray(ranks)[np.frombuffer(order, np.int64)]
    starts = np.flatnonzero(np.append(True, sorted_ranks[1:] != sorted_ranks[:-1]))
    sizes = np.diff(np.append(starts, n))
    heads = np.empty(n, np.int64)
    heads[np.frombuffer(order, np.int64)] = np.repeat(starts, sizes)
    head = array("q", heads.tobytes())
    place = np.empty(n, np.int64)
    place[np.frombuffer(order, np.int64)] = np.arange(n)
    place = array("q", place.tobytes())
    size = np.zeros(n, np.int64)
    size[starts] = sizes
    size = array("q", size.tobytes())
    length = array("q", bytes(8 * n))
    for i in range(n):
        length[i] = 1
    before = array("q", bytes(8 * n))  # the nearest earlier suffix of a lower group

    end = n
    while end:
        low = head[order[end - 1]]
        members = order[low:end]
        if end - low > 1:
            members = sorted(members)
        width = length[members[0]]
        children: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and head[j] >= low:  # higher, or of this group and seen already
                j = before[j]
            before[i] = j
            if j >= 0:
                children[j] = children.get(j, 0) + 1
        end = low
        if not children:
            continue
        by_count: dict[int, list[int]] = {}
        for j, count in children.items():
            by_count.setdefault(count, []).append(j)
        for count in sorted(by_count, reverse=True):
            moved = by_count[count]
            for j in moved:  # to the upper end of its group, behind what moves on
                g = head[j]
                size[g] -= 1
                top = g + size[g]
                other, at = order[top], place[j]
                order[at], order[top] = other, j
                place[other], place[j] = at, top
            tops = [head[j] + size[head[j]] for j in moved]
            for j, g in zip(moved, tops):
                head[j] = g
                length[j] += count * width
            # a group that moved as a whole keeps its start, which was counted down to nothing
            for g in tops:
                size[g] += 1
    return np.frombuffer(length, np.int64)


class _Fingerprints:
    """Compares parts of a sequence of numbers by two fingerprints."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.tables = [self._table(words, p, b) for p, b in zip(_PRIMES, _BASES)]

    @staticmethod
    def _table(words: np.ndarray, prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        power = np.ones(n + 1, np.int64)
        done = 1
        while done <= n:  # by doubling: as many new powers as there are
            more = min(done, n + 1 - done)
            power[done : done + more] = power[:more] * (power[done - 1] * base % prime) % prime
            done += more
        sums = np.zeros(n + 1, np.int64)
        np.cumsum((words + 1) % prime * power[:n] % prime, out=sums[1:])
        return power, sums % prime

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from ``a`` are those from ``b``, further on."""
        out = np.ones(len(a), bool)
        for (power, sums), prime in zip(self.tables, _PRIMES):
            left = (sums[a + size] - sums[a]) % prime * power[b - a] % prime
            out &= left == (sums[b + size] - sums[b]) % prime
        return out

    def extend(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words from ``a`` on agree with those from ``b`` on, up to ``most``, forwards (``step`` 1) or
        backwards from the words before."""
        least, most = np.zeros(len(a), np.int64), most.copy()
        while (open_ := np.flatnonzero(least < most)).size:
            middle = (least[open_] + most[open_] + 1) // 2
            back = 0 if step > 0 else middle
            same = self.equal(a[open_] - back, b[open_] - back, middle)
            least[open_[same]] = middle[same]
            most[open_[~same]] = middle[~same] - 1
        return least


def _exact(words: np.ndarray, run: tuple[int, int, int], roots: np.ndarray) -> set[tuple[int, int, int]]:
    """The runs around ``roots`` of the period of ``run``, word by word; fingerprints can only be too long."""
    start, length, q = run
    differs = np.flatnonzero(words[start : start + length - q] != words[start + q : start + length]) + start
    edges = np.concatenate([[start - 1], differs, [start + length - q]])
    after = np.searchsorted(edges, roots)
    low, high = edges[after - 1] + 1, edges[after] + q
    return {(int(s), int(e - s), q) for s, e in zip(low, high)}


def _dense(words: np.ndarray, times: int, at_least: int) -> Iterator[tuple[int, int]]:
    """Stretches that hold all runs: of words that are in the stretch ``times`` times."""
    todo = [(0, len(words))]
    while todo:
        low, high = todo.pop()
        part = words[low:high]
        _, number, counts = np.unique(part, return_inverse=True, return_counts=True)
        kept = counts[number] >= times
        if kept.all():
            if len(part):
                yield low, high
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], kept.astype(np.int8), [0]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s >= at_least:
                todo.append((low + s, low + e))


def _repeated(words: np.ndarray, i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the ``q`` words from ``i`` on are there again right behind, compared one by one, in blocks."""
    out = np.empty(len(i), bool)
    ends = np.cumsum(q)
    done = 0
    while done < len(i):
        base = ends[done] - q[done]
        upto = max(done + 1, int(np.searchsorted(ends, base + _AT_ONCE, side="right")))
        size = q[done:upto]
        first = ends[done:upto] - size - base
        at = np.arange(ends[upto - 1] - base) + np.repeat(i[done:upto] - first, size)
        out[done:upto] = np.logical_and.reduceat(words[at] == words[at + np.repeat(size, size)], first)
        done = upto
    return out


def _first_roots(words: np.ndarray, lengths: np.ndarray, min_exponent: int) -> np.ndarray:
    """Places that may hold the first complete root of a run; every run has one there or none in this order.

    A run of exponent e holds its root e - 1 times in a row. Roots of one length do not overlap, and those that
    are there again lie in each other at most logarithmically deep, so few words are compared.
    """
    n = len(words)
    i = np.arange(n)
    if min_exponent < 3:
        return i[i + lengths < n]
    i = i[i + 2 * lengths <= n]
    i = i[lengths[i + lengths[i]] == lengths[i]]
    i = i[_repeated(words, i, lengths[i])]
    again = np.zeros(n, bool)
    again[i] = True
    q = lengths[i]
    earlier = np.maximum(i - q, 0)
    keep = (i < q) | ~again[earlier] | (lengths[earlier] != q)
    for more in range(1, min_exponent - 2):
        at = np.minimum(i + more * q, n - 1)
        keep &= (i + more * q < n) & again[at] & (lengths[at] == q)
    return i[keep]


def _stretch_runs(words: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Runs of a sequence that is not cut further."""
    n = len(words)
    _, ranks = np.unique(words, return_inverse=True)
    places, periods = [], []
    for order in (ranks, -ranks):
        lengths = lyndon_array(order)
        i = _first_roots(words, lengths, min_exponent)
        places.append(i)
        periods.append(lengths[i])
    i, q = np.concatenate(places), np.concatenate(periods)
    if not len(i):
        return _NO_RUNS
    prints = _Fingerprints(ranks)
    after = prints.extend(i, i + q, n - i - q, 1)
    left = prints.extend(i, i + q, i, -1)
    length = left + after + q
    good = (length >= min_length) & (length >= min_exponent * q)
    found = np.unique(np.stack([i - left, length, q, i], axis=1)[good], axis=0)
    if not len(found):
        return _NO_RUNS
    first = np.flatnonzero(np.append(True, (found[1:, :3] != found[:-1, :3]).any(axis=1)))
    runs = set()
    for run, upto in zip(first.tolist(), [*first[1:].tolist(), len(found)]):
        runs |= _exact(words, tuple(found[run, :3].tolist()), found[run:upto, 3])
    runs = [run for run in runs if run[1] >= max(min_length, min_exponent * run[2])]
    return np.array(sorted(runs), np.int64).reshape(-1, 3)


def find_runs(words: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """``start``, ``length`` and ``period`` of all runs of ``min_length`` words and ``min_exponent`` periods, sorted."""
    if min_exponent < 2:
        raise ValueError("a run holds its period twice")
    found = [_NO_RUNS]
    for low, high in _dense(words, min_exponent, max(min_length, min_exponent)):
        runs = _stretch_runs(words[low:high], min_length, min_exponent)
        found.append(runs + np.array([low, 0, 0]))
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words stays where every run is cut down to its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def periodic_runs(
    documents: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``, the words
    that stay where each run is cut down to its first period, joined by blanks, of every row."""
    run = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema["doc_id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(run, False)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    out = arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                text = wordhash.text_bytes(piece.column(1))
                starts, ends = wordhash.split(text)
                numbers = wordhash.spans_coded(text.data, starts, ends)[1].astype(np.int64)
                first = np.searchsorted(starts, text.offsets)
                raw = text.data.tobytes()
                runs, collapsed = [], []
                for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
                    found = find_runs(numbers[low:high], min_length, min_exponent)
                    kept = np.flatnonzero(kept_words(high - low, found)) + low if len(found) else range(low, high)
                    words = [raw[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist())]
                    collapsed.append(b" ".join(words).decode())
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found.tolist()])
                columns = [
                    piece.column(0),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(runs, out.field("runs").type),
                    pa.array(collapsed, out.field("collapsed").type),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return map_batches(documents.select("doc_id", F.col("text").cast("string").alias("text")), search, schema)


def rewound(doc_id: Column, text: Column) -> Column:
    """``text``, whose words repeat themselves from some place on for a tenth of the ids.

    With h the CRC of the id: of n words each from number a on, a = g mod n and g = h div 10, becomes
    the one at a + (i - a) mod p, with p = 1 + (n - a) div (3 + g mod 8); only where h mod 10 is 0.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def again(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        place = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.array_join(F.transform(place, lambda i: F.get(w, i)), " ")

    # a one-element array to name the words: they are split once
    whole = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w)).otherwise(F.lit(""))), F.lit(0))
    return F.when(text.isNotNull() & (F.pmod(h, F.lit(10)) == 0), whole).otherwise(text)


def report(documents: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text of every row."""
    id_, text = F.col("doc_id"), F.col("text").cast("string")
    found = periodic_runs(documents.select(id_, rewound(id_, text).alias("text")))
    # longest, then first, then of the shortest period
    best = F.get(
        F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"], r["period"]))), F.lit(0)
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        (-F.col("_best.l")).alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(-F.col("_best.l") * 1000 / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
