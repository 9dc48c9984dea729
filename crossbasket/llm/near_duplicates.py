"""Near-duplicate documents by circulant MinHash and exact Jaccard similarity.

A document is the set of its five-word shingles. Shingles are hashed into a universe of 2**32 slots;
one permutation scatters the slots, a second one, shifted circularly by 0, 1, 2 and so on, gives every
coordinate of the signature. With 32 bands of four coordinates, two documents of similarity 0.75 meet
in no band with probability 5e-6.

Copies of one word sequence are one class from the start, whatever their number; classes are told apart by a
128-bit hash of their words. Classes that agree in a band share a bucket, and buckets never give all their
pairs. A few rounds compare each class of a bucket with one of them, the hub, which is the same for most
buckets of a group of near copies, and only across components. Of what is left - mostly documents that
share a passage without being similar - every pair of different components is looked at in an exact prefix
filter: with the shingles of a class ordered from rare to common, a similar pair has its first common
shingle early in both, in the shorter one among the first seventh, so that common passages, being last,
bring nobody together. Where one component holds most of a shingle's classes, only the others are compared
with all. Length and position bound what a pair can share before it is made.

A pair is confirmed in two steps: sketches of 128 coordinates, four bits each, must agree in half (at
similarity 0.75 fewer do with probability below 1e-10), and then the full sets of shingle hashes
decide. So sets are only taken of classes that are close to some other.

Tables are written to the shared folder between steps and deleted once their successors are there. Pairs
and labels of which there are few are broadcast, more are shuffled; hot keys meet in joins that adaptive
execution splits. Nothing that grows with the documents comes to the driver, but for the commonest
shingles, of which there are ``COMMON_SHINGLES`` at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossbasket.llm import wordhash
from crossbasket.llm.batches import arrow_schema, map_batches, pieces
from crossbasket.llm.shared import Room, broadcast_if

SHINGLE = 5
PERCENT = 75
BANDS = 32
ROWS = 4
HUB_ROUNDS = 3
COMMON_FROM = 16  # classes that hold a shingle which is not rare
COMMON_SHINGLES = 1 << 20
BROADCAST_ROWS = 200_000
_AT_ONCE = 1024  # shingles whose coordinates are laid out at the same time
_PERMUTATIONS = ((0x85EBCA6B, 0xC2B2AE35), (0x9E3779B1, 0x7FEB352D))


def _permuted(slots: np.ndarray, which: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    first, second = (np.uint32(f) for f in _PERMUTATIONS[which])
    slots ^= slots >> np.uint32(16)
    slots *= first
    slots ^= slots >> np.uint32(15)
    slots *= second
    slots ^= slots >> np.uint32(16)
    return slots


class CirculantMinHash:
    """Signatures from two permutations of the slots, the second one shifted for each coordinate."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.shifts = np.arange(bands * rows, dtype=np.uint32)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        slots = _permuted(shingles.astype(np.uint32), 0)  # the lower half of the hash
        least = None
        for i in range(0, len(slots), _AT_ONCE):
            block = _permuted(slots[i : i + _AT_ONCE, None] + self.shifts, 1).min(axis=0)
            least = block if least is None else np.minimum(least, block)
        return least

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        table = signature.reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(self.bands, dtype=np.uint64)
        for i in range(self.rows):
            key = wordhash.mix(key * np.uint64(0x9E3779B97F4A7C15) + table[:, i])
        return key.view(np.int64)


def sketch(signature: np.ndarray) -> bytes:
    """Four bits of each coordinate."""
    low = (signature & np.uint32(15)).astype(np.uint8)
    return (low[::2] << 4 | np.append(low[1::2], np.zeros(len(low) % 2, np.uint8))).tobytes()


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many coordinates agree in the sketches that are rows of ``a`` and ``b``."""
    differ = a ^ b
    return ((differ & 0xF0) == 0).sum(axis=1) + ((differ & 0x0F) == 0).sum(axis=1)


def document_sets(column: pa.Array, width: int) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """Of each text a 16-byte hash of its word sequence (null without words) and its shingles, sorted."""
    text = wordhash.fold(wordhash.text_bytes(column))
    found = wordhash.words(text)
    grams, at = wordhash.sequences(found, width)
    cut = np.searchsorted(at, found.first)
    for i, name in enumerate(wordhash.word_sequences(text)):
        if found.first[i] == found.first[i + 1]:
            yield None, np.empty(0, np.uint64)
            continue
        own = grams[cut[i] : cut[i + 1]]
        yield name, np.unique(own) if len(own) else np.frombuffer(name[:8], np.uint64)


def _signatures(documents: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema["doc_id"].dataType),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("class", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("sketch", T.BinaryType()),
        ]
    )
    out = arrow_schema(schema)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = CirculantMinHash(bands, rows)
        for batch in batches:
            for piece in pieces(batch):
                sets = list(document_sets(piece.column(1), width))
                signed = [minhash.signature(s) if len(s) else None for _, s in sets]
                columns = [
                    piece.column(0),
                    pa.array([len(s) for _, s in sets], pa.int64()),
                    pa.array([name for name, _ in sets], pa.binary()),
                    pa.array([None if s is None else minhash.band_keys(s) for s in signed], out.field("bands").type),
                    pa.array([None if s is None else sketch(s) for s in signed], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return map_batches(documents.select("doc_id", F.col("text").cast("string").alias("text")), sign, schema)


_SETS = T.StructType([T.StructField("class", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def _class_sets(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``class`` and ``shingles`` of the classes ``wanted`` (``class``, its ``name`` and the ``doc_id`` of one member)."""
    texts = documents.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    known = broadcast_if(wanted, wanted.count(), BROADCAST_ROWS)
    rows = texts.join(known, F.col("doc_id").eqNullSafe(F.col("_id"))).select("class", "name", "text")
    out = arrow_schema(_SETS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                names = zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), document_sets(piece.column(2), width))
                # rows that share a doc_id need not share a text
                own = [(class_, s.view(np.int64)) for class_, name, (found, s) in names if name == found]
                columns = [pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], out.field(1).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return map_batches(rows, cut, _SETS).dropDuplicates(["class"])


def components(room: Room, links: DataFrame) -> DataFrame:
    """``class`` and ``label``, the smallest class it is connected with, of all classes in ``links``.

    Each step labels every class with its smallest neighbour and goes on with the links between
    different labels only: a star is done in one step, and a component keeps its smallest class.
    """
    edges, labels = links.select("a", "b"), None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("class")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
        least = room.write(least, "least")
        moved = least if labels is None else room.write(_moved(labels, least), "labels")
        left = edges
        for end in ("a", "b"):
            known = least.select(F.col("class").alias(end), "label")
            left = left.join(known, end).withColumn(end, F.col("label")).drop("label")
        left = room.write(left.select("a", "b").filter("a <> b").distinct(), "edges")
        room.drop(edges, labels)
        edges, labels = left, moved
        if edges.isEmpty():
            room.drop(edges)
            return labels
        if labels is not least:
            room.drop(least)


def _moved(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """``labels`` where those that are classes in ``joined`` are replaced by their labels there."""
    after = joined.select(F.col("class").alias("label"), F.col("label").alias("after"))
    return labels.join(after, "label", "left").select("class", F.coalesce("after", "label").alias("label"))


def _relabelled(room: Room, labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after further ``links`` (written): components of what the links' ends were labelled before."""
    if labels is None:
        return components(room, links)
    ends = links
    for end in ("a", "b"):
        before = labels.select(F.col("class").alias(end), "label")
        ends = ends.join(before, end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    ends = room.write(ends.select("a", "b").filter("a <> b").distinct(), "joined")
    joined = components(room, ends)
    # classes that had no label until now are ends of links themselves
    fresh = joined.join(labels.select("class"), "class", "left_anti")
    out = room.write(_moved(labels, joined).unionByName(fresh), "labels")
    room.drop(labels, joined, ends)
    return out


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with the ``label`` of their ``class``: the class itself where it is linked with none."""
    if labels is None:
        return rows.withColumn("label", F.col("class"))
    return rows.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))


def _needed(n_a: Column, n_b: Column, percent: int) -> Column:
    """How many shingles two sets of these sizes must share."""
    return F.ceil((n_a + n_b) * percent / (100 + percent))


def _close(classes: DataFrame, pairs: DataFrame, bands: int, rows: int) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose sketches agree in half of the coordinates."""
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("class").alias(end), F.col("sketch").alias(f"sketch_{end}")), end)
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    out = arrow_schema(schema)
    padding = bands * rows % 2  # agrees always

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3)
            )
            close = pa.array(2 * (agreeing(left, right) - padding) >= bands * rows)
            columns = [batch.column(0).filter(close), batch.column(1).filter(close)]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return map_batches(pairs.select("a", "b", "sketch_a", "sketch_b"), compare, schema)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (``a``, ``b``; written) whose full sets are similar enough.

    Each end meets its set by itself, then the ends meet by pair, where no key is hot. Few pairs are
    broadcast to the sets, many are shuffled with them.
    """
    known = broadcast_if(pairs, pairs.count(), BROADCAST_ROWS)
    left = sets.withColumnsRenamed({"class": "a", "shingles": "set_a"}).join(known, "a")
    right = sets.withColumnsRenamed({"class": "b", "shingles": "set_b"}).join(known, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    joined = left.join(right, ["a", "b"]).select(
        "a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("total")
    )
    return joined.filter(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent).select("a", "b")


def _common_shingles(sets: DataFrame, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles, ascending, and how many of the ``sets`` hold each: all that ``COMMON_FROM`` hold or, of
    more than ``COMMON_SHINGLES``, those above a higher number. They only order shingles: any order is exact."""
    counted = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    counted = room.write(counted.filter(F.col("n") >= COMMON_FROM), "common")
    least = COMMON_FROM
    while counted.filter(F.col("n") >= least).count() > COMMON_SHINGLES:
        least *= 2
    table = counted.filter(F.col("n") >= least).toArrow()
    room.drop(counted)
    shingles, n = (column.to_numpy().astype(np.int64) for column in table.columns)
    order = np.argsort(shingles)
    return shingles[order], n[order]


def prefix(shingles: np.ndarray, common: np.ndarray, held_by: np.ndarray, percent: int) -> np.ndarray:
    """Those of a set's shingles, rarest first, that may be the first one it shares with a similar set."""
    n = len(shingles)
    weight = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        weight = np.where(common[at] == shingles, held_by[at], 0)
    order = np.lexsort((shingles, weight))
    return shingles[order[: n - -(-n * percent // 100) + 1]]


def _prefixes(sets: DataFrame, common: np.ndarray, held_by: np.ndarray, percent: int) -> DataFrame:
    """``key``, ``class``, its size ``n`` and the place ``at`` of the shingle ``key`` in its order, of all prefixes."""
    known = sets.sparkSession.sparkContext.broadcast((common, held_by))
    schema = T.StructType([T.StructField(name, T.LongType()) for name in ("key", "class", "n", "at")])
    out = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, held_by = known.value
        for batch in batches:
            values = batch.column(1)
            bounds = values.offsets.to_numpy() - values.offsets[0].as_py()
            shingles = values.flatten().to_numpy(zero_copy_only=False)
            rows = [prefix(shingles[a:b], common, held_by, percent) for a, b in zip(bounds[:-1], bounds[1:])]
            sizes = np.array([len(r) for r in rows], np.int64)
            first = np.cumsum(sizes) - sizes
            columns = [
                np.concatenate([*rows, np.empty(0, np.int64)]),
                np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes),
                np.repeat(np.diff(bounds), sizes),
                np.arange(sizes.sum()) - np.repeat(first, sizes),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=out)

    return map_batches(sets.select("class", "shingles"), cut, schema)


def _prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b``: pairs of classes of different labels that may be similar, by a shingle in the prefixes of both.

    ``rows`` (written) hold ``key``, ``class``, ``n``, ``at`` and ``label``. Each pair has a class whose label is not
    the one that most of the shingle's classes have, so only such classes meet all others.
    """
    by_label = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    main = by_label.groupBy("key").agg(
        F.max_by("label", F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("labels")
    )
    live = rows.join(main.filter("labels > 1").drop("labels"), "key")
    x, y = live.alias("x"), live.alias("y")
    # y is the shorter one: among its first shingles only, as it must share more of them
    few = 2 * percent * F.col("n")
    early = F.col("at") * (100 + percent) <= F.col("n") * (100 + percent) - few
    shorter = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.class") < F.col("x.class")))
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    possible = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.label") != F.col("y.label"))
        & shorter
        & (F.col("y.n") * 100 >= F.col("x.n") * percent)
        & (left >= _needed(F.col("x.n"), F.col("y.n"), percent))
    )
    other = F.col("label") != F.col("main")
    first = x.filter(other).join(y.filter(early), possible)
    second = x.filter(~other).join(y.filter(early & other), possible)
    ends = F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")
    return first.select(*ends).unionByName(second.select(*ends)).distinct()


def _hub_pairs(placed: DataFrame, number: int, percent: int) -> DataFrame:
    """``a``, ``b``: each class with one of the hubs of its buckets, the one it shares most buckets with.

    The hub of a bucket comes first in an order of all classes: in the first round the class with the fullest buckets,
    as what copies were made from meets more of them than they meet each other; later by a hash. Hubs
    that a class does not meet are left to later rounds and to the prefixes, so a round makes no more pairs than there
    are classes.
    """
    place = F.xxhash64("class", F.lit(number)) if number else -F.col("weight")
    order = F.struct(place.alias("place"), "class", "n", "label")
    hubs = placed.groupBy("key").agg(F.min(order).alias("hub"))
    met = placed.join(hubs, "key").filter(
        (F.col("label") != F.col("hub.label"))
        & (F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent)
    )
    shared = met.groupBy("class", F.col("hub.class").alias("hub")).agg(F.count(F.lit(1)).alias("keys"))
    best = shared.groupBy("class").agg(F.max(F.struct("keys", "hub")).alias("best")).select("class", "best.hub")
    return best.select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()


class _Search:
    """Links between classes, and the components they make."""

    def __init__(self, room: Room, documents: DataFrame, classes: DataFrame, percent: int, width: int, bands: int, rows: int):
        self.room, self.documents, self.classes = room, documents, classes
        self.percent, self.width, self.bands, self.rows = percent, width, bands, rows
        self.labels: DataFrame | None = None

    def sets(self, wanted: DataFrame) -> DataFrame:
        """Full sets of the classes in ``wanted`` (``class``), written."""
        known = self.room.write(self.classes.select("class", "name", "doc_id").join(wanted.distinct(), "class"), "wanted")
        out = self.room.write(_class_sets(self.documents, known, self.width), "sets")
        self.room.drop(known)
        return out

    def link(self, pairs: DataFrame, sets: DataFrame | None = None) -> None:
        """Takes the ``pairs`` that are similar into the labels."""
        close = self.room.write(_close(self.classes, pairs, self.bands, self.rows), "close")
        if not close.isEmpty():
            own = self.sets(close.select(F.explode(F.array("a", "b")).alias("class"))) if sets is None else sets
            links = self.room.write(_confirmed(close, own, self.percent), "links")
            if sets is None:
                self.room.drop(own)
            if not links.isEmpty():
                self.labels = _relabelled(self.room, self.labels, links)
            self.room.drop(links)
        self.room.drop(close)

    def run(self, rounds: int) -> None:
        """All links that the buckets of bands bring about; components, not every link, are made whole."""
        room = self.room
        buckets = self.classes.select(F.explode("bands").alias("key"), "class", "n")
        shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        members = room.write(buckets.join(shared, "key"), "buckets")
        weights = members.groupBy("class").agg(F.sum("size").alias("weight"))
        weighted = room.write(members.drop("size").join(weights, "class"), "buckets")
        room.drop(members)
        members = weighted
        for number in range(rounds + 1):
            placed = _labelled(members.select("key", "class", "n", "weight"), self.labels)
            state = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
            placed = room.write(placed.join(state.filter("low <> high").select("key"), "key"), "members")
            room.drop(members)
            members = placed
            if members.isEmpty():
                break
            if number < rounds:
                self.link(_hub_pairs(members, number, self.percent))
        else:
            self._rest(members)

    def _rest(self, members: DataFrame) -> None:
        """Every pair of different components among the classes of unfinished buckets."""
        sets = self.sets(members.select("class"))
        rows = _prefixes(sets, *_common_shingles(sets, self.room), self.percent)
        rows = self.room.write(_labelled(rows, self.labels), "prefixes")
        self.link(_prefix_pairs(rows, self.percent), sets)
        self.room.drop(rows, sets)


def near_duplicates(
    documents: DataFrame,
    percent: int = PERCENT,
    width: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    hub_rounds: int = HUB_ROUNDS,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``documents``.

    ``component_id`` is the smallest doc_id reachable over links of at least ``percent`` similarity.
    A text of fewer than ``width`` words is one shingle; a null or wordless one has none and is
    linked with nothing. Repeated rows give repeated results, all of them kept if one is. A null
    doc_id is no candidate for the smallest; among null ids alone the component is null and the row
    kept. Other columns are ignored; an empty table gives an empty result.
    """
    room = Room(documents.sparkSession)
    signed = room.write(_signatures(documents, width, bands, rows), "signatures")
    classes = signed.filter(F.col("class").isNotNull()).groupBy(F.col("class").alias("name")).agg(
        F.min("doc_id").alias("doc_id"),
        F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    # numbers are fixed once they are written
    classes = room.write(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    members = room.write(signed.select("doc_id", "n_shingles", F.col("class").alias("name")), "documents")
    room.drop(signed)
    search = _Search(room, documents, classes, percent, width, bands, rows)
    search.run(hub_rounds)

    first = classes.select("name", "class", "doc_id")
    if search.labels is None:
        named = first.select("name", F.col("doc_id").alias("component_id"))
    else:
        smallest = search.labels.join(first, "class").groupBy("label").agg(F.min("doc_id").alias("smallest"))
        linked = search.labels.join(smallest, "label").select("class", "smallest")
        named = first.join(linked, "class", "left").select(
            "name", F.coalesce("smallest", "doc_id").alias("component_id")
        )
    named = room.write(named, "components")
    room.drop(classes, search.labels)
    out = members.join(named, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
