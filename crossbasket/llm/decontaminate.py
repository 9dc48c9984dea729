"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item is cut into windows of ten words (a shorter item is one window). A window is the set of
its five-word shingles with their places. Shingles are ordered by rarity, counted over all
documents; as the whole window has to be contained, its rarest shingle alone is the necessary
prefix. A document's shingles are joined with the prefixes only; a window that starts before
the document's first word or ends after its last is dropped by place and length; what is left is
compared word by word.

Only the item side may be broadcast, and only within ``BROADCAST_ROWS`` counted rows; beyond that
the shingles are shuffled and joined. A shingle that no document has removes all its windows before
the second pass. Documents leave the scan task as one row each and one row per window found in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossbasket.llm.shared import broadcast_if, fold_case, written

# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text in which A-Z have become a-z
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 5
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    """Words as they stand; their case is folded where they are compared."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _shingle(words: Column, at: Column, width: int) -> Column:
    """A hash that is equal for shingles equal up to case; exact words are compared later."""
    return F.xxhash64(F.lit(width), *[F.lower(F.get(words, at + i)) for i in range(width)])


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (``_window``, ``_text``, ``_m``) and the items of each (``_window``, ``_item``)."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("_item"), _words(fold_case(F.col("text"))).alias("_words")
    ).filter(F.size("_words") > 0)
    m = F.least(F.size("_words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("_words") - m + 1)
    cut = items.select("_item", "_words", m.alias("_m"), F.explode(starts).alias("_at")).select(
        "_item", "_m", F.array_join(F.slice("_words", F.col("_at"), F.col("_m")), " ").alias("_text")
    )
    # a window is named by its text, so neither windows nor the items of one ever meet in one row
    name = F.substring(F.unhex(F.sha2(F.col("_text").cast("binary"), 256)), 1, 16).alias("_window")
    owners = written(cut.select(name, "_item", "_m", "_text").distinct(), "windows")
    return owners.select("_window", "_text", "_m").distinct(), owners.filter("_item IS NOT NULL").select("_window", "_item")


def _item_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """A row per window and shingle: ``_window``, ``_offset``, ``_width``, ``_hash``."""
    split = windows.select("_window", "_m", F.split("_text", " ").alias("_words"))
    width = F.least(F.col("_m"), F.lit(shingle))
    rows = split.select(
        "_window", "_words", width.alias("_width"), F.explode(F.sequence(F.lit(0), F.col("_m") - width)).alias("_offset")
    )
    by_width = F.lit(None).cast("bigint")
    for w in range(1, shingle + 1):
        by_width = F.when(F.col("_width") == w, _shingle(F.col("_words"), F.col("_offset"), w)).otherwise(by_width)
    return rows.select("_window", "_offset", "_width", by_width.alias("_hash"))


def _document_shingles(documents: DataFrame, widths: list[int]) -> DataFrame:
    """A row per document at ``_at`` -1 and one per shingle; ``_words`` goes along unshuffled."""
    text = F.col("text").cast("string")
    docs = documents.select(
        F.col("doc_id"), F.xxhash64(F.lit(7), text).alias("_print"), _words(text).alias("_words")
    )
    size = F.size("_words")
    placed = docs.select(
        "doc_id", "_print", "_words", F.explode(F.sequence(F.lit(-1), size - 1)).alias("_at")
    )
    at = F.col("_at")

    def hashed(width: int) -> Column:
        return F.when((at >= 0) & (at + width <= size), _shingle(F.col("_words"), at, width))

    if len(widths) == 1:
        return placed.withColumn("_hash", hashed(widths[0])).filter((at < 0) | F.col("_hash").isNotNull())
    found = F.when(at < 0, F.array(F.lit(None).cast("bigint"))).otherwise(
        F.array_compact(F.array(*[hashed(w) for w in widths]))
    )
    return placed.withColumn("_hash", F.explode(found))


def find_items(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """Words and items each document shares with the benchmark.

    Reads ``doc_id`` and ``text`` of documents, ``item_id`` and ``text`` of the benchmark; other
    columns are ignored. Returns ``doc_id``, ``n_words``, ``n_hit`` (words inside a window that
    occurs), ``n_items``, ``items`` (their ids as sorted strings), ``starts`` (first words of the
    windows found, with their lengths).

    A null or empty text has no words and no hits. Items without words are passed over; an item
    without an id hits words but is not listed. Repeated rows give one row each; rows that
    share a doc_id but not a text are kept apart. With an empty benchmark nothing is hit.
    """
    windows, owners = item_windows(benchmark, window)
    shingles = written(_item_shingles(windows, shingle), "item-shingles")
    n_shingles = shingles.count()
    widths = sorted(row[0] for row in shingles.select("_width").distinct().collect()) or [shingle]

    if n_shingles > BROADCAST_ROWS:
        return _collected(_hits_by_place(documents, windows, shingles, widths), owners)
    rows = _document_shingles(documents, widths)
    known = F.broadcast(shingles.select("_hash").distinct())
    prefixes = written(_prefixes(windows, shingles, rows.join(known, "_hash")), "prefixes")
    joined = rows.join(F.broadcast(prefixes), "_hash", "left")
    start = F.col("_at") - F.col("_offset")
    size = F.size("_words")
    same = F.col("_text") == fold_case(F.array_join(F.slice("_words", start + 1, F.col("_m")), " "))
    fits = (F.col("_at") >= 0) & (start >= 0) & (start + F.col("_m") <= size)
    base = F.col("_at") < 0
    kept = joined.filter(base | (F.when(fits, same).otherwise(F.lit(False)))).select(
        "doc_id", "_print", size.alias("_size"), base.alias("_base"),
        F.when(~base, F.struct(start.alias("at"), F.col("_m").alias("m"))).alias("_span"),
        F.when(~base, F.col("_window")).alias("_window"),
    )
    grouped = kept.groupBy("doc_id", "_print").agg(
        F.max("_size").cast("bigint").alias("n_words"),
        F.count(F.when(F.col("_base"), 1)).alias("_copies"),
        F.array_sort(F.collect_set("_span")).alias("starts"),
        F.collect_set("_window").alias("_windows"),
    )
    return _collected(grouped, owners)


def _prefixes(windows: DataFrame, shingles: DataFrame, met: DataFrame) -> DataFrame:
    """Each window with its rarest shingle; ``met`` are the documents' shingles (``_hash``) that windows have."""
    rarity = met.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    # a window with a shingle that no document has cannot occur
    ranked = shingles.join(rarity, "_hash", "left").groupBy("_window").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_offset", "_hash")).alias("_rarest")
    )
    return ranked.filter(F.col("_rarest.n") > 0).join(windows, "_window").select(
        "_window", "_text", "_m", F.col("_rarest._offset").alias("_offset"), F.col("_rarest._hash").alias("_hash")
    )


def _hits_by_place(
    documents: DataFrame, windows: DataFrame, shingles: DataFrame, widths: list[int]
) -> DataFrame:
    """What is found per document and text where the windows are too many to be broadcast.

    Shingles are shuffled as places, without words. Words are looked up for the few places where a window's rarest
    shingle stands, once for each document and text; documents without any take no part in that.
    """
    places = _document_shingles(documents, widths).filter("_at >= 0").select("doc_id", "_print", "_at", "_hash")
    prefixes = written(_prefixes(windows, shingles, places.join(shingles.select("_hash").distinct(), "_hash")), "prefixes")
    start = (F.col("_at") - F.col("_offset")).alias("_start")
    found = places.join(prefixes, "_hash").select("doc_id", "_print", start, "_m", "_window", "_text").filter("_start >= 0")
    found = written(found.distinct(), "places")

    text = F.col("text").cast("string")
    docs = documents.select("doc_id", F.xxhash64(F.lit(7), text).alias("_print"), _words(text).alias("_words"))
    ids = found.select(F.col("doc_id").alias("_id"), F.col("_print").alias("_of")).distinct()
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_of"))
    wanted = docs.join(ids, own, "left_semi").dropDuplicates(["doc_id", "_print"])
    wanted = wanted.withColumnsRenamed({"doc_id": "_id", "_print": "_of"})
    same = F.col("_text") == fold_case(F.array_join(F.slice("_words", F.col("_start") + 1, F.col("_m")), " "))
    hits = found.join(wanted, own).filter((F.col("_start") + F.col("_m") <= F.size("_words")) & same)
    hits = hits.groupBy("doc_id", "_print").agg(
        F.array_sort(F.collect_set(F.struct(F.col("_start").alias("at"), F.col("_m").alias("m")))).alias("starts"),
        F.collect_set("_window").alias("_windows"),
    ).withColumnsRenamed({"doc_id": "_id", "_print": "_of"})
    whole = docs.groupBy("doc_id", "_print").agg(
        F.max(F.size("_words")).cast("bigint").alias("n_words"), F.count(F.lit(1)).alias("_copies")
    )
    empty = F.array().cast(hits.schema["starts"].dataType), F.array().cast(hits.schema["_windows"].dataType)
    return whole.join(hits, own, "left").select(
        "doc_id", "_print", "n_words", "_copies",
        F.coalesce("starts", empty[0]).alias("starts"), F.coalesce("_windows", empty[1]).alias("_windows"),
    )


def _collected(grouped: DataFrame, owners: DataFrame) -> DataFrame:
    """Words hit and items of each document and text, a row for each copy."""
    ends = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["hit"] + F.greatest(F.lit(0), x["at"] + x["m"] - F.greatest(s["end"], x["at"]))).alias("hit"),
            F.greatest(s["end"], x["at"] + x["m"]).alias("end"),
        ),
        lambda s: s["hit"].cast("bigint"),
    )
    listed = grouped.withColumn("n_hit", ends).withColumn("_window", F.explode_outer("_windows"))
    listed = listed.join(broadcast_if(owners, owners.count(), BROADCAST_ROWS), "_window", "left")
    per_text = listed.groupBy("doc_id", "_print").agg(
        F.max("n_words").alias("n_words"), F.max("n_hit").alias("n_hit"), F.max("_copies").alias("_copies"),
        F.max("starts").alias("starts"), F.array_sort(F.collect_set("_item")).alias("items"),
    )
    return per_text.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", "starts"
    )


def report(found: DataFrame) -> DataFrame:
    """The digest columns of what ``find_items`` found."""
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
