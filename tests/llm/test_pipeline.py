import hashlib
import os
import re
import struct

import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import __spark_entry__ as driver
import corpus_pipeline
from crossbasket.llm import decontaminate, near_duplicates, quality
from crossbasket.llm.shared import table, written

SMALLEST = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")


def test_stages_and_registration():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "MinHash near-dedup", "benchmark decontamination", "PII", "byte-level BPE",
    ]
    names = driver.queries()
    assert "pipeline" in names
    assert sorted(n for n in names if n.startswith("op")) == sorted(
        [f"op{i}_{n}" for i, n in enumerate(
            "decontaminate token_counts near_duplicates shards quality languages personal byte_bpe toxicity secrets collocations url_filter periodic_runs".split(), 1
        )]
    )


def test_each_stage_keeps_what_its_operator_keeps(spark):
    docs = table(spark, SMALLEST, "documents")
    expected = {r["doc_id"] for r in quality.report(docs).filter("kept").collect()}
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = written(stage(spark, docs, SMALLEST), f"test-{number}")
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
        if number == 1:
            expected = {r["doc_id"] for r in near_duplicates.near_duplicates(before).filter("kept").collect()}
        if number == 2:
            found = decontaminate.find_items(before, table(spark, SMALLEST, "benchmark"))
            expected = {r["doc_id"] for r in found.filter("n_hit = 0").collect()}
        assert set(ids) == expected
        if number < 4:
            assert docs.columns == columns
    assert set(docs.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_one_row_stays_of_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(1, text), (1, text), (2, text), (3, None), (3, "other words stand here all alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SMALLEST).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)


def hits_benchmark(spark, folder):
    """Whether a text holds a window of an item, in plain Python."""

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))

    items = [words(r["text"]) for r in table(spark, folder, "benchmark").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}

    def hit(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    return hit


FOLD = {c: c + 32 for c in range(65, 91)}
LARGE = {c + 32: c for c in range(65, 91)}


def similar_groups(texts):
    """The smallest id of each document's group, by comparing all sets of five-word shingles."""

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(text) for i, text in texts.items()}
    first = {i: i for i in texts}

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b]) if a < b else 0
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root(a), root(b)))
                first[high] = low
    return {i: root(i) for i in texts}


def test_stages_equal_brute_force(spark):
    """Near duplicates by all pairs, benchmark windows one by one, tokens by the library; planted copies and passages."""
    docs = table(spark, SMALLEST, "documents")
    rows = docs.collect()
    top = max(r["doc_id"] for r in rows) + 1
    item = max((r["text"] or "" for r in table(spark, SMALLEST, "benchmark").collect()), key=len)
    long = [r for r in rows if len((r["text"] or "").split()) > 30][:6]
    planted = [r.asDict() | {"doc_id": top + i, "text": r["text"].translate(LARGE)} for i, r in enumerate(long[:2])]
    planted += [r.asDict() | {"doc_id": top + 2 + i, "text": r["text"] + " more"} for i, r in enumerate(long[2:4])]
    planted += [r.asDict() | {"doc_id": top + 4 + i, "text": f"{r['text']} {item} {r['text']}"} for i, r in enumerate(long[4:])]
    docs = written(docs.unionByName(spark.createDataFrame([tuple(p[c] for c in docs.columns) for p in planted], docs.schema)), "planted")

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    unique = written(corpus_pipeline.near_duplicate_stage(spark, docs, SMALLEST), "unique")
    kept = {r["doc_id"] for r in unique.collect()}
    assert kept == {i for i, group in similar_groups(texts).items() if i == group}
    assert not kept & set(range(top, top + 4))

    hit = hits_benchmark(spark, SMALLEST)
    clean = written(corpus_pipeline.decontamination_stage(spark, unique, SMALLEST), "clean")
    left = {r["doc_id"] for r in clean.collect()}
    assert left == {i for i in kept if not hit(texts[i])}
    assert not left & {top + 4, top + 5}

    bpe = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    )
    for r in corpus_pipeline.token_stage(spark, clean, SMALLEST).collect():
        text = texts[r["doc_id"]] or ""
        ids = bpe.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_with_awkward_rows_and_clashing_columns(spark, awkward):
    clashing = awkward.selectExpr(
        "*", "1 AS _kept", "2 AS _hit", "'x' AS id", "named_struct('doc_id', 5) AS row", "5 AS `print`", "6 AS n", "'q' AS n_tokens_"
    )
    columns = clashing.columns
    hit = hits_benchmark(spark, SMALLEST)
    docs = clashing
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = written(stage(spark, docs, SMALLEST), f"awkward-{number}")
        rows = docs.collect()
        if number < 4:
            assert docs.columns == columns, name
            assert all(r["_kept"] == 1 and r["row"]["doc_id"] == 5 for r in rows)
        if number == 2:
            gone = {r["doc_id"] for r in before if hit(r["text"])}
            assert sorted(map(str, rows)) == sorted(str(r) for r in before if r["doc_id"] not in gone)
        if number >= 3:
            assert len(rows) == len(before)


def test_each_stage_takes_all_awkward_rows(spark, awkward):
    assert corpus_pipeline.near_duplicate_stage(spark, awkward, SMALLEST).filter("text IS NULL").count() == 2
    redacted = corpus_pipeline.personal_stage(spark, awkward, SMALLEST)
    assert redacted.columns == awkward.columns and redacted.count() == awkward.count()
    assert redacted.filter("text IS NULL").count() == awkward.filter("text IS NULL").count()
    assert corpus_pipeline.token_stage(spark, awkward, SMALLEST).count() == awkward.count()
    assert corpus_pipeline.decontamination_stage(spark, awkward, SMALLEST).filter("text IS NULL").count() == 2


def test_empty_tables_go_through(spark, nothing):
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, nothing, SMALLEST)
        assert docs.collect() == []
        assert number == 4 or docs.columns == nothing.columns
