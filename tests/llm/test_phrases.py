"""Collocations against brute force and SQL."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from crossbasket.llm import phrases

duckdb = pytest.importorskip("duckdb")

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(documents, min_count, max_words, top):
    counts, total = {}, Counter()
    for text, lang in documents:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, max_words + 1):
                for s in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[s : s + m])] += 1
    out = []
    for lang, found in counts.items():
        n = total[lang]
        candidates = {p: f for p, f in found.items() if len(p) > 1 and f >= min_count}
        rows = []
        for p, a in candidates.items():
            around = [
                f for q, f in candidates.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if any(100 * f >= 100 * a for f in around):
                continue
            cuts = [(1000 * a * n // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((score, a, " ".join(p), found[p[:k]], found[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n, score) for i, (score, a, p, l, r) in enumerate(rows[:top])]
    return sorted(out)


def some_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Of", "new", "york", "city", "a", "é", "中文", "b\x01", "b", "\x00", "x-y", "(z)"] + [f"w{i}" for i in range(90)]
    for _ in range(n):
        words = [rng.choice(vocabulary[: rng.choice([4, 10, 104])]) for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", ", ", ".", "\n", " "]) for w in words)
        yield text, rng.choice(["en", "en", "en", "fr", None, "und"])


@pytest.fixture(scope="module")
def documents(spark):
    rows = [*some_texts(1, 300), (None, "en"), ("", None), ("the " * 3000, "en"), ("..,;\n", "fr"), ("York", "xx")]
    frame = spark.createDataFrame([(t, l, 1, "c", b"d") for t, l in rows], "text string, lang string, f int, word string, phrase binary")
    return rows, frame.repartition(3)


LIMITS = [((4, 5, 2000), {}), ((2, 3, 7), {}), ((12, 2, 2000), {}), ((20, 5, 2000), {"shard_words": 60, "shard_phrases": 40})]


@pytest.mark.parametrize("rule, limits", LIMITS)
def test_against_brute_force(documents, rule, limits):
    rows, frame = documents
    got = phrases.collocations(frame, *rule, **limits).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, *rule)


def test_tasks_that_hold_few_pairs(monkeypatch):
    monkeypatch.setattr(phrases, "_HELD", 8)
    keys = [np.array(k) for k in ([5, 5, 1], [9] * 30, range(20), [1, 2], [7])]
    total = Counter()
    for found, counts in _summed_parts(keys):
        for key, n in zip(found.tolist(), counts.tolist()):
            total[key] += n
    assert total == Counter(np.concatenate(keys).tolist())


def _summed_parts(keys):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([k.astype(np.int32)], pa.list_(pa.int32()))], names=["words"]) for k in keys]
    return phrases._summed(iter(batches), lambda numbers: numbers.astype(np.int64))


def test_double_array_holds_its_phrases_and_no_other():
    rng = np.random.default_rng(2)
    for n_words in (3, 64, 65, 5000, 300_000):
        matrices = [np.unique(rng.integers(0, n_words, (400, k)) ** 2 % n_words, axis=0) for k in (2, 3, 5)]
        trie = phrases.double_array(matrices, n_words)
        known, number = {}, 0
        for matrix in matrices:
            for row in matrix.tolist():
                known[tuple(row)] = number
                number += 1
        words = np.concatenate([np.append(m, -np.ones((len(m), 1), int), axis=1).ravel() for m in matrices]).astype(np.int32)
        words = np.append(words, rng.integers(-1, min(n_words, 70), 500)).astype(np.int32)
        places = phrases.Places(trie, words)
        for length in range(1, 6):
            places.further()
            found = dict(zip(places.at.tolist(), places.accepted().tolist()))
            for at in range(len(words) - length + 1):
                assert found.get(at, -1) == known.get(tuple(words[at : at + length].tolist()), -1)


def test_scores_beyond_64_bits(spark):
    candidates = spark.createDataFrame([(bytes(8), "en", 10**14, 10**15)], "phrase binary, lang string, a long, n long")
    parts = spark.createDataFrame([(bytes(4), 3 * 10**14 + 1)], "phrase binary, f long")
    row = phrases._scored(candidates, parts).first()
    assert row["score"] == 1000 * 10**14 * 10**15 // (3 * 10**14 + 1) ** 2


def test_awkward_and_empty_tables(awkward, nothing):
    rows = [(r["text"], r["lang"]) for r in awkward.select("text", "lang").collect()]
    got = sorted(tuple(r) for r in phrases.collocations(awkward, 3).collect())
    assert got == brute(rows, 3, 5, 2000)
    assert phrases.collocations(nothing).collect() == []
    assert phrases.collocations(awkward, 10**9).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_sql_twin(spark):
    connection = duckdb.connect()
    connection.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in phrases.collocations(documents, 5).collect())
    assert got and got == sorted(connection.execute(phrases.oracle_sql(5)).fetchall())
    connection.close()
