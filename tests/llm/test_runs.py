"""Periodic runs against brute force."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from crossbasket.llm import runs

FOLDER = "/root/testdata/sf0.001"


def brute_runs(words, min_length=6, min_exponent=4):
    found = []
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            if size >= max(min_length, min_exponent * q):
                part = words[start : start + size]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    found.append((start, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(w)
    gone = set()
    for s, size, q in found:
        gone.update(range(s + q, s + size))
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (
        doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def lyndon_words(word):
    out = []
    for i in range(len(word)):
        j = i + 1
        while j < len(word) and word[j:] > word[i:]:
            j += 1
        out.append(j - i)
    return out


def sequences(count):
    rng = random.Random(4)
    for _ in range(count):
        w = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(1, 50))]
        if rng.random() < 0.5:
            w = w[: rng.randint(0, 9)] + w[: rng.randint(1, 7)] * rng.randint(2, 8) + w[: rng.randint(0, 9)]
        yield w


def test_lyndon_arrays_under_both_orders():
    for w in sequences(400):
        assert runs.lyndon_array(np.array(w)).tolist() == lyndon_words(w)
        assert runs.lyndon_array(-np.array(w)).tolist() == lyndon_words([-x for x in w])


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (1, 3), (6, 5)])
def test_runs_of_random_sequences(least):
    for w in sequences(400):
        assert [tuple(r) for r in runs.find_runs(np.array(w), *least).tolist()] == brute_runs(w, *least), w


def test_fingerprints_that_collide_change_nothing(monkeypatch):
    monkeypatch.setattr(runs, "_PRIMES", (3, 3))
    monkeypatch.setattr(runs, "_BASES", (1, 1))
    for w in sequences(300):
        assert [tuple(r) for r in runs.find_runs(np.array(w), 2, 2).tolist()] == brute_runs(w, 2, 2), w


def test_long_sequences_take_linear_time():
    assert runs.find_runs(np.zeros(500_000, np.int64)).tolist() == [[0, 500_000, 1]]
    assert runs.find_runs(np.arange(500_000) % 999).tolist() == [[0, 500_000, 999]]


def test_kept_words():
    w = list("xabababababy")
    found = runs.find_runs(np.array([ord(c) for c in w]))
    assert "".join(np.array(w)[runs.kept_words(len(w), found)]) == "xaby"


def test_report_of_awkward_texts(spark, awkward, nothing, rows):
    got = rows(runs.report(awkward))
    expected = [brute_report(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    assert got == sorted(expected, key=lambda r: [(v is None, str(v)) for v in r])
    assert runs.report(nothing).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_report_of_the_documents(spark, rows):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    expected = [brute_report(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect() if len(r["text"] or "") < 40_000]
    ids = {r[0] for r in expected}
    assert [r for r in rows(runs.report(documents)) if r[0] in ids] == sorted(
        expected, key=lambda r: [(v is None, str(v)) for v in r]
    )
