import hashlib
import re

from crossbasket.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(documents, items):
    windows = []
    for item_id, text in items:
        w = words(text)
        m = min(len(w), 10)
        windows += [(item_id, w[i : i + m]) for i in range(len(w) - m + 1)] if w else []
    out = []
    for doc_id, text in documents:
        w, hit, ids = words(text), set(), set()
        for item_id, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    ids.add(item_id)
        listed = sorted(str(i) for i in ids if i is not None)
        digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(listed), digest, bool(hit)))
    return sorted(out, key=str)


def run(documents, benchmark):
    return sorted((tuple(r) for r in decontaminate.report(decontaminate.find_items(documents, benchmark)).collect()), key=str)


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.collect()]


def test_equals_brute_force_on_awkward_rows(awkward, benchmark):
    got = run(awkward, benchmark)
    assert got == brute(pairs(awkward, "doc_id"), pairs(benchmark, "item_id"))
    assert sum(r[5] for r in got) >= 6


def test_without_broadcast_the_result_is_the_same(awkward, benchmark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    assert run(awkward, benchmark) == brute(pairs(awkward, "doc_id"), pairs(benchmark, "item_id"))


def test_empty_tables(awkward, benchmark, nothing):
    assert run(nothing, benchmark) == []
    assert not any(r[5] for r in run(awkward, benchmark.limit(0)))
