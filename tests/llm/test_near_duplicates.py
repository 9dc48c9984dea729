import random
import re

import numpy as np
import pytest

from crossbasket.llm import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(documents):
    sets = [shingles(text) for _, text in documents]
    group = list(range(len(documents)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                group[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(documents):
        ids = [documents[j][0] for j in range(len(documents)) if root(j) == root(i)]
        smallest = min((x for x in ids if x is not None), default=None)
        out.append((doc_id, len(sets[i]), smallest, doc_id == smallest))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in near_duplicates.near_duplicates(df).collect()), key=str)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_equals_brute_force_on_awkward_rows(awkward):
    assert run(awkward) == brute(rows_of(awkward))


def test_empty_table(nothing):
    assert run(nothing) == []


@pytest.fixture(scope="module")
def families(spark):
    """Near copies in chains, and texts that share most of a passage without being similar enough."""
    rng = random.Random(7)
    made = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(6):
        text = [rng.choice(made) for _ in range(80)]
        for _ in range(12):
            rows.append(" ".join(text))
            text = list(text)
            text[rng.randrange(80)] = rng.choice(made)
    passage = [rng.choice(made) for _ in range(60)]
    rows += [" ".join(passage + [rng.choice(made) for _ in range(rng.choice([6, 10, 14, 18]))]) for _ in range(60)]
    rng.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)


def test_chains_and_shared_passages(families):
    expected = brute(rows_of(families))
    assert run(families) == expected
    assert len({r[2] for r in expected}) < len(expected)


def test_prefixes_from_the_start_lose_no_link(families, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(near_duplicates, "COMMON_FROM", 2)
    monkeypatch.setattr(near_duplicates, "COMMON_SHINGLES", 100)
    got = near_duplicates.near_duplicates(families, hub_rounds=0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows_of(families))


def thue_morse(letters, n):
    return [letters[bin(i).count("1") % 2] for i in range(n)]


def test_words_and_sequences_made_to_collide(spark):
    """Under a polynomial modulo 2**64 each pair has one hash, whatever the base."""
    tail = " ".join(f"t{i}" for i in range(6))
    words = ["".join(thue_morse(letters, 2048)) for letters in ("ab", "ba")]
    texts = [f"{words[0]} {tail}", f"{words[1]} {tail}", words[0], words[1]]
    texts += [" ".join(thue_morse(letters, 4096)) for letters in (("x", "y"), ("y", "x"))]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert run(documents) == brute(rows_of(documents))


def test_classes_do_not_depend_on_white_space(spark):
    texts = ["a b c d e f", " a  b\tc d e f ", "A b c d e\x0bf\n", "a b c d ef", "abcdef"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert run(documents) == brute(rows_of(documents))
    names = near_duplicates._signatures(documents, 5, 4, 4).select("class").collect()
    assert len({bytes(r["class"]) for r in names}) == 3


def test_signatures_estimate_similarity():
    minhash = near_duplicates.CirculantMinHash(64, 4)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3000], rng.integers(0, 2**63, 1000).astype(np.uint64)])
    one, two = minhash.signature(a), minhash.signature(b)
    assert abs((one == two).mean() - 3000 / 5000) < 0.1
    sketches = [np.frombuffer(near_duplicates.sketch(s), np.uint8)[None, :] for s in (one, two)]
    assert abs(near_duplicates.agreeing(*sketches)[0] / 256 - (0.6 + 0.4 / 16)) < 0.1


def test_very_large_disjoint_sets_share_no_band():
    minhash = near_duplicates.CirculantMinHash(32, 4)
    rng = np.random.default_rng(2)
    keys = [minhash.band_keys(minhash.signature(rng.integers(0, 2**63, 1_000_000).astype(np.uint64))) for _ in range(2)]
    assert not set(keys[0].tolist()) & set(keys[1].tolist())


def test_the_second_permutation_is_one():
    numbers = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    for which in (0, 1):
        assert len(np.unique(near_duplicates._permuted(numbers.copy(), which))) == len(numbers)


def test_labels_after_further_links_are_those_of_all_links(spark):
    room = near_duplicates.Room(spark)

    def links(*pairs):
        return spark.createDataFrame(list(pairs), "a long, b long")

    first = links((2, 3), (4, 5), (5, 6), (24, 25))
    later = links((3, 6), (7, 8), (8, 1), (25, 26))
    got = near_duplicates._relabelled(room, near_duplicates.components(room, first), room.write(later, "later"))
    expected = near_duplicates.components(room, first.union(later))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in expected.collect()}
    assert got.count() == expected.count()


def test_hot_groups(spark):
    """A large group of near copies beside texts that share its passage, and very short texts."""
    rng = random.Random(3)
    made = [f"w{i}" for i in range(2000)]
    base = [rng.choice(made) for _ in range(60)]
    rows = []
    for _ in range(150):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2])):
            text[rng.randrange(60)] = rng.choice(made)
        rows.append(" ".join(text))
    rows += [" ".join(base[:45] + [rng.choice(made) for _ in range(rng.randint(5, 40))]) for _ in range(80)]
    rows += [" ".join(rng.choice(["a", "b"]) for _ in range(rng.randint(1, 9))) for _ in range(100)]
    rng.shuffle(rows)
    documents = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    expected = brute(rows_of(documents))
    assert run(documents) == expected
    assert sorted((tuple(r) for r in near_duplicates.near_duplicates(documents, hub_rounds=1).collect()), key=str) == expected
