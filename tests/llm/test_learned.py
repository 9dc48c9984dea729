"""Operators that learn: languages, toxicity, secrets, personal data."""

import hashlib
import os
import random
import re
import string
import zlib

import numpy as np
import pytest

from crossbasket.llm import languages, personal, secrets, toxicity
from crossbasket.llm.shared import table

SMALL = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"  # its labels hold enough toxic texts to learn from
with_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def held_out(doc_id, divisor, remainder):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % divisor == remainder


# --- languages


@with_tables
def test_languages_are_told_apart_on_held_out_rows(spark):
    df = table(spark, SMALL, "documents")
    rows = languages.report(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_languages_of_awkward_rows(awkward, nothing):
    rows = languages.report(awkward).collect()
    texts = sorted(((r["doc_id"], r["text"]) for r in awkward.collect()), key=str)
    assert sorted((r["doc_id"] for r in rows), key=str) == [x[0] for x in texts]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == held_out(r["doc_id"], 4, 2) for r in rows)
    blank = {0, 1, 2}
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (r["doc_id"] in blank), r
    assert languages.report(nothing).collect() == []
    assert {r["lang_pred"] for r in languages.identify(awkward, {}).collect()} == {"und"}


def test_bundles_equal_the_sum_of_bound_letters():
    def slow(text, d=64):
        total = np.zeros(d)
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            points = [0, *map(ord, word), 0]
            for a, b, c in zip(points, points[1:], points[2:]):
                v = [languages.letter_vector(p, d) for p in (a, b, c)]
                total += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        return total

    texts = ["The cat, the hat", "Été à l'île 12 x", "", "a"]
    np.testing.assert_allclose(languages.bundles(texts, 64), [slow(t) for t in texts])


def test_predictions_equal_cosines_of_slow_bundles(spark):
    d = languages.DIMENSIONS

    def slow(text):
        total = np.zeros(d)
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            points = [0, *map(ord, word), 0]
            for a, b, c in zip(points, points[1:], points[2:]):
                v = [languages.letter_vector(p, d).astype(float) for p in (a, b, c)]
                total += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        return total

    rng = random.Random(4)
    words = {
        "en": "the time and river of stone under light in morning".split(),
        "fr": "le temps et la rivière de pierre sous lumière à l'été".split(),
        "ru": "время и река под камень в утро свет".split(),
    }
    rows = [(i, " ".join(rng.choices(words[lang], k=8)), lang) for i, lang in enumerate(list(words) * 12)]
    rows += [(100, None, "en"), (101, "12 + 3", "fr"), (102, "the rivière under the pierre", None), (103, "REKA river", "ru"), (104, "", "zz")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    learned = {}
    for doc_id, text, lang in rows:
        if lang and not held_out(doc_id, 4, 2):
            learned[lang] = learned.get(lang, 0) + slow(text)
    learned = {lang: v / np.linalg.norm(v) for lang, v in learned.items() if np.any(v)}
    texts = {doc_id: text for doc_id, text, _ in rows}
    for r in languages.report(documents).collect():
        own = slow(texts[r["doc_id"]])
        if not own.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        cosines = {lang: own @ v / np.linalg.norm(own) for lang, v in learned.items()}
        best = max(cosines, key=cosines.get)
        assert r["lang_pred"] == best
        assert r["score"] == pytest.approx(min(max(cosines[best], 0), 1), abs=1e-5)


# --- toxicity


@with_tables
def test_toxicity_on_held_out_rows(spark):
    df, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    rows = toxicity.report(df, labels).join(labels, "doc_id").filter("held_out").collect()
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert np.mean(clean) < 0.02
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.97
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) > 0.8


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 1), (9, 0, 0), (None, 0, 1), (16, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.report(awkward, labels).collect()
    assert len(rows) == awkward.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert {r["score"] for r in toxicity.report(awkward, labels.limit(0)).collect()} == {0.0}
    assert toxicity.report(nothing, labels).collect() == []


def test_tokens_are_read_through_masks():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "lowei*": 4.0})
    for token, weight in (("idiot,", 5.0), ("1d1ot", 5.0), ("i.d-i_o*t", 5.0), ("loweischaft", 4.0), ("idioooot", 5.0), ("idio", 0.0)):
        assert lexicon._read(token).weight == weight, token
    near = lexicon.features("well you total idiot here")
    far = lexicon.features("you " + "word " * 20 + "idiot")
    index = 5
    assert near[index] > 0 and far[index] == 0


def test_isotonic_is_the_pooled_monotone_fit():
    upto, level = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5, 5]), np.array([0.0, 1, 0, 1, 1, 0]))
    assert np.all(np.diff(level) >= 0)
    at = np.minimum(np.searchsorted(upto, [1, 2, 3, 4, 5]), len(level) - 1)
    np.testing.assert_allclose(level[at], [0, 0.5, 0.5, 2 / 3, 2 / 3])


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    rows = rng.random((3000, 4))
    labels = ((rows[:, 0] > 0.5) & (rows[:, 2] > 0.3)).astype(float)
    trees = toxicity.grow(rows[:2000], labels[:2000])
    assert np.mean((toxicity.raw_scores(trees, rows[2000:]) > 0) == labels[2000:]) > 0.97


def test_rare_toxic_words_are_learned_from_all_labelled_texts(spark):
    rng = random.Random(5)
    words = "call the river under morning light or write to window garden".split()

    def filler():
        return " ".join(rng.choice(words) for _ in range(30))

    # one label in 250 is toxic: a uniform sample of 300 holds about one of the twelve
    rows = [(i, f"{filler()} {'you vrelk' if i % 250 == 7 else ''} {filler()}", int(i % 250 == 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    classifier = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"), fit_rows=300)
    assert "vrelk" in classifier.weights
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, classifier).collect()}
    assert all(found[i] == toxic for i, _, toxic in rows)


def test_weighted_rows_count_as_often_as_they_stand_for():
    scores, labels, weights = np.array([1.0, 2, 3]), np.array([0.0, 1, 0]), np.array([1.0, 1, 3])
    upto, level = toxicity.isotonic(scores, labels, weights)
    np.testing.assert_allclose(level[np.searchsorted(upto, scores)], [0, 0.25, 0.25])


# --- secrets

ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def secret_base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return (*[sum(k == x[1] for x in spans) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest(), joined)


def test_secrets_of_awkward_rows(awkward, nothing):
    rows = secrets.find_secrets(awkward).collect()
    got = sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows), key=str)
    assert got == sorted(((r["doc_id"], *secret_base(r["text"])[:4]) for r in awkward.collect()), key=str)
    assert sum(r["n_access"] for r in rows) == 1  # a key without digits
    assert secrets.find_secrets(nothing).collect() == []


@with_tables
def test_markov_models_tell_random_strings_from_identifiers(spark):
    ratios = secrets.log_ratios(*secrets.transition_counts(table(spark, SMALL, "documents")))
    rng = random.Random(3)
    alphabet = string.ascii_letters + string.digits
    tokens = ["".join(rng.choices(alphabet, k=rng.randint(20, 40))) + "7a" for _ in range(300)]
    found = [secrets.scan(f"see {token} there", ratios) for token in tokens]
    assert np.mean([spans == [(4, 3, 4 + len(t), t)] for spans, t in zip(found, tokens)]) > 0.95
    for plain in ("getUserAccountById2Handler", "the-quick-brown-fox-2021", "version-10-release-notes", "1234567890123456"):
        assert secrets.scan(plain, ratios) == []


@with_tables
def test_random_strings_of_any_length_and_without_digits_are_found(spark):
    df = table(spark, LARGER, "documents")
    ratios = secrets.log_ratios(*secrets.transition_counts(df))
    limits = secrets.thresholds(secrets.score_counts(df, ratios))
    rng = random.Random(6)
    for alphabet in (string.ascii_letters + string.digits, string.ascii_letters):
        for length in (8, 10, 12, 16, 20, 40):
            tokens = ["".join(rng.choices(alphabet, k=length)) for _ in range(200)]
            found = [secrets.scan(f"see {token} there", ratios, limits) for token in tokens]
            assert np.mean([(4, 3, 4 + len(t), t) in spans for spans, t in zip(found, tokens)]) > 0.85, length
    for plain in ("getUserAccountById2Handler", "the-quick-brown-fox-2021", "version-10-release-notes", "1234567890123456"):
        assert secrets.scan(plain, ratios, limits) == []


@with_tables
def test_short_and_letter_only_secrets_are_reported_and_words_are_not(spark):
    df = table(spark, SMALL, "documents").select("doc_id", "text")
    planted = ["xK3qZw9TpR", "qXzKvJwPtGhBxWzQ", "Zq8Jx2Wv"]
    rows = [(-1 - i, f"he wrote {value} on it") for i, value in enumerate(planted)]
    spans = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(df.union(spark.createDataFrame(rows, df.schema))).collect()}
    assert [spans[-1 - i] for i in range(3)] == [f"random:9:{9 + len(value)}" for value in planted]
    assert sum("random" in s for i, s in spans.items() if i >= 0) < 0.02 * df.count()


def test_thresholds_follow_the_other_runs_and_are_never_above_the_highest():
    counts = np.zeros((secrets.LENGTHS + 1, secrets._BINS), np.int64)
    assert set(secrets.thresholds(counts)) == {secrets.THRESHOLD}
    counts[10, 0], counts[10, 20], counts[20, 63] = 400_000, 5, 1
    limits = secrets.thresholds(counts)
    assert limits[5] == secrets.THRESHOLD
    assert limits[10] == limits[30] == 5.25  # of 400,005 runs four may reach it; five score 5 nats
    counts[20, 63] = 50  # random strings that no pattern marks
    assert secrets.thresholds(counts)[10] == 5.25
    counts[10, 47] = 5
    assert secrets.thresholds(counts)[10] == secrets.THRESHOLD


# --- personal data


def personal_base(text):
    text = text or ""
    kinds = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    return [
        (k, m.start(), m.end()) for k, p in enumerate(kinds) for m in re.finditer(p, text) if personal.valid(k, m[0])
    ]


@pytest.mark.parametrize("seed", range(3))
def test_shapes_equal_the_plain_patterns(seed):
    rng = random.Random(seed)
    parts = ["a", "b@", "@", ".", "c.d", "1", "22", "333", "256.", "10.0.0.1", "+1 (", ")", " ", "-", "4111 1111", "_", "%", "é", "+"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert personal.base_spans(text) == personal_base(text), text


def test_personal_data_of_awkward_rows(awkward, nothing):
    rows = personal.find_personal(awkward, None).collect()
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["spans"]) for r in rows), key=str)
    expected = []
    for r in awkward.collect():
        spans = personal_base(r["text"])
        joined = ",".join(f"{personal.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        expected.append((r["doc_id"], *[sum(x[0] == k for x in spans) for k in range(4)], joined))
    assert got == sorted(expected, key=str)
    assert personal.fit(nothing) is None
    assert personal.report(nothing).collect() == []


def test_gradients_of_the_crf_are_right():
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(5, 3, personal.TAGS))
    moves = rng.normal(size=(personal.TAGS, personal.TAGS))
    tags = np.array([[0, 1, 0], [1, 2, 0], [2, 2, 3], [0, 0, 4], [0, 5, 4]])
    loss, d_scores, d_moves = personal._crf_gradient(scores, tags, moves)
    for index in ((0, 0, 0), (2, 1, 2), (4, 2, 4)):
        moved = scores.copy()
        moved[index] += 1e-5
        assert (personal._crf_gradient(moved, tags, moves)[0] - loss) / 1e-5 == pytest.approx(d_scores[index], abs=1e-3)
    for index in ((0, 0), (1, 2), (0, 3)):
        moved = moves.copy()
        moved[index] += 1e-5
        assert (personal._crf_gradient(scores, tags, moved)[0] - loss) / 1e-5 == pytest.approx(d_moves[index], abs=1e-3)


@pytest.fixture(scope="module")
def network():
    rng = random.Random(4)
    words = "call the river under morning light or write to window garden".split()

    def filler():
        return " ".join(rng.choice(words) for _ in range(rng.randint(4, 12)))

    windows = []
    for i in range(260):
        phone = f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        value = [phone, f"{rng.choice(words)}.{rng.randint(1, 99)}@mail{rng.randint(0, 9)}.example.com", str(rng.randint(1, 2000))][i % 3]
        windows += personal.labelled_windows(f"{filler()} {value} {filler()}")
    return personal.train(*personal.training_arrays(windows), epochs=14)


def test_the_network_finds_what_no_pattern_names(network):
    text = "under the morning light (212) 555-0187 or write to the window garden"
    assert personal.base_spans(text) == []
    (spans,) = personal.model_spans(network, [(text, [])])
    assert [(k, text[s:e]) for k, s, e in spans] == [(3, "(212) 555-0187")]


def test_spans_across_windows_are_found_once(network):
    for shift in range(0, personal.WINDOW, 7):
        text = "river " * 10 + "x" * shift + " call (212) 555-0187 or write " + "garden " * 20
        (spans,) = personal.model_spans(network, [(text, [])])
        assert len([s for s in spans if text[s[1] : s[2]] == "(212) 555-0187"]) == 1


@pytest.fixture(scope="module")
def spelling_network():
    rng = random.Random(8)
    words = "call the river under morning light or write to window garden at home point by dot".split()

    def filler():
        return " ".join(rng.choice(words) for _ in range(rng.randint(4, 12)))

    windows = []
    for i in range(600):
        value = [
            f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
            f"{rng.choice(words)}.{rng.choice(words)}@{rng.choice(words)}.example.com",
            ".".join(str(rng.randint(1, 255)) for _ in range(4)),
            f"{rng.randint(1, 2000)} at {rng.choice(words)}",
        ][i % 4]
        windows += personal.labelled_windows(f"{filler()} {value} {filler()}")
    return personal.train(*personal.training_arrays(windows), epochs=12)


@pytest.mark.parametrize(
    "kind, value",
    [
        (0, "anna.river (at) garden dot com"), (0, "anna.river [at] garden.example.com"), (0, "anna.river at garden dot com"),
        (0, "anna.river@garden\uff0eexample.com".replace("@", "\uff20")), (1, "10[.]20[.]30[.]44"),
        (1, "\uff11\uff10.20.30.44"), (3, "(\uff12\uff11\uff12) \uff15\uff15\uff15-\uff10\uff11\uff18\uff17"),
        (3, "\u0662\u0661\u0662-\u0665\u0665\u0665-\u0660\u0661\u0668\u0667"),
    ],
)
def test_spelled_addresses_and_other_digits_are_found(spelling_network, kind, value):
    assert personal.acceptable(kind, value)
    text = f"under the morning light {value} or write to the window garden"
    assert personal.base_spans(text) == []
    base, more = personal.find([text], np.array([], int), spelling_network)
    assert [(k, text[s:e]) for k, s, e in more[0]] == [(kind, value)]


def test_words_for_at_and_dot_alone_are_no_address(spelling_network):
    texts = ["we met at home under the river at morning light", "the point at the garden dot by the window", "call at 9 or at 10 under light"]
    base, more = personal.find(texts, np.array([2]), spelling_network)
    assert base == more == [[], [], []]
    assert not personal.acceptable(0, "met at home") and not personal.acceptable(0, "no at 12.5 or")


def test_redaction_merges_overlaps():
    assert personal.redact("ab cd ef", [(0, 0, 2), (3, 3, 5), (2, 4, 8)]) == "<EMAIL> <PHONE>"
    assert personal.redact("abc", []) == "abc"


def test_redacted_rows_keep_their_columns(awkward):
    clean = personal.redacted(awkward, None)
    assert clean.columns == awkward.columns
    rows = {r["doc_id"]: r for r in clean.collect()}
    assert rows[13]["text"] == "Mail <EMAIL>, ip <IP> or 10.0.0.256, card <CARD> and <PHONE>."
    assert rows[13]["n_chars"] == len(rows[13]["text"]) and rows[0]["text"] is None and rows[0]["label"] == "clash"
