"""Very long texts take time and memory in proportion."""

import random
import resource
import time

import numpy as np
import public_tokenizers
import pytest

from crossbasket.llm import languages, secrets, token_counts


def seconds(work):
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


@pytest.fixture(scope="module")
def encoder():
    return token_counts.ChunkedEncoder(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("text", ["a" * 300_000, "ab" * 90_000, "aab " * 60_000, "\n" * 50_000, "=-" * 50_000, "\U0001f600" * 40_000])
def test_tokens_of_texts_that_repeat_themselves(encoder, text):
    assert encoder.counts([text]) == [len(encoder.model.encode(text))]


def test_tokens_of_random_letters_with_small_chunks():
    small = token_counts.ChunkedEncoder(public_tokenizers.path("piece_bpe_32k.model"), 40, 5)
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(rng.choice(["ab ", "a", "thé中 \n", "\U0001f600x"])) for _ in range(rng.randint(1, 400)))
        assert small.encode_long(text).tolist() == small.model.encode(text)


def test_tokens_take_linear_time(encoder):
    assert seconds(lambda: encoder.counts(["a" * 5_000_000])) < 30


def test_secrets_among_very_many_base_spans():
    rng = random.Random(1)
    text = " ".join("%032x" % rng.getrandbits(128) for _ in range(100_000))
    ratios = np.zeros(secrets._STATES**2)
    found = []
    assert seconds(lambda: found.extend(secrets.scan(text, ratios))) < 60
    assert len(found) == 100_000 and all(kind == 2 for _, kind, _, _ in found)


def test_what_spans_cover():
    spans = [(0, 0, 4, ""), (2, 1, 9, ""), (12, 2, 14, ""), (14, 0, 15, "")]
    covered = secrets._Covered(spans)
    for start in range(18):
        for end in range(start + 1, 18):
            match = type("Match", (), {"start": lambda self, s=start: s, "end": lambda self, e=end: e})()
            assert covered.overlaps(match) == any(s < end and start < e for s, _, e, _ in spans)


def test_language_of_a_text_of_many_different_letters():
    points = np.random.default_rng(1).integers(0x4E00, 0x9FFF, 400_000)
    text = "".join(map(chr, points))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    whole = languages.bundles([text], 256)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000
    grams, counts = languages.trigram_counts([text[:3000]])
    expected = counts @ languages.trigram_vectors(grams, 256)
    assert np.array_equal(languages.bundles([text[:3000]], 256), expected) and whole.any()
