import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from crossbasket.llm import byte_bpe, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "é", "中", "\U0001f600", "'s", "#", "1", "xyz", "\t", "\x00", "▁", "<s>", "the", "́",
         "aaaa", "        ", "ing", "tion"]


def odd_texts(n, length, seed=1):
    rng = random.Random(seed)
    for _ in range(n):
        parts = PARTS[: rng.choice([3, len(PARTS)])]
        yield "".join(rng.choice(parts) for _ in range(rng.randint(0, length)))


@pytest.mark.parametrize("chunk,overlap", [(40, 1), (50, 4), (200, 30)])
def test_spliced_chunks_equal_the_whole(chunk, overlap):
    encoder = token_counts.ChunkedEncoder(MODEL, chunk, overlap)
    for text in odd_texts(300, 400):
        assert encoder.encode_long(text).tolist() == encoder.model.encode(text)


def test_counts_of_awkward_rows(awkward, nothing):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.token_counts(awkward, MODEL, chunk=1000, overlap=32).collect()
    expected = []
    for r in awkward.collect():
        text = r["text"] or ""
        n = len(model.encode(text))
        expected.append((r["doc_id"], len(text.encode()), n, n > 4096))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert token_counts.token_counts(nothing, MODEL).collect() == []


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}
    )


def test_byte_bpe_equals_the_library_and_decodes(reference):
    codec = byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN, cache=50)
    for text in odd_texts(300, 200):
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_every_token_of_the_vocabulary_is_reached():
    ranks = byte_bpe.read_ranks(RANKS)
    codec = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    assert all(ranks[token] == i for i, token in enumerate(codec.bytes_of))
    with pytest.raises(ValueError):
        byte_bpe.sentencepiece_model({b"a": 1})


def test_byte_bpe_of_awkward_rows(awkward, nothing, reference):
    got = byte_bpe.byte_bpe(awkward, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    expected = []
    for r in awkward.collect():
        text = r["text"] or ""
        ids = np.array(reference.encode_ordinary(text), "<u4").tobytes()
        digests = hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        expected.append((r["doc_id"], len(ids) // 4, *digests, ids))
    assert sorted(((*r[:4], bytes(r[4])) for r in got), key=str) == sorted(expected, key=str)
    assert byte_bpe.byte_bpe(nothing, RANKS, public_tokenizers.PATTERN).collect() == []
