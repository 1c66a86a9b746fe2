"""State maps of chunks: against the library at every cut, on texts without spaces, in every order of composition."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from potamos.llm import queries, token_counts

from .test_operators import docs_of

VOCABULARY = queries.vocabulary()


@pytest.fixture(scope="module")
def counter():
    return token_counts.TextCounter(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(VOCABULARY)
    return lambda text: len(found.encode(text, add_special_tokens=False).ids)


ALPHABETS = ["ab", "aehinrst", "xX9.", "!?'…", "'sretvlmdx", "한국어ㄱ", "éÉa̧", "ÅİßσςΣ", "<|endoftext|>", " a b", "日本語テキスト", "😀👍🏽", "नमस्ते"]


@pytest.mark.parametrize("alphabet", range(len(ALPHABETS)))
def test_space_free_texts(counter, library, monkeypatch, alphabet):
    rng, letters = random.Random(alphabet), ALPHABETS[alphabet]
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (3, 17, 200, 900) for _ in range(5)] + [letters * 60]
    for size in (3, 16, 101):
        monkeypatch.setattr(token_counts, "CHUNK_BYTES", size)
        for text in texts:
            data = text.encode()
            assert b"".join(counter.chunks(data)) == data
            assert counter.count(data) == library(text), (text, size)


def test_scan_is_every_prefix(counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK_BYTES", 9)
    text = "unbelievablycomplicatedwordswithoutanyspaces" * 4 + " and then, some!!! words"
    parts = counter.chunks(text.encode())
    maps = [counter.chunk_map(c) for c in parts]
    assert len(maps) > 15
    prefixes = token_counts.scan(maps, counter.compose)
    for k, prefix in enumerate(prefixes):
        state, n = prefix.at(None)
        assert n + counter.close(state) == library(b"".join(parts[: k + 1]).decode())
    entries = {p.at(None)[0] for p in prefixes}
    assert len(entries) > 3 and None not in {p.at(None)[0] for p in prefixes[:5]}
    left = reduce(counter.compose, maps)
    right = reduce(lambda b, a: counter.compose(a, b), reversed(maps))
    for state in entries:  # every map takes every state somewhere, and in the same way in any order
        assert left.at(state) == right.at(state)
    assert token_counts.scan([], counter.compose) == []


def test_states_survive_a_reset(counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK_BYTES", 20)
    monkeypatch.setattr(token_counts, "MAX_STATES", 5)
    text = "the quickest of brownish foxes jumps" * 30
    assert counter.count(text.encode()) == library(text)


def test_long_texts_and_clashing_columns(spark, library):
    texts = ["x" * 100_000, "ab" * 60_000 + " end", "'" * 70_000, "é" * 60_000, "a" * 5, "a" * 5, None, ""]
    docs = docs_of(spark, texts, [0, 1, 2, 3, 4, 4, None, 7]).withColumn("n_tokens", F.lit("x")).withColumn("n_bytes", F.lit("y"))
    rows = token_counts.count_tokens(docs, VOCABULARY).collect()
    want = sorted(((i or -1, len((t or "").encode()), library(t or "")) for i, t in zip([0, 1, 2, 3, 4, 4, None, 7], texts)))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want
