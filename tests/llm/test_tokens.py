import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.tokens import TOKENIZERS, VOCABULARY, Encoder, count_tokens, encode

PATH = os.path.join(TOKENIZERS, VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no public vocabulary here")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(PATH)
    public.encode_special_tokens = True
    own = Encoder(open(PATH, "rb").read())
    return own, lambda texts: [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


HARD = [
    "", " ", "\n\n\t ", "<|endoftext|>", "a<|endoftext|>b", "</s>", "I'm they'll we'd", "a" * 5000, " " * 3000, "-" * 999, "=!=" * 700, "ab" * 900, "12345678901234567890", "한국어 텍스트", "naïve café", "naïve", "🐕‍🦺👩🏽‍🦰", "\x01\x07\r\n", "日本犬の写真", "कुत्ता",
]


def test_equals_the_public_library(both):
    own, public = both
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("ab -_=.,\n0123éß한aethinsrl'") for _ in range(rng.randrange(200))) for _ in range(500)]
    assert own.encode_all(texts) == public(texts)
    assert own.failed and own.failed < own.checked


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    global _PAIR
    if "_PAIR" not in globals():
        public = Tokenizer.from_file(PATH)
        public.encode_special_tokens = True
        _PAIR = Encoder(open(PATH, "rb").read()), public
    own, public = _PAIR
    text = text.encode("utf-8", "ignore").decode("utf-8")
    assert own.encode_all([text]) == [public.encode(text, add_special_tokens=False).ids]


def test_round_trip(both):
    own, _ = both
    names = {i: t for t, i in own.ids.items()}
    for text, ids in zip(HARD, own.encode_all(HARD)):
        assert b"".join(names[i] for i in ids).decode() == text


def test_words_are_forgotten_without_effect(both, monkeypatch):
    from corpusloom.llm import tokens

    own, public = both
    monkeypatch.setattr(tokens, "KEEP_WORDS", 5)
    texts = [f"word{i} other{i}" for i in range(50)]
    assert [own.encode_all([t])[0] for t in texts] == public(texts)


def test_encode(spark, both, monkeypatch):
    _, public = both
    rows = [(i, t, "x") for i, t in enumerate(HARD)] + [(100, None, "x"), (None, "pug", "x"), (1, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in encode(df, "doc_id", "text").collect()))
    want = sorted((-1 if i is None else i, public([t or ""])[0]) for i, t, _ in rows)
    assert got == want
    assert encode(df.limit(0), "doc_id", "text").count() == 0
    counts = count_tokens(df, "text")
    assert counts.columns == ["doc_id", "ids", "n_tokens"]
    assert sorted(r.n_tokens for r in counts.collect()) == sorted(len(w) for _, w in want)
