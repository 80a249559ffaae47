import hashlib
import random

import numpy as np
import pytest
from conftest_llm import path, prose, tokenizer  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewloom.llm import bpe


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def decimal(path):
    return bpe.DecimalTable(path)


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_words_give_what_the_whole_text_gives(tokenizer, decimal, text):
    want = tokenizer.encode(text, add_special_tokens=False).ids
    got = [p for p in map(decimal.__getitem__, decimal.words([text])[0]) if p]
    assert " ".join(got) == " ".join(map(str, want))
    assert decimal.decoder.text(got) == tokenizer.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("seed", range(12))
def test_halves_and_windows_give_the_whole(tokenizer, seed):
    rng = random.Random(seed)
    pool = rng.choice(["abcdefghij", "aab", "thereinger", "!?.,;'sre", "é́e你好", "a1b2 c", "\U0001f600\U0001f601ab"])
    text = "".join(rng.choice(pool) for _ in range(3000))
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert bpe.encode_tree(tokenizer, text, leaf=rng.choice([16, 50, 300]))[0].tolist() == want


def test_encode_handles_odd_rows(spark, path, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 1000)
    long = "abcdefgh" * 700 + " tail"
    rows = [(1, None, 7), (2, "", 7), (3, "A b", 7), (3, "A b", 7), (None, "x<|endoftext|>y", 7), (9, long, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe.encode(df, path).collect()), key=str)
    want = []
    for key, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((key, len(ids), digest(" ".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert bpe.encode(df.limit(0), path).count() == 0


def test_binary_ids():
    assert bpe.binary([1, 70000]) == np.array([1, 70000], dtype="<u4").tobytes()


def test_flat_table(path, tokenizer, monkeypatch):
    """Ids by arrays are the library's, in a table that starts anew all the time too."""
    texts = [prose(i, 40 + 90 * i) for i in range(12)] + [None, "", " \n", "Don't. STOP! <|endoftext|> <|EndOfText|> <|x"]
    texts += ["É é É. straße! ΑΣ ας ΑΣ, İstanbul ǅ ﬁ", "a" * 300 + " " + "Ab1" * 1500, "x. X x! X, y) (y", "12 12. 1,000 é ‍ ½"]
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert bpe.FlatTable(path).ids(texts) == want
    monkeypatch.setattr(bpe, "KNOWN", 40)
    table = bpe.FlatTable(path)
    assert [table.ids([t])[0] for t in texts] == want
    assert table.ids([]) == [] and table.ids([None, ""]) == [b"", b""]


def test_flat_table_learns_words_once(path, tokenizer):
    """Other capitals and marks at the end make no new word, and every id is the library's."""
    table = bpe.FlatTable(path)
    table.ids(["stone and garçon , . !?"])
    known = len(table.start)
    texts = ["Stone, AND. stone!? Garçon and. STONE", "garçon garçon", "AND!? aNd"]
    assert table.ids(texts) == [bpe.binary(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(table.start) == known
    rng = random.Random(4)
    pool = [*"abcsStTreéÉßñÿ'\".,;<|>&*_-09 \t\n", "'s", "'ll", "<|endoftext|>", "<|EndOfText|>", "I\u0307", "e\u0301", "ﬁ", "Σ", "你", "\x1c", "\x85"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(4000)]
    made = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert table.ids(texts) == [bpe.binary(x.ids) for x in made]
