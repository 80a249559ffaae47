"""T1 to T4, L4, against plain Python on whole documents."""

import re
from collections import Counter

import pytest

from reviewloom.functions import text as textfn
from reviewloom.operators import words

WORD = r"\b[a-zá-ú]+\b"


@pytest.fixture(scope="module")
def texts(tables):
    df = tables.read("documents").select("doc_id", "text")
    return df, {r.doc_id: r.text for r in df.collect()}


def _ranked(counter, k):
    return sorted(counter.items(), key=lambda item: (-item[1], item[0]))[:k]


def test_word_frequency(texts):
    df, rows = texts
    counter = Counter(w for text in rows.values() for w in text.lower().split())
    found = [tuple(r) for r in words.word_frequency(df, "text", 50).collect()]
    assert found == _ranked(counter, 50)
    assert words.vocabulary_size(df, "text").first()[0] == len(counter)
    approximate = words.vocabulary_size(df, "text", approximate=True).first()[0]
    assert abs(approximate - len(counter)) < 0.1 * len(counter)


def test_ties_by_first_appearance(texts):
    df, rows = texts
    counter = Counter(w for key in sorted(rows) for w in rows[key].lower().split())
    found = [tuple(r) for r in words.word_frequency(df, "text", 500, ["doc_id"]).collect()]
    assert found == counter.most_common(500)


def test_letter_words(texts):
    df, rows = texts
    counter = Counter(w for text in rows.values() for w in re.findall(WORD, text.lower()))
    assert [tuple(r) for r in words.letter_words(df, "text", 300).collect()] == _ranked(counter, 300)


def test_letter_words_edges(column):
    cases = [
        "abc1 a_b ção x-y", "été", "a÷b ÷ a÷", "Ärger straße", "naïve ÀÉ", "", "ab÷1", None, "ünder ñ",
        "日本 abc 語", "a² b½",
    ]
    expected = [None if t is None else re.findall(WORD, t.lower()) for t in cases]
    assert column(textfn.letter_words, cases) == expected


def test_tokens_edges(column):
    cases = ["a b c", "\x1cx\x1dy\x85z", "  ", "A​B", None, "ΑΣ ς"]
    expected = [None if t is None else t.lower().split() for t in cases]
    assert column(textfn.tokens, cases) == expected


def test_digit_runs(spark):
    df = spark.createDataFrame([(1, "a12b3"), (2, "none"), (3, None), (4, "٣x4")], "id int, comment string")
    rows = words.digit_runs(df, "comment", "id").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "12"), (1, 1, "3"), (4, 0, "٣"), (4, 1, "4")]


def test_missing_column(spark):
    with pytest.raises(ValueError, match="comment"):
        words.word_frequency(spark.range(1))
