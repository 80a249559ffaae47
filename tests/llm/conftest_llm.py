"""Texts for the tests of the operators."""

import random

import pytest

WORDS = "the of and in lorem ipsum dolor sit amet Café straße naïve 你好 42 it's don't, end. (x) <b> a_b".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randrange(50))]) for _ in range(n))


@pytest.fixture(scope="module")
def path():
    from reviewloom.llm.queries import word_bpe

    return word_bpe()


@pytest.fixture(scope="module")
def tokenizer(path):
    from reviewloom.llm.bpe import load

    return load(path)
