import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from reviewloom.llm import substrings


def brute(texts, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["café", " ", " x"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [some(rng.randrange(20, 60)) for _ in range(4)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            words += some(rng.randrange(50)) + rng.choice(shared)[: rng.randrange(60)]
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(words))
    texts += [texts[0], texts[0], None, "", "a", "a a " * 100, " ".join(some(300)) * 2]
    return texts


@pytest.mark.parametrize("seed,size,full", [(1, 35, None), (2, 8, None), (3, 20, 1), (4, 2, None), (5, 35, 3)])
def test_against_brute_force(spark, monkeypatch, seed, size, full):
    if full:
        monkeypatch.setattr(substrings, "FULL", full)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(df.repartition(5), size).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, size)


def test_repeated_and_null_keys(spark):
    text = " ".join(f"x{i}" for i in range(40))
    rows = [(1, text), (1, text), (None, text + " more"), (None, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_words, r.n_removed) for r in substrings.dedup(df).collect())
    assert got == [(False, 40, 40), (False, 40, 40), (True, 1, 0), (True, 41, 40)]
    assert substrings.dedup(df.limit(0)).count() == 0


def test_deep_nodes():
    segments = [b"a b c d", b"b c d e", b"x b c d"]
    marks = substrings.deep_nodes(np.array([1, 1, 2]), segments, np.array([1, 1, 1]), 3)
    assert [m.tolist() for m in marks] == [[False, True], [True, False], [False, False]]
