import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewloom.llm import periodic
from reviewloom.llm.queries import periodic_tail

EMPTY = hashlib.sha256(b"").hexdigest()


def brute(words):
    """Every maximal stretch of every period, by the definition."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def ids(words):
    return periodic.word_ids([words])[0]


@given(st.lists(st.integers(0, 2), max_size=70))
@settings(max_examples=300, deadline=None)
def test_small_alphabets(numbers):
    words = [b"%d" % x for x in numbers]
    assert periodic.find_runs(ids(words), len(words)) == brute(words)


@pytest.mark.parametrize("seed", range(6))
def test_planted_runs(seed):
    rng = random.Random(seed)
    words = []
    for _ in range(12):
        words += [b"%d" % rng.randrange(50) for _ in range(rng.randrange(20))]
        q = rng.choice([1, 2, 3, 5, 8, 13, 31, 32, 33, 64, 70])
        unit = [b"%d" % rng.randrange(rng.choice([2, 5, 1000])) for _ in range(q)]
        words += (unit * 8)[: rng.randrange(3 * q, 8 * q)]
    assert periodic.find_runs(ids(words), len(words)) == brute(words)


def test_nested_and_long():
    unit = [b"a"] * 40 + [b"b"]
    words = unit * 6 + [b"c"] + [b"d"] * 20_000
    got = periodic.find_runs(ids(words), len(words))
    assert (0, 246, 41) in got and (247, 20_000, 1) in got and sum(q == 1 for _, _, q in got) == 7
    assert len(got) == 8


def test_sums_are_those_of_the_definition():
    rng = np.random.default_rng(1)
    for size in (1, 2, 4, 16, 64):
        blocks = rng.integers(0, periodic.PRIME, (5, size)).astype(np.uint64)
        windows = rng.integers(0, periodic.PRIME, (5, 2 * size - 1)).astype(np.uint64)
        windows[2, :size] = blocks[2]
        got = periodic.mismatches(blocks, windows)
        for m in range(5):
            for d in range(size):
                pairs = zip(blocks[m].tolist(), windows[m, d : d + size].tolist())
                assert int(got[m, d]) == sum((a - b) ** 2 for a, b in pairs) % periodic.PRIME
        assert got[2, 0] == 0


def expected(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if key is not None and n:
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = best[1] * 1000 // best[2] if found else None
    return (key, len(found), *best, milli, sha(listed), sha(kept))


def test_documents(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab  c d é".split(" ")) for _ in range(rng.randrange(300))) for _ in range(150)]
    texts += [None, "", " \t\n", "x", "x " * 500, "a b\tc\x0bd " * 30, "line one two\n" * 40]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, "z z z z z z z", "k"), (3, texts[3], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, period string").repartition(3)
    got = sorted(map(tuple, periodic.runs(df, edit=periodic_tail).collect()), key=str)
    assert got == sorted([expected(k, t) for k, t, _ in rows], key=str)
    assert sum(zlib.crc32(b"%d" % i) % 10 == 0 for i in range(len(texts))) > 5
    assert periodic.runs(df.limit(0)).count() == 0


def test_empty_digests(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert tuple(periodic.runs(df).first()) == (1, 0, None, None, None, None, EMPTY, EMPTY)


def test_repeats_cost_no_square():
    """Pathological words: blocks that occur at many distances, and one word throughout."""
    import time

    rng = random.Random(2)
    words = []
    while len(words) < 200_000:
        words += [b"a"] * rng.randrange(60, 200) + [b"b"]
    for case in (words, [b"a"] * 300_000):
        started = time.perf_counter()
        periodic.find_runs(ids(case), len(case))
        assert time.perf_counter() - started < 30
