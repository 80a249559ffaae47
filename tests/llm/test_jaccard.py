import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from reviewloom.llm import jaccard


def brute(texts, k, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w)} if 0 < len(w) <= k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    root, holders = list(range(len(sets))), defaultdict(list)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x]).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
        for x in s:
            holders[x].append(i)
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    texts = []
    for _ in range(8):
        base = [word() for _ in range(rng.choice([1, 2, 5, 12, 60, 250]))]
        for _ in range(rng.randrange(1, 25)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return texts + [None, "", " \t", "É a", "é a", texts[0]]


@pytest.mark.parametrize(
    "seed,k,num,den,small", [(1, 3, 9, 10, {}), (2, 5, 8, 10, {"TILE": 4, "SHARED": 2}), (3, 5, 8, 10, {"GROUP": 2, "LOCAL": 2})]
)
def test_against_brute_force(spark, monkeypatch, seed, k, num, den, small):
    for name, value in small.items():
        monkeypatch.setattr(jaccard, name, value)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, sid string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(df.repartition(3), k, num, den).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, k, num, den)


def test_empty(spark):
    assert jaccard.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_across_batches(monkeypatch):
    """Runs of a key that batches cut off: groups up to a size, then ties to the first set."""
    monkeypatch.setattr(jaccard, "_larger", lambda batches: batches)
    rows = [(1, 5), (1, 6), (2, 7), *[(3, i) for i in range(1, 10)], (4, 5), (4, 6), (5, 1)]
    for size in (1, 2, 3, 20):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        frames = [pd.DataFrame(p, columns=["candidate", "sid"]).assign(whole=False) for p in parts]
        out = pd.concat(jaccard._groups(iter(frames), 4)).drop_duplicates()
        groups = out[out["shared"].notna()].groupby("shared")["a"].apply(sorted).tolist()
        ties = out[out["shared"].isna()][["a", "b"]].astype(int).values.tolist()
        assert groups == [[5, 6]]
        assert sorted(ties) == [[1, i] for i in range(2, 10)]


def test_bitmaps_lose_no_pair():
    """What is similar stays tied by bitmaps of any length, folded or not."""
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 511, 513, 1100, 5000):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        other = np.unique(np.concatenate((base[: len(base) - n // 10], rng.integers(0, 2**63, n // 11, dtype=np.uint64))))
        far = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        sets = sorted((base, other, far), key=len)
        sizes, maps = np.array([len(x) for x in sets]), jaccard.folded([jaccard.scaled_bitmap(x) for x in sets])
        links = jaccard.likely_links(sizes, maps, 8, 10)
        same = np.intersect1d(base, other).size
        if 10 * same >= 8 * (len(base) + len(other) - same):
            i, j = (next(k for k, x in enumerate(sets) if x is y) for y in (base, other))
            assert tuple(sorted((i, j))) in links
        if n > 1:
            assert len(links) == 1


def near(text, seed):
    words = text.split()
    words[seed % len(words)] = f"changed{seed}"
    return " ".join(words)


def test_repeated_keys(spark):
    """Rows that repeat a key are texts of their own, and share what they reach."""
    rng = random.Random(9)
    a, b, c = (" ".join(f"w{rng.randrange(500)}" for _ in range(120)) for _ in range(3))
    rows = [(1, b), (1, a), (2, near(a, 3)), (3, near(b, 5)), (4, c), (4, None), (5, near(c, 7)), (6, ""), (4, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {(r.doc_id, r.component_id) for r in jaccard.classes(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}
    assert jaccard.classes(df).count() == len(rows)
    kept = sorted(((r.doc_id, r.text) for r in jaccard.unique(df).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (4, c), (4, None), (6, "")], key=str)


def test_keys_are_packed_whole():
    rng = np.random.default_rng(3)
    cand, sid = rng.integers(-(2**63), 2**63, 5000), rng.integers(0, 2**62, 40)[rng.integers(0, 40, 5000)]
    whole = rng.random(5000) < 0.01
    for bits in (1, 4, 15):
        out = pd.concat(jaccard._unpacked(iter([jaccard._packed([(cand[:9], sid[:9], whole[:9]), (cand[9:], sid[9:], whole[9:])], bits)])))
        key = (cand.view(np.uint64) >> np.uint64(24 - bits)).astype(np.int64)
        assert sorted(zip(key, sid, whole)) == sorted(zip(out["candidate"], out["sid"], out["whole"]))


def test_keys_lose_no_pair_and_part_what_has_little_in_common():
    """Sets as far apart as a link allows share a key; those with a tenth in common have few."""
    rng = np.random.default_rng(7)
    some = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    edges = jaccard.bands(8000)
    for num, den in ((8, 10), (9, 10)):
        for n in rng.integers(1, 700, 400).tolist():
            base = some(n)
            less = (den - num) * n // den
            own = int(rng.integers(0, less + 1))
            same = n - int(rng.integers(0, max(0, (den * n - num * (n + own)) // den) + 1))
            pair = np.unique(base), np.unique(np.concatenate((base[:same], some(own))))
            assert den * np.intersect1d(*pair).size >= num * np.union1d(*pair).size
            a, b = (jaccard.keys(x, num, den, edges) for x in pair)
            assert np.intersect1d(a, b).size
    common, held = some(30), []
    for n in rng.integers(200, 400, 300).tolist():
        held.append(np.unique(jaccard.keys(np.unique(np.concatenate((common, some(n - 30)))), 8, 10, edges)))
    _, times = np.unique(np.concatenate(held), return_counts=True)
    met = times[times > 1].sum() / len(held)
    assert met < 4
