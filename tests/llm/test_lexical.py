import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from reviewloom.llm import lexical


def terms(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def brute(docs, items, k=20):
    counts = [(key, Counter(terms(t))) for key, t in docs]
    counts = [(key, c) for key, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df, out = Counter(t for _, c in counts for t in c), []
    for item, text in items:
        scores = []
        for key, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, key is None, key if key is not None else 0))
        for rank, (score, null, key) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if null else key, -score))
    return sorted(out, key=str)


def tables(spark, seed, n=400, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{int(i)}" for i in range(words)] + ["É", "ß", "don't", "a_b", "x-y", "Z9", "😀"]
    text = lambda most: " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 67])]) for _ in range(rng.randrange(most)))
    docs = [(i * 7 % n, text(rng.choice([3, 30, 200]))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,!"), (None, docs[1][1]), (None, text(9)), docs[5], docs[5], (n + 3, docs[5][1])]
    items = [(i, text(25)) for i in range(12)] + [(90, None), (91, "..."), (92, "unknownword"), (None, "w1 w2"), (3, "w1 w1 w1 W3"), (3, "W4")]
    schema = "text string, score string"
    a = spark.createDataFrame([(k, t, "s") for k, t in docs], f"doc_id long, {schema}").repartition(3)
    b = spark.createDataFrame([(k, t, "s") for k, t in items], f"item_id long, {schema}")
    return docs, items, a, b


@pytest.mark.parametrize(
    "seed,small",
    [(1, {}), (2, {"DOCUMENTS": 16, "FIRST_READ": 1, "GROWTH": 2}), (3, {"POSTINGS": 100, "FIRST_READ": 2, "QUERIES": 5, "TERMS": 30})],
)
def test_against_brute_force(spark, monkeypatch, seed, small):
    for name, value in small.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items, a, b = tables(spark, seed)
    got = [tuple(r) for r in lexical.search(a, b).collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_ties_go_by_key(spark):
    docs = [(i, "same words here" if i % 2 else "other") for i in range(200, 0, -1)]
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame([(1, "same words")], "item_id long, text string")
    got = lexical.search(a, b).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(1, 40, 2)) and len({r.score for r in got}) == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_reading_stops_early():
    """A query whose best documents stand out does not read its lists to the end."""
    n = 20_000
    docs = np.arange(n)
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice) and at.start:
                read.append(at.stop)
            return super().__getitem__(at)

    lists = lexical.Lists.__new__(lexical.Lists)
    lists.ids = docs
    impact = np.sort(np.random.default_rng(1).integers(1, 1000, n))[::-1].astype(np.int64)
    impact[:40] = 10**6 - np.arange(40)
    lists.of = {t: (docs.view(Counted), impact) for t in range(3)}
    got, score = lexical.best_of_shard(lists, [0, 1, 2], [1, 1, 1], 20, 0)
    order = np.argsort(-score)[:20]
    assert got[order].tolist() == list(range(20)) and (score[order] == 3 * impact[:20]).all()
    assert max(read, default=0) < n // 10
