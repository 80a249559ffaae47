"""The whole pipeline against brute force on a small table with planted cases."""

import random
import re
from collections import Counter

import corpus_pipeline
from conftest_llm import path, tokenizer  # noqa: F401
from test_jaccard import brute as near
from test_packing import check

SIZE = 35


def without_repeats(texts):
    """Texts without the words of windows that occur elsewhere; unchanged ones as they are."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + SIZE]) for w in words for i in range(len(w) - SIZE + 1))
    out = []
    for text, w in zip(texts, words):
        gone = [False] * len(w)
        for i in range(len(w) - SIZE + 1):
            if seen[tuple(w[i : i + SIZE])] > 1:
                gone[i : i + SIZE] = [True] * SIZE
        out.append(" ".join(x for x, g in zip(w, gone) if not g) if any(gone) else text)
    return out


def planted():
    """Rows of documents, and the ids of toxic ones."""
    rng = random.Random(11)
    vocabulary = [f"word{rng.randrange(10**6)}" for _ in range(900)]
    some = lambda n: rng.choices(vocabulary, k=n)
    passage, texts, toxic = some(60), [], set()
    for i in range(300):
        w = some(rng.randrange(60, 140))
        if i % 6 == 1:
            w = w[:20] + passage + w[20:]
        if i % 5 == 0:
            w, _ = w + "you awful fool".split(), toxic.add(i)
        texts.append("  ".join(w) if i % 3 else "\n".join(w))
    for i in (2, 3, 4):
        copy = texts[i].split()
        copy[7] = "changed"
        texts += [texts[i], " ".join(copy)]
    texts += [None, "", "one two", " ".join(some(6000))]
    rows = [(i, t, None if i % 7 == 0 else "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return rows, toxic


def test_run(spark, tmp_path, tokenizer):  # noqa: F811
    rows, toxic = planted()
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, shape)
    labels = [(i, 1, int(i in toxic)) for i in range(1, 300, 2)]
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    kept = sorted(r.doc_id for r in first.select("doc_id").collect())
    assert not toxic & set(kept)
    assert len(kept) >= 0.98 * (len(rows) - len(toxic))

    texts = [rows[i][1] for i in kept]
    groups = near(texts, 5, 8, 10)
    left = [i for i, (_, top) in enumerate(groups) if top == i]
    assert len(left) <= len(kept) - 6
    cleaned = without_repeats([texts[i] for i in left])
    assert sum(a != texts[i] for a, i in zip(cleaned, left)) > 20
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check(got, {kept[i]: t for i, t in zip(left, cleaned)}, tokenizer, 4096)
