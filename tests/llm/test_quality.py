import random

from reviewloom.llm import quality


def test_bad_documents_go_and_others_stay(spark):
    rng = random.Random(5)
    words = [f"word{rng.randrange(10**6)}" for _ in range(400)]
    docs, labels = [], []
    for i in range(600):
        text = " ".join(rng.choices(words, k=80)) + "."
        bad = i % 5 == 0
        if bad:
            text += " you awful fool"
        docs.append((i, text, f"s{i % 4}", None if i % 7 == 0 else "en", "x"))
        if i % 2:
            labels.append((i, 1, int(bad)))
    docs += [(1000, None, None, None, "x"), (1001, "", "s1", "en", "x"), (1, docs[1][1], "s1", "en", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, kept string")
    marks = spark.createDataFrame(labels + [(7, None, None)], "doc_id long, quality int, toxic int")
    out = quality.classify(df, marks).collect()
    assert len(out) == len(docs)
    held_out = [r for r in out if r.doc_id < 600 and r.doc_id % 2 == 0]
    assert sum(r.kept == (r.doc_id % 5 != 0) for r in held_out) >= 0.97 * len(held_out)
    assert quality.classify(df, marks.limit(0)).where("not kept").count() == 0
    assert quality.classify(df.limit(0), marks).count() == 0
