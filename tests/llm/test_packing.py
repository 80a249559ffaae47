import zlib
from collections import defaultdict

import numpy as np

from conftest_llm import path, prose, tokenizer  # noqa: F401
from reviewloom.llm import packing


def check(rows, texts, tokenizer, size):
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == size or at < size and at & (at - 1) == 0
    assert set(docs) == set(texts)
    for key, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        for p in sorted(docs[key], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_every_id_is_in_one_piece(spark, path, tokenizer):
    texts = {i: prose(i, 5 + 37 * i % 300) for i in range(200)} | {500: None, 501: "", 502: prose(3, 3000)}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, length int").repartition(40)
    check(packing.pack(df, path, size=128).collect(), texts, tokenizer, 128)


def test_empty_table_and_repeated_rows(spark, path):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packing.pack(df, path, size=16).collect()
    assert sum(r.length for r in rows) == 8
    assert packing.pack(df.limit(0), path).count() == 0


def test_open_sequences_are_bounded():
    packer = packing.Packer(100, 0, 0)
    for i in range(3000):
        packer.add(i, 0, 61, bytes(4 * 61))
        assert len(packer.open) <= packing.OPEN
    packer.close()
    lengths = defaultdict(int)
    for row in packer.out:
        lengths[row[5]] += row[2]
    assert sum(lengths.values()) == 3000 * 61
    assert sum(n != 100 for n in lengths.values()) <= 7
