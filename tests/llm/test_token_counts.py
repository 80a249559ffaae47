import numpy as np
import pytest

from conftest_llm import path, prose, tokenizer  # noqa: F401
from reviewloom.llm import token_counts as tc

EOD = 49407


@pytest.mark.parametrize("block", [2, 64, 1 << 16])
def test_counts_of_documents(spark, path, tokenizer, block):
    texts = {i: prose(i, i % 40) for i in range(60)} | {100: None, 101: "", 102: prose(1, 2000)}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, file string")
    blocks = tc.write_blocks(df.repartition(3), path, EOD, block=block).cache()
    got = tc.document_order(blocks, "doc_id").join(tc.count_tokens(blocks, EOD), ["file", "ordinal"])
    want = {k: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for k, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in got.collect()} == want
    assert got.count() == len(want)


def test_flat_files(spark, tmp_path):
    tokens = np.array([5, EOD, EOD, 7, 8, 9, EOD, 1, 2], dtype="<u2")
    tokens.tofile(tmp_path / "a.bin")
    np.array([], dtype="<u2").tofile(tmp_path / "b.bin")
    rows = tc.count_tokens(tc.read_blocks(spark, str(tmp_path), block=4), EOD).orderBy("ordinal").collect()
    assert [(r.ordinal, r.n_tokens, r.ended) for r in rows] == [(0, 1, True), (1, 0, True), (2, 3, True), (3, 2, False)]


def test_no_blocks(spark):
    assert tc.count_tokens(spark.createDataFrame([], "file string, block long, data binary"), EOD).count() == 0
    rows = spark.createDataFrame([("f", 0, None)], "file string, block long, data binary")
    assert tc.count_tokens(rows, EOD).count() == 0
