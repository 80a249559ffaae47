import re
from collections import Counter

import numpy as np
import pytest

from reviewloom.llm import common, neighbours


def rows(n, dims=12):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dims))
    x[: n // 10] = x[0] + 0.01 * rng.normal(size=(n // 10, dims))
    odd = [(n, None), (n + 1, [0.0] * dims), (n + 2, [float("nan")] * dims), (n + 3, [None] + [1.0] * (dims - 1))]
    return x, [(i, v.tolist()) for i, v in enumerate(x)] + odd


def test_search_and_links(spark, monkeypatch):
    for name, value in {"LEAF": 32, "TREES": 4, "TILE": 40}.items():
        monkeypatch.setattr(neighbours, name, value)
    x, data = rows(600)
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<double>, id string")
    found = neighbours.near_duplicates(df).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r for r in found}
    assert len(found) == len(data) and all(got[i].n_links == links[i] for i in range(600))
    assert all(got[i].component_id == 0 for i in range(60))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(600, 604))


def test_small_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]
    out = neighbours.search(df, "key = 2").collect()
    assert [(r.rank, r.vec_id) for r in out] == [(1, 1), (2, 1)]
    assert neighbours.near_duplicates(df.limit(0)).count() == 0
    assert neighbours.search(df.limit(0), "key = 2").count() == 0


def test_links_between_full_lists(spark, monkeypatch):
    for name, value in {"LEAF": 16, "TREES": 2}.items():
        monkeypatch.setattr(neighbours, name, value)
    # neither lucky leaves nor the audit make up for lists that are full
    monkeypatch.setattr(neighbours, "_missed", lambda table, *_: table.selectExpr("id as a", "id as b").limit(0))
    monkeypatch.setattr(neighbours, "_apart", lambda *_: lambda frame: frame.iloc[:0].assign(a=frame["id"], b=frame["id"])[["a", "b"]])
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for g in range(8):  # two groups of near copies each, with a cosine of 0.93 between them
        one, way = x[80 * g], x[80 * g + 79]
        way = way - (way @ one) * one
        two = 0.93 * one + np.sqrt(1 - 0.93**2) * way / np.linalg.norm(way)
        x[80 * g : 80 * g + 40] = one + 0.001 * rng.normal(size=(40, 24))
        x[80 * g + 40 : 80 * g + 80] = two + 0.001 * rng.normal(size=(40, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect()}
    assert all(got[i] == (79, 80 * (i // 80)) for i in range(640))


def nearest(x, q, k=10):
    """Brute force: distances added up in order, ties to the smaller number."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += (x[q, i] - x[:, i]) ** 2
    d = np.sqrt(total)
    return [(j, d[j]) for j in np.lexsort((np.arange(len(x)), d)) if j != q][:k]


@pytest.mark.parametrize("beam, expanded", [(320, 40), (8, 4)])
def test_search_against_all_rows(spark, monkeypatch, beam, expanded):
    for name, value in {"LEAF": 32, "TREES": 4}.items():
        monkeypatch.setattr(neighbours, name, value)
    shown, recall = [], neighbours._recall
    monkeypatch.setattr(neighbours, "_recall", lambda *a: shown.append(recall(*a)) or shown[-1])
    x, data = rows(600)
    x[300:320] = x[300]  # ties: equal vectors
    data = [(i, v.tolist()) for i, v in enumerate(x)] + data[600:]
    df = spark.createDataFrame([(*r, 1.0) for r in data], "vec_id long, embedding array<double>, score double")
    found = {}
    for r in neighbours.search(df, "key % 20 = 0", beam=beam, expanded=expanded).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(found) == list(range(0, 600, 20))
    hits = 0
    for q, got in found.items():
        want = nearest(x, q)
        assert [r for r, _, _ in sorted(got)] == list(range(1, 11))
        assert sorted(got) == [(i + 1, *p) for i, p in enumerate(sorted(((v, s) for _, v, s in got), key=lambda p: p[::-1]))]
        hits += sum(s <= want[-1][1] for _, _, s in got)
    assert hits / 300 == pytest.approx(shown[-1]) and hits / 300 >= neighbours.RECALL
    assert beam > 8 or len(shown) > 1  # the narrow beam had to be widened
    ties = [(v, s) for _, v, s in sorted(found[300])]
    assert ties == [(301 + i, 0.0) for i in range(10)]


def test_search_that_cannot_reach_its_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_recall", lambda *_: 0.5)
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(30)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="recall"):
        neighbours.search(df, "key = 2")


def test_descent_that_does_not_settle(spark, monkeypatch):
    for name, value in {"LEAF": 16, "TREES": 2, "DESCENTS": 2}.items():
        monkeypatch.setattr(neighbours, name, value)
    monkeypatch.setattr(neighbours, "_changed", lambda *_: 0.9)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(80, 4)))], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="still changed"):
        neighbours.search(df, "key = 2")


def test_passes_find_the_nearest_and_leave_one_graph(spark, monkeypatch, tmp_path):
    for name, value in {"LEAF": 64, "TREES": 2, "SMALL": 100, "PASSES": 2, "MOVED": 1 << 21}.items():
        monkeypatch.setattr(neighbours, name, value)
    x, data = rows(600)
    x[300:330] = x[300]
    shown, hop = [], neighbours._hop
    monkeypatch.setattr(neighbours, "_hop", lambda *a: shown.append(a[-1]) or hop(*a))
    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in neighbours.search(df, "key % 10 = 0", beam=80, expanded=40).collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = x.astype(np.float32).astype(float)
    assert sum(len(set(found[q]) & set(nearest(x, q))) for q in range(0, 600, 10)) >= 0.92 * 600
    # equal vectors tie: the smaller keys come first
    assert sorted(found[310]) == [(i, 0.0) for i in range(300, 310)]
    assert shown and min(shown) == 2
    left = Counter(re.sub("-[0-9a-f]{32}", "", f.name) for f in tmp_path.iterdir())
    assert left["graph"] <= 1 and left["leaves"] == 0 and left["beam"] <= min(shown)


def test_codes_leave_few_to_measure(spark):
    """Beams are cut to what may be among the nearest, whatever the rounding of the codes."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 16))
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    raw = np.concatenate([scale.view(np.uint8), np.rint(x / scale).astype(np.int8).view(np.uint8)], axis=1)
    y, off = neighbours._vectors(raw, 400)
    assert (np.sqrt(((y - x) ** 2).sum(axis=1)) <= off).all()
    ids = np.arange(1, 400)
    d = neighbours.squares(y[:1], y[1:])[0].astype(np.float32)
    beam = [
        neighbours._own("asked", 0, 0, np.zeros(1, dtype=np.int64), None, raw[:1]),
        neighbours._own("beam", 0, 0, np.zeros(399, dtype=np.int64), ids, np.stack([d, off[1:]], axis=1)),
    ]
    kept = neighbours._may_be_nearest(10)(0, neighbours.pa.Table.from_batches(beam))[0]["id"].to_pylist()
    assert {j for j, _ in nearest(x, 0)} <= set(kept) and len(kept) < 60


def test_entries_come_back_from_rows():
    ids = np.array([5, -7, 5, 2**62, 0])
    sent = neighbours._dealt("offer", np.array([2, 0, 2, 1, 0]), ids, ids * 2, n=9)
    table = neighbours.pa.Table.from_batches([sent])
    a, b = neighbours._got(table, "offer", np.int64, np.int64)
    assert sent["block"].to_pylist() == [0, 1, 2] and a.tolist() == [-7, 0, 2**62, 5, 5] and (b == a * 2).all()
    assert neighbours._places(table, "offer", 8).tolist() == [9] * 5
    row, got = neighbours._distinct(np.array([1, 0, 1, 1, 0]), ids)
    assert list(zip(row, got)) == [(0, -7), (0, 0), (1, 5), (1, 2**62)]
