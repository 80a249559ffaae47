"""Neighbour graphs of vectors by NN-descent, greedy search in them, near-duplicates.

Vectors are looked at in one-byte codes until the end; whatever is returned is measured on
the original vectors in double precision.

The graph starts from random projection trees, fitted on a bounded sample, through which
every vector goes: the vectors of a leaf are each other's first neighbours. Then rounds of
NN-descent: the neighbours of a node, and the nodes that have it as a neighbour, meet at
that node in a join, and what is nearer to one of them than its last neighbour is offered
to it. Leaves are split by count, so that no group of like vectors is one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discarded, prepared, stored

#: Neighbours of a node, trees, vectors of a leaf, vectors in the sample.
NEIGHBOURS, TREES, LEAF, SAMPLE = 14, 6, 256, 20_000
#: Descent ends when no larger share of the list entries is new in a round. Lists only get
#: nearer, so it does end; as many rounds as DESCENTS are an error.
CHANGED, DESCENTS = 0.12, 40
#: Blocks of a table at least, and nodes of a block at most, by and large.
BLOCKS, BLOCK = 24, 8192
#: From so many rows on a round of descent has passes, each over a part of the blocks.
SMALL, PASSES = 1_000_000, 8
#: Bytes of codes that a hop may have on their way in any table; large tables may have a few times their own.
MOVED = 1 << 29
#: What goes between blocks: arrays end to end, as many as a kind needs; ``n`` is a count or the sender.
MESSAGE = "block int, kind string, n long, a binary, b binary, c binary"
SCHEMA = pa.schema([("block", pa.int32()), ("kind", pa.string()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
#: Search: neighbours of a node, nodes kept for a query, nodes expanded in a round.
WAYS, BEAM, EXPANDED = 24, 320, 40
#: Recall that a search must show, on as many of its queries at most.
RECALL, GATED = 0.92, 256
#: Vectors in a tile of the exact count of links.
TILE = 1000
#: Levels of a tree that have a threshold for each node.
DEEP = 12
#: Vectors of an audit at least; from its square on it has as many as the root of the table's rows.
AUDITED = 64


def vectors(df: DataFrame, key: str, vector: str, unit: bool) -> DataFrame:
    """Written rows (id, key, v, code) of the vectors that take part.

    ``v`` holds doubles, of length 1 if ``unit``; floats if that is what the column has and
    ``unit`` is not set. ``code`` is a scale and signed bytes.
    Null and zero vectors and those with null or non-finite values take no part. All must
    have the same length. ``id`` is the key, or a number if keys are null or repeated.
    """
    named = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    bad = named.groupBy("key").count().where("count > 1 or key is null").limit(1).count()
    named = named.withColumn("id", F.monotonically_increasing_id() if bad else F.col("key"))
    kind = np.float32 if _single(df, vector) and not unit else np.float64

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch["v"]), 0), False))
            if not batch.num_rows:
                continue
            flat = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
            length = pc.list_value_length(batch["v"]).to_numpy()
            starts = np.cumsum(length) - length
            sound = np.logical_and.reduceat(np.isfinite(flat), starts) & np.logical_or.reduceat(flat != 0, starts)
            batch, x = batch.filter(pa.array(sound)), flat[np.repeat(sound, length)]
            if not batch.num_rows:
                continue
            if len(set(length[sound])) > 1:
                raise ValueError("all vectors must have the same length")
            x = x.reshape(batch.num_rows, -1)
            if unit:
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            scale = (np.abs(x).max(axis=1) / 127).astype(np.float64)
            code = np.rint(x / scale[:, None]).astype(np.int8)
            code = np.concatenate([scale[:, None].view(np.uint8), code.view(np.uint8)], axis=1)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["key"], _binary(x.astype(kind)), _binary(code)], names=["id", "key", "v", "code"])

    return stored(named.select("id", "key", "v").mapInArrow(work, "id long, key long, v binary, code binary"), "vectors")


def _single(df: DataFrame, vector: str) -> bool:
    """Whether the column holds floats, so that four bytes a value lose nothing."""
    return df.select(F.col(f"`{vector}`")).dtypes[0][1] == "array<float>"


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value of each row."""
    data = np.ascontiguousarray(rows)
    offsets = (np.arange(len(data) + 1) * (data.nbytes // max(1, len(data)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def decode(codes) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), -1)
    scale = np.ascontiguousarray(raw[:, :8]).view(np.float64)
    return (raw[:, 8:].view(np.int8) * scale).astype(np.float32)


def doubles(values, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1).astype(np.float64, copy=False)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs."""
    out = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.maximum(out, 0)


def fit_trees(sample: np.ndarray, count: int, trees: int, leaf: int, seed: int) -> list:
    """Per tree and level a direction, the thresholds of its nodes, and one for nodes unseen."""
    rng, out = np.random.default_rng(seed), []
    depth = max(0, math.ceil(math.log2(max(1, count / leaf))))
    for _ in range(trees if depth else 1):
        levels, path = [], np.zeros(len(sample), dtype=np.int64)
        for level in range(depth):
            a, b = rng.integers(0, len(sample), 2)
            way = sample[a] - sample[b] + rng.normal(size=sample.shape[1]).astype(np.float32) * 1e-3 * np.abs(sample).max()
            at = sample @ way
            usual = float(np.median(at))
            limits = np.full(1 << min(level, DEEP), usual, dtype=np.float32)
            if level <= DEEP:
                for node in np.unique(path):
                    own = at[path == node]
                    if len(own) >= 8:
                        limits[node] = np.median(own)
            levels.append((way, limits, usual))
            path = _down(at, path, level, limits, usual)
        out.append(levels)
    return out


def _down(at, path, level, limits, usual):
    return path * 2 + (at > (limits[path] if level <= DEEP else usual))


def _leaves(table: DataFrame, trees: dict, extra: tuple = ()) -> tuple:
    """Rows (leaf, id, code, ...): each vector in a leaf of each tree, large leaves split; and their files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = decode(batch["code"].to_pylist())
            for number, levels in trees.items():
                path = np.zeros(len(x), dtype=np.int64)
                for level, (way, limits, usual) in enumerate(levels):
                    path = _down(x @ way, path, level, limits, usual)
                columns = [*batch.columns, pa.array(np.full(len(x), number, dtype=np.int32)), pa.array(path)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "tree", "path"])

    more = "".join(f", {name} long" for name in extra)
    rows = stored(table.select("id", "code", *extra).mapInArrow(work, f"id long, code binary{more}, tree int, path long"), "leaves")
    sizes = stored(rows.groupBy("tree", "path").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("shares")), "sizes")
    share = F.expr("pmod(xxhash64(id, tree), shares)")
    dealt = rows.join(sizes, ["tree", "path"]).select(F.xxhash64("tree", "path", share).alias("leaf"), "id", "code", *extra)
    return dealt, [rows, sizes]


def _in_groups(batches: Iterator[pd.DataFrame], group: str, function, most: int, enough: int) -> Iterator[list]:
    """Results of a function for sorted groups, or for ``most`` rows of one at a time, some ``enough`` rows at once."""
    held, out, made = [], [], 0

    def finish():
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        held.clear()
        return function(frame)

    last = None
    for batch in batches:
        values = batch[group].to_numpy()
        if not len(values):
            continue
        cuts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and (values[a] != last or sum(map(len, held)) >= most):
                out.append(finish())
                made += len(out[-1][0] if isinstance(out[-1], tuple) else out[-1])
            last = values[a]
            held.append(batch.iloc[a:b])
            if made > enough:
                yield out
                out, made = [], 0
    if held:
        out.append(finish())
    if out:
        yield out


def _by_group(rows: DataFrame, group: str, function, schema: str, most: int) -> DataFrame:
    """Run a function on the rows of each group, or on ``most`` of them at a time.

    Small groups are read in one stream per task. The function yields frames.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _in_groups(batches, group, function, most, 20_000):
            yield pd.concat(out, ignore_index=True)

    return rows.repartition(group).sortWithinPartitions(group, "id").mapInPandas(work, schema)


def _nearest_in_leaf(k: int):
    def work(frame: pd.DataFrame) -> tuple:
        x, ids = decode(frame["code"]), frame["id"].to_numpy()
        d = squares(x, x)
        np.fill_diagonal(d, np.inf)
        m = min(k, len(ids) - 1)
        near = np.argpartition(d, m - 1, axis=1)[:, :m] if m else np.zeros((len(ids), 0), dtype=np.int64)
        return np.repeat(ids, m), ids[near.ravel()], np.take_along_axis(d, near, 1).ravel().astype(np.float32)

    return work


# ---- blocks


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of each number (splitmix64)."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    return ((_mixed(ids) >> np.uint64(33)) % np.uint64(blocks)).astype(np.int32)


def _blocks(count: int) -> int:
    return max(1, -(-count // BLOCK), min(BLOCKS, count // 64))


def _rows(kind: str, block, n, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int32()), pa.array([kind] * len(block), pa.string()), pa.array(n, pa.int64()), *columns],
        names=["block", "kind", "n", "a", "b", "c"],
    )


def _own(kind: str, block: int, n: int = 0, *parts) -> pa.RecordBatch:
    """One row for a block, of arrays of any lengths."""
    parts = [p if p is None else np.ascontiguousarray(p).tobytes() for p in (*parts, None, None, None)[:3]]
    return _rows(kind, [block], [n], *(pa.array([p or b""], pa.binary()) for p in parts))


def _dealt(kind: str, to: np.ndarray, *parts, n: int = 0) -> pa.RecordBatch:
    """A row for each block with any entries in ``to``: of each array the entries that go there."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)])) if len(to) else np.zeros(1, dtype=np.int64)
    columns = []
    for part in (*parts, None, None, None)[:3]:
        data = b"" if part is None else np.ascontiguousarray(part[order])
        width = 0 if part is None or not len(to) else data.nbytes // len(to)
        offsets = (cuts * width).astype(np.int32)
        columns.append(pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
    return _rows(kind, to[cuts[:-1]], np.full(len(cuts) - 1, n), *columns)


def _got(table: pa.Table, kind: str, *types) -> list:
    """The arrays that rows of a kind hold, end to end; a type of None is left out."""
    rows = table.filter(pc.equal(table["kind"], kind))
    out = []
    for name, dtype in zip("abc", types):
        if dtype is not None:
            out.append(np.frombuffer(b"".join(x.as_buffer() for x in rows[name]), dtype=dtype))
    return out


def _places(table: pa.Table, kind: str, width: int) -> np.ndarray:
    """For each entry of rows of a kind, the number ``n`` of its row."""
    rows = table.filter(pc.equal(table["kind"], kind))
    return np.repeat(rows["n"].to_numpy(), pc.binary_length(rows["a"]).to_numpy() // width)


def _by_block(rows: DataFrame, function, schema: str = MESSAGE) -> DataFrame:
    """Run a function on the rows of each block: (block, table) -> record batches."""

    def work(key, table):
        return pa.Table.from_batches(function(key[0].as_py(), table), SCHEMA if schema == MESSAGE else None)

    return rows.groupBy("block").applyInArrow(work, schema)


def _each_block(rows: DataFrame, function) -> DataFrame:
    """The same where a block has one row, which need not be moved."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from function(batch["block"][i].as_py(), pa.Table.from_batches([batch.slice(i, 1)]))

    return rows.mapInArrow(work, MESSAGE)


def _firsts(key: np.ndarray) -> np.ndarray:
    """Where in a sorted array another value begins."""
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    return first


def _ranks(key: np.ndarray) -> np.ndarray:
    """In a sorted array, the number of each entry among its equals, from 0."""
    at = np.arange(len(key))
    return at - np.maximum.accumulate(np.where(_firsts(key), at, 0))


def _distinct(row: np.ndarray, ids: np.ndarray, *more) -> list:
    """Pairs of a small number and an id once each, in order; of equal ones the first."""
    order = np.argsort(ids, kind="stable")
    small = row.astype(np.uint16) if row.max(initial=0) < 1 << 16 else row  # sorted by digits
    order = order[np.argsort(small[order], kind="stable")]
    row, ids = row[order], ids[order]
    first = _firsts(row) | _firsts(ids)
    return [x[first] for x in (row, ids, *(m[order] for m in more))]


def _nearest(row: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest entries of each row, by row and distance, else in the order that they have."""
    bits = np.maximum(d, 0).astype(np.float32).view(np.int32).astype(np.int64)
    order = np.argsort((row.astype(np.int64) << 32) | bits, kind="stable")
    return order[_ranks(row[order]) < k]


def _cut(row: np.ndarray, ids: np.ndarray, by: np.ndarray, k: int) -> np.ndarray:
    """Places of the entries that are left if a row keeps k at most, those of the least hash."""
    order = np.argsort((row.astype(np.int64) << 40) | (by >> np.uint64(24)).astype(np.int64), kind="stable")
    return order[_ranks(row[order]) < k]


def _coded(table: DataFrame, blocks: int, kind: str = "code") -> DataFrame:
    """Written rows, one of each block, of its ids in order and their codes."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def dealt():
            whole = pa.Table.from_batches(held)
            held.clear()
            ids = whole["id"].to_numpy()
            codes = np.frombuffer(b"".join(x.as_buffer() for x in whole["code"]), dtype=np.uint8).reshape(len(ids), -1)
            return _dealt(kind, _block(ids, blocks), ids, None, codes)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= 65536:
                yield dealt()
        if held:
            yield dealt()

    def join(block: int, rows: pa.Table) -> list:
        ids, codes = _got(rows, kind, np.int64, None, np.uint8)
        order = np.argsort(ids)
        return [_own(kind, block, 0, ids[order], None, codes.reshape(len(ids), -1)[order])]

    return stored(_by_block(table.select("id", "code").mapInArrow(deal, MESSAGE), join), "codes")


def _lists(rows: pa.Table, k: int) -> tuple:
    """Ids of a block in order, their neighbours and distances, infinite where a list ends."""
    ids, near, far = _got(rows, "list", np.int64, np.int64, np.float32)
    return ids, near.reshape(len(ids), k), far.reshape(len(ids), k)


def _offered(rows: DataFrame, blocks: int, k: int) -> DataFrame:
    """The lists of a block with what is offered to its nodes; ``new`` and ``every`` count entries."""

    def merge(block: int, rows: pa.Table) -> list:
        ids, near, far = _lists(rows, k)
        if not len(ids):
            (ids,) = _got(rows, "code", np.int64)
            near, far = np.zeros((len(ids), k), dtype=np.int64), np.full((len(ids), k), np.inf, dtype=np.float32)
        a, b, d = _got(rows, "offer", np.int64, np.int64, np.float32)
        at = np.searchsorted(ids, a)
        ok = d < far[at, -1]
        old = far < np.inf
        n = int(old.sum())
        row = np.concatenate([np.nonzero(old)[0], at[ok]])
        # the sort is stable, so an entry that the list has already stays and counts as old
        row, b, d, fresh = _distinct(row, np.concatenate([near[old], b[ok]]), np.concatenate([far[old], d[ok]]), np.arange(n + int(ok.sum())) >= n)
        order = _nearest(row, d, k)
        row = row[order]
        rank = _ranks(row)
        near, far = np.zeros((len(ids), k), dtype=np.int64), np.full((len(ids), k), np.inf, dtype=np.float32)
        near[row, rank], far[row, rank] = b[order], d[order]
        return [
            _own("list", block, 0, ids, near, far),
            _own("bound", block, 0, far[:, -1]),
            _own("new", block, int(fresh[order].sum())),
            _own("every", block, len(row)),
        ]

    return stored(_by_block(rows, merge), "graph")


def _of(rows: DataFrame, *kinds: str) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds))


def build(table: DataFrame, k: int = NEIGHBOURS, trees: int = TREES, seed: int = 7, extra: tuple = (), also=None):
    """The neighbour graph of written vectors in blocks, their codes in blocks, and the trees.

    Nodes are dealt to blocks by a hash. A block is one row of packed arrays, and what
    blocks tell one another goes in one row for each two of them, so that no row is made
    for a single edge. Rounds of descent go on until at most ``CHANGED`` of the entries are
    new in one. ``also`` is called with leaves, which have the columns ``extra`` too, and the
    number of blocks; a large table has one tree at a time on disk.
    """
    count = table.count()
    sample = table.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("code").toPandas()
    fitted = fit_trees(decode(sample["code"]), count, trees, LEAF, seed) if count else []
    blocks = _blocks(count)
    codes = _coded(table, blocks)
    graph, numbered = codes, dict(enumerate(fitted))
    for part in [{n: t} for n, t in numbered.items()] if count >= SMALL else [numbered] if count else []:
        leaves, made = _leaves(table, part, extra)
        first = _packed_groups(leaves, "leaf", _nearest_in_leaf(k), blocks, 2 * LEAF)
        before, graph = graph, _offered(graph.union(first), blocks, k)
        if also:
            also(leaves, blocks)
        for old in made if before is codes else [*made, before]:
            discarded(old)
    if not count or not fitted[0]:
        return graph, codes, fitted
    passes = PASSES if count >= SMALL else 1
    for turn in range(DESCENTS):
        changed = 0.0
        for part in range(passes):
            before, graph = graph, _descend(graph, codes, blocks, k, seed + turn, part, passes)
            discarded(before)
            changed += _changed(graph)
        if changed <= CHANGED:
            return graph, codes, fitted
    raise RuntimeError(f"the neighbour graph still changed after {DESCENTS} rounds")


def _edges(graph: DataFrame, k: int) -> DataFrame:
    """Rows (a, near) of a graph in blocks, near sorted by distance."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, near, far = _lists(pa.Table.from_batches([batch.slice(i, 1)]), k)
                row, rank = np.nonzero(far < np.inf)
                pairs = pa.StructArray.from_arrays([pa.array(far[row, rank]), pa.array(near[row, rank])], names=["d", "b"])
                ends = np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32)
                for at in range(0, len(ids), 4096):
                    some = pa.ListArray.from_arrays(pa.array(ends[at : at + 4097]), pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 4096]), some], names=["a", "near"])

    return _of(graph, "list").mapInArrow(work, "a long, near array<struct<d:float,b:bigint>>").where(F.size("near") > 0)


def _packed_groups(rows: DataFrame, group: str, function, blocks: int, most: int) -> DataFrame:
    """Run a function on the rows of each group; what it offers (a, b, d) goes to the block of a."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for offers in _in_groups(batches, group, function, most, 1 << 20):
            a, b, d = (np.concatenate(x) for x in zip(*offers))
            if len(a):
                yield _dealt("offer", _block(a, blocks), a, b, d)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(batch.to_pandas() for batch in batches)

    return rows.repartition(group).sortWithinPartitions(group, "id").mapInArrow(frames, MESSAGE)


def _changed(graph: DataFrame) -> float:
    """Share of the list entries of a graph that the one before had not."""
    found = {r["kind"]: r["n"] for r in _of(graph, "new", "every").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    return found.get("new", 0) / max(1, found.get("every", 0))


def _reverse(graph: DataFrame, blocks: int, k: int, most: int, seed: int, part: int = 0, passes: int = 1) -> DataFrame:
    """Rows ``back`` to the block of each hub: (hub, node that names it), ``most`` of a hub from each block at most.

    Those are the ones of the least hash, so the least of all are among them.
    """

    def work(block: int, rows: pa.Table) -> list:
        ids, near, far = _lists(rows, k)
        row, rank = np.nonzero(far < np.inf)
        a, b = ids[row], near[row, rank]
        to = _block(b, blocks)
        if passes > 1:
            ok = to % passes == part
            a, b, to = a[ok], b[ok], to[ok]
        _, hub, named = np.unique(b, return_inverse=True, return_counts=True)
        if len(named) and named.max() > most:
            ok = _cut(hub, a, _mixed(a + seed * 31 + _mixed(b).view(np.int64)), most)
            a, b, to = a[ok], b[ok], to[ok]
        return [_dealt("back", to, b, a)]

    return _each_block(_of(graph, "list"), work)


def _members(rows: pa.Table, k: int, most: int, seed: int) -> tuple:
    """Ids of a block, and (row, id) of the neighbours of each, in both directions, ``most`` that name it."""
    ids, near, far = _lists(rows, k)
    hub, a = _got(rows, "back", np.int64, np.int64)
    row = np.searchsorted(ids, hub)
    ok = _cut(row, a, _mixed(a + seed * 31 + _mixed(hub).view(np.int64)), most)
    own, rank = np.nonzero(far < np.inf)
    return ids, *_distinct(np.concatenate([own, row[ok]]), np.concatenate([near[own, rank], a[ok]]))


def _answers(codes: DataFrame, wanted: DataFrame, blocks: int) -> DataFrame:
    """Rows ``reply`` to the blocks that want nodes: (id, bound, code); 0 for a bound that nobody knows."""

    def work(block: int, rows: pa.Table) -> list:
        (wanted,) = _got(rows, "want", np.int64)
        if not len(wanted):
            return []
        to = _places(rows, "want", 8).astype(np.int32)
        ids, raw = _got(rows, "code", np.int64, None, np.uint8)
        (bound,) = _got(rows, "bound", np.float32)
        at = np.searchsorted(ids, wanted)
        return [_dealt("reply", to, wanted, bound[at] if len(bound) else np.zeros(len(at), dtype=np.float32), raw.reshape(len(ids), -1)[at])]

    return _by_block(codes.union(wanted), work)


def _vectors(raw: np.ndarray, count: int) -> tuple:
    """Of packed codes the vectors, and how far each is from its original at most."""
    raw = raw.reshape(count, -1)
    scale = np.ascontiguousarray(raw[:, :8]).view(np.float64)
    off = scale[:, 0] * (0.5001 * math.sqrt(max(1, raw.shape[1] - 8)))
    return (raw[:, 8:].view(np.int8) * scale).astype(np.float32), off.astype(np.float32)


def _replies(rows: pa.Table) -> tuple:
    """Ids in order, their bounds, vectors, and how far these are from the originals at most."""
    ids, bound, raw = _got(rows, "reply", np.int64, np.float32, np.uint8)
    order = np.argsort(ids)
    return ids[order], bound[order], *_vectors(raw.reshape(len(ids), -1)[order], len(ids))


def _descend(graph: DataFrame, codes: DataFrame, blocks: int, k: int, seed: int, part: int = 0, passes: int = 1) -> DataFrame:
    """One round: neighbours of a node, in both directions, are offered to one another.

    Of the nodes that name a hub as many take part as it has neighbours, by a hash that
    differs from round to round. A pass does it at the hubs of every ``passes``-th block,
    so that fewer codes are on their way at once.
    """

    def gather(block: int, rows: pa.Table) -> list:
        ids, row, b = _members(rows, k, k, seed)
        wanted = np.unique(b)
        met = np.bincount(row, minlength=len(ids)).astype(np.int32)
        return [_own("hub", block, 0, b, met), _dealt("want", _block(wanted, blocks), wanted, n=block)]

    def meet(block: int, rows: pa.Table) -> list:
        b, met = _got(rows, "hub", np.int64, np.int32)
        ids, bound, x, _ = _replies(rows)
        at = np.searchsorted(ids, b)
        ends = np.concatenate(([0], np.cumsum(met)))
        found = []
        for first in range(0, len(met), 256):
            some = met[first : first + 256]
            width = int(some.max(initial=0))
            if width < 2:
                continue
            place = np.minimum(ends[first : first + len(some), None] + np.arange(width), len(at) - 1)
            there = np.arange(width) < some[:, None]
            who = at[place]
            y = x[who]
            size = (y * y).sum(axis=2)
            d = size[:, :, None] + size[:, None, :] - 2 * (y @ y.transpose(0, 2, 1))
            np.maximum(d, 0, out=d)
            d[~there] = np.inf
            d.transpose(0, 2, 1)[~there] = np.inf
            d[:, np.arange(width), np.arange(width)] = np.inf
            h, i, j = np.nonzero(d < bound[who][:, :, None])
            found.append((who[h, i] * np.int64(len(ids)) + who[h, j], d[h, i, j]))
        if not found:
            return []
        pair, d = (np.concatenate(f) for f in zip(*found))
        pair, first = np.unique(pair, return_index=True)
        row, other, d = pair // len(ids), pair % len(ids), d[first]
        order = _nearest(row, d, k)
        a = ids[row[order]]
        return [_dealt("offer", _block(a, blocks), a, ids[other[order]], d[order])]

    here = F.expr(f"pmod(block, {passes}) = {part}")
    back = _reverse(graph, blocks, k, k, seed, part, passes)
    asked = stored(_by_block(_of(graph, "list").where(here).union(back), gather), "hubs")
    replies = _answers(codes.union(_of(graph, "bound")), _of(asked, "want"), blocks)
    offers = _by_block(_of(asked, "hub").union(replies), meet)
    out = _offered(_of(graph, "list").union(offers), blocks, k)
    discarded(asked)
    return out


# ---- search


def search(
    df: DataFrame, queries, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    beam: int = BEAM, expanded: int = EXPANDED, recall: float = RECALL,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found for each query vector.

    ``queries`` is a condition on ``key``. Nearness is the Euclidean distance, ties go to
    the smaller key. Fewer rows come back only where there are fewer candidates. Rows with
    a null key are candidates, with a null ``vec_id``. Vectors that take no part
    (``vectors``) are neither queries nor candidates. Rows that repeat a key are queries and
    candidates of their own. Empty tables give no rows, other columns are left out.

    A query starts from its leaves of all trees. Each hop joins its nearest nodes that
    have not been expanded with the graph, measures their neighbours in both directions,
    and keeps the ``beam`` nearest of all, until no query has any left. Then ``GATED`` of
    the queries at most, by a hash, are held against all rows exactly. While they show less
    than ``recall``, the search goes on with a beam twice as wide; a beam as wide as the
    table that still shows less is an error.
    """
    prepared(df.sparkSession)
    kind = np.float32 if _single(df, vector) else np.float64
    table = vectors(df, key, vector, unit=False)
    ask = stored(table.where(queries).select("id", "code"), "queries")
    asking = F.expr(queries) if isinstance(queries, str) else queries
    begun = []

    # all vectors of the queries' leaves, in shares of a bounded number of vectors
    def meet(frame: pd.DataFrame) -> tuple:
        own = frame["asked"].to_numpy(dtype=bool)
        ids = frame["id"].to_numpy()
        if not own.any() or len(ids) < 2:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.float32)
        x, off = _vectors(np.frombuffer(b"".join(frame["code"]), dtype=np.uint8), len(ids))
        d = squares(x[own], x)
        d[np.arange(own.sum()), np.flatnonzero(own)] = np.inf
        m = min(beam, len(ids) - 1)
        near = np.argpartition(d, m - 1, axis=1)[:, :m]
        return np.repeat(ids[own], m), ids[near.ravel()], np.stack([np.take_along_axis(d, near, 1).ravel(), off[near.ravel()]], axis=1)

    def start(leaves: DataFrame, blocks: int) -> None:
        rows = begun.pop() if begun else _coded(ask, blocks, "asked")
        begun.append(_beams(rows.union(_packed_groups(leaves, "leaf", meet, blocks, 2 * LEAF)), beam, 0))
        discarded(rows)

    flagged = table.withColumn("asked", F.coalesce(asking.cast("boolean"), F.lit(False)).cast("long"))
    graph, codes, trees = build(flagged, WAYS, extra=("asked",), also=start)
    count, state = table.count(), begun[0] if begun else codes
    blocks = _blocks(count)

    # neighbours in both directions; of a popular node as many as it has itself
    def both(block: int, rows: pa.Table) -> list:
        ids, row, b = _members(rows, WAYS, 2 * WAYS, 0)
        return [_own("ways", block, 0, ids, b, np.bincount(row, minlength=len(ids)).astype(np.int32))]

    ways = stored(_by_block(_of(graph, "list").union(_reverse(graph, blocks, WAYS, 2 * WAYS, 0)), both), "ways")
    if begun:  # an empty table has no graph but its codes
        discarded(graph)

    # exact distances on the original vectors, added up in order
    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = doubles(batch["x"], kind), doubles(batch["y"], kind)
            total = np.zeros(len(x))
            for i in range(x.shape[1]):
                total += (x[:, i] - y[:, i]) ** 2
            yield batch[["q", "query_id", "vec_id"]].assign(score=np.sqrt(total))

    original = table.select("id", "key", "v")

    def ranked(state: DataFrame) -> DataFrame:
        pairs = stored(_by_block(_of(state, "asked", "beam"), _may_be_nearest(k), "q long, id long"), "pairs")
        pairs = pairs.join(original.select("id", F.col("key").alias("vec_id"), F.col("v").alias("y")), "id")
        pairs = pairs.join(original.select(F.col("id").alias("q"), F.col("key").alias("query_id"), F.col("v").alias("x")), "q")
        scored = pairs.select("q", "query_id", "vec_id", "x", "y").mapInPandas(
            exact, "q long, query_id long, vec_id long, score double"
        )
        near = Window.partitionBy("q").orderBy("score", "vec_id")
        return scored.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)

    # the codes on their way in a hop are to be no more than a few times the table
    size = table.select(F.length("code")).first()
    moved = ask.count() * expanded * 2 * WAYS * (size[0] + 12 if size else 0)
    passes = max(1, math.ceil(moved / max(MOVED, 8 * count * (size[0] if size else 1))))
    truth = _truth(table, ask, k, kind)
    hops = bool(trees and trees[0])  # the vectors of a single leaf have all met
    while True:
        while hops and _open(state):
            before, state = state, _hop(state, ways, codes, blocks, beam, expanded, passes)
            discarded(before)
        found = stored(ranked(state), "ranked")
        shown = _recall(found, truth)
        if shown >= recall:
            return found.select("query_id", "rank", "vec_id", "score")
        if beam >= count:
            raise RuntimeError(f"a search of the whole graph shows a recall of {shown:.3f} only")
        # what the narrower beam let go is found again from the nodes that it kept
        beam, hops, state = 2 * beam, bool(trees), stored(_each_block(state, _reopened), "beam")


def _beam(rows: pa.Table) -> tuple:
    """Queries of a block in order and their codes; (row, id, d and how far off, done) of their beams, by row and distance."""
    queries, raw = _got(rows, "asked", np.int64, None, np.uint8)
    row, ids, d = _got(rows, "beam", np.int64, np.int64, np.float32)
    (done,) = _got(rows, "done", np.bool_)
    return queries, raw, row, ids, d.reshape(-1, 2), done


def _chosen(row: np.ndarray, done: np.ndarray, expanded: int) -> np.ndarray:
    """Places in a beam of the nearest nodes of each query that have not been expanded."""
    left = np.flatnonzero(~done)
    return left[_ranks(row[left]) < expanded]


def _open(state: DataFrame) -> int:
    return _of(state, "done").agg(F.sum("n")).first()[0] or 0


def _reopened(block: int, rows: pa.Table) -> list:
    if rows["kind"][0].as_py() != "done":
        return rows.to_batches()
    (done,) = _got(rows, "done", np.bool_)
    return [_own("done", block, len(done), np.zeros(len(done), dtype=bool))]


def _beams(rows: DataFrame, beam: int, expanded: int) -> DataFrame:
    """The beams of the queries with what was found, ``beam`` nodes of each; the nodes chosen before are done."""

    def keep(block: int, rows: pa.Table) -> list:
        queries, raw, row, ids, d, done = _beam(rows)
        if not len(queries):
            return []
        done = done.copy()
        done[_chosen(row, done, expanded)] = True
        q, b, far = _got(rows, "offer", np.int64, np.int64, np.float32)
        at = np.searchsorted(queries, q)
        ahead, other = _got(rows, "candidate", np.int64, np.int64)
        far = far.reshape(-1, 2)
        if len(other):
            known, _, x, off = _replies(rows)
            y, _ = _vectors(raw, len(queries))
            place = np.searchsorted(known, other)
            total = np.empty(len(other), dtype=np.float32)
            for i in range(0, len(other), 8192):
                total[i : i + 8192] = ((x[place[i : i + 8192]] - y[ahead[i : i + 8192]]) ** 2).sum(axis=1)
            far = np.concatenate([far, np.stack([total, off[place]], axis=1)])
        n = len(at) + len(other)
        row, ids, d, done = _distinct(
            np.concatenate([row, at, ahead]), np.concatenate([ids, b, other]), np.concatenate([d, far]), np.concatenate([done, np.zeros(n, dtype=bool)])
        )
        order = _nearest(row, d[:, 0], beam)
        row, ids, d, done = row[order], ids[order], d[order], done[order]
        return [
            _own("asked", block, 0, queries, None, raw),
            _own("beam", block, 0, row, ids, d),
            _own("done", block, int((~done).sum()), done),
        ]

    return stored(_by_block(rows, keep), "beam")


def _hop(state: DataFrame, ways: DataFrame, codes: DataFrame, blocks: int, beam: int, expanded: int, passes: int) -> DataFrame:
    """Measure the neighbours of the nearest nodes of each query that have not been expanded.

    They meet the query in its block, each code once for all queries of a block. A pass
    does it for the queries of every ``passes``-th block.
    """

    def expand(block: int, rows: pa.Table) -> list:
        queries, _, row, ids, _, done = _beam(rows)
        at = _chosen(row, done, expanded)
        return [_dealt("expand", _block(ids[at], blocks), ids[at], queries[row[at]])]

    def lead(block: int, rows: pa.Table) -> list:
        node, q = _got(rows, "expand", np.int64, np.int64)
        if not len(node):
            return []
        ids, b, met = _got(rows, "ways", np.int64, np.int64, np.int32)
        at = np.searchsorted(ids, node)
        size, first = met[at], (np.cumsum(met) - met)[at]
        place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        q = np.repeat(q, size)
        return [_dealt("way", _block(q, blocks), q, b[place])]

    def gather(block: int, rows: pa.Table) -> list:
        queries, _, row, ids, _, _ = _beam(rows)
        q, b = _got(rows, "way", np.int64, np.int64)
        q, b = q[q != b], b[q != b]
        new = np.arange(len(row) + len(q)) >= len(row)
        row, b, new = _distinct(np.concatenate([row, np.searchsorted(queries, q)]), np.concatenate([ids, b]), new)
        wanted = np.unique(b[new])
        return [_own("candidate", block, 0, row[new], b[new]), _dealt("want", _block(wanted, blocks), wanted, n=block)]

    pieces = []
    for part in range(passes):
        mine = state.where(F.expr(f"pmod(block, {passes}) = {part}"))
        ahead = _by_block(mine, expand)
        led = _by_block(ways.union(ahead), lead)
        asked = stored(_by_block(mine.union(led), gather), "candidates")
        replies = _answers(codes, _of(asked, "want"), blocks)
        pieces.append(_beams(mine.union(_of(asked, "candidate")).union(replies), beam, expanded))
        discarded(asked)
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.union(piece)
    return out


def _may_be_nearest(k: int):
    """Pairs (q, id) of beams that may be among the k nearest, by how far off the codes are at most."""

    def work(block: int, rows: pa.Table) -> list:
        queries, raw, row, ids, d, _ = _beam(rows)
        x, off = _vectors(raw, len(queries))
        size = np.sqrt((x * x).sum(axis=1))[row]
        far = np.sqrt(np.maximum(d[:, 0], 0))
        # squares of single precision are rounded by a part of the vectors' own
        room = off[row] + d[:, 1] + 2e-3 * (2 * size + far)
        order = np.lexsort((far + room, row))
        last = np.full(len(queries), np.inf)
        kth = order[_ranks(row[order]) == k - 1]
        last[row[kth]] = (far + room)[kth]
        ok = far - room <= last[row]
        return [pa.RecordBatch.from_arrays([pa.array(queries[row[ok]]), pa.array(ids[ok])], names=["q", "id"])]

    return work


def _truth(table: DataFrame, ask: DataFrame, k: int, kind=np.float64) -> pd.DataFrame:
    """Of ``GATED`` queries at most: (q, far, n), the distance of the last of the n = k nearest.

    Every task keeps the k nearest of its rows, so its result is bounded. Products tell
    which pairs may be among them; only their distances are added up in order.
    """
    sample = ask.select("id").orderBy(F.xxhash64("id", F.lit(5)), "id").limit(GATED)
    rows = table.select("id", "v").join(sample, "id").toPandas()
    if not len(rows):
        return pd.DataFrame({"q": [], "far": [], "n": []})
    asked, x = rows["id"].to_numpy(), doubles(rows["v"], kind)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, size = np.full((len(asked), k), np.inf), (x * x).sum(axis=1)
        for batch in batches:
            if not len(batch):
                continue
            y = doubles(batch["v"], kind)
            about = size[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
            about[asked[:, None] == batch["id"].to_numpy()[None, :]] = np.inf
            last = best[:, -1] ** 2
            if len(y) >= k:
                last = np.minimum(last, np.partition(about, k - 1, axis=1)[:, k - 1])
            room = 1e-9 * (size + (y * y).sum(axis=1).max())
            i, j = np.nonzero((about <= (last + room)[:, None]) & (about < np.inf))
            total = np.zeros(len(i))
            for c in range(x.shape[1]):
                total += (x[i, c] - y[j, c]) ** 2
            place = np.arange(len(i)) - np.searchsorted(i, i)
            more = np.full((len(asked), max(1, place.max(initial=0) + 1)), np.inf)
            more[i, place] = np.sqrt(total)
            best = np.sort(np.concatenate([best, more], axis=1), axis=1)[:, :k]
        q, place = np.nonzero(best < np.inf)
        yield pd.DataFrame({"q": asked[q], "score": best[q, place]})

    near = Window.partitionBy("q").orderBy("score")
    every = table.select("id", "v").mapInPandas(work, "q long, score double")
    every = every.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k)
    return every.groupBy("q").agg(F.max("score").alias("far"), F.count("*").alias("n")).toPandas()


def _recall(found: DataFrame, truth: pd.DataFrame) -> float:
    """Share of the true neighbours that were found; ties count as found."""
    if not len(truth):
        return 1.0
    rows = found.where(F.col("q").isin(truth["q"].tolist())).select("q", "score").toPandas().merge(truth, on="q")
    return float((rows["score"] <= rows["far"]).sum() / truth["n"].sum())


# ---- near-duplicates


def near_duplicates(
    df: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding", audits: int = 30
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept): links of cosine ``least`` or more.

    Edges of the neighbour graph at or above the threshold, checked in double precision,
    join vectors to components. A list that is full of links may hide others. Those within
    its component are counted in the end anyway; those that leave it, and lead to another
    full list, are looked for exactly (``_between``), which is what lists grown until none
    is full would show. In each further round the vectors of new trees' leaves are compared
    outside their component.
    Then every component is compared with itself exactly, in tiles, and only counts of
    links leave a tile. A sample of vectors, larger for larger tables, is held against all
    vectors to audit recall; rounds go on until neither finds a new link, and more than
    ``audits`` of them are an error. Vectors that take no part have no links and are kept. Null keys
    get rows with a null ``component_id``; repeated keys are vectors of their own.
    """
    prepared(df.sparkSession)
    table = vectors(df, key, vector, unit=True)
    graph, codes, _ = build(table)
    graph = _edges(graph, NEIGHBOURS)
    rough = 2 - 2 * (least - 0.03)  # squared distance of unit vectors, with room for the codes
    pairs = graph.select("a", F.explode("near").alias("e")).where(F.col("e.d") <= rough).select("a", F.col("e.b").alias("b"))
    links = stored(_verified(pairs, table, least), "links")
    loops = table.select(F.col("id").alias("a"), F.col("id").alias("b"))
    full = graph.where((F.size("near") >= NEIGHBOURS) & (F.element_at("near", -1)["d"] <= rough)).select(F.col("a").alias("id"))
    if full.limit(1).count():
        links = stored(links.union(_between(full, table, components(links.union(loops)), least)), "links")
    for seed in range(1, audits + 1):
        groups = stored(components(links.union(loops)), "groups")
        count = table.count()
        sample = table.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("id", "code").toPandas()
        if not count:
            break
        trees = fit_trees(decode(sample["code"]), count, TREES, LEAF, 100 + seed)
        marked = table.select("id", "code").join(groups.select(F.col("node").alias("id"), "component"), "id")
        apart = _by_group(_leaves(marked, dict(enumerate(trees)), ("component",))[0], "leaf", _apart(rough, 2 - 2 * (least + 0.03)), "a long, b long", 2 * LEAF)
        more = stored(_verified(apart, table, least), "links")
        audited = stored(_missed(table, max(AUDITED, math.isqrt(count)), seed, groups, least), "audited")
        links = stored(links.union(more).union(audited), "links")
        if not more.limit(1).count() and not audited.limit(1).count():
            break
    else:
        raise RuntimeError(f"links between components still turned up after {audits} rounds")
    groups = stored(components(links.union(loops)), "groups")
    counts = _count_links(table, groups, least)
    names = table.select("id", "key").join(groups.select(F.col("node").alias("id"), "component"), "id")
    smallest = stored(names.groupBy("component").agg(F.min("key").alias("component_id")), "least")
    found = names.join(smallest, "component").join(counts, "id", "left").select(
        "key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id"
    )
    # vectors that take no part, as often as their key is there
    every = df.select(F.col(f"`{key}`").cast("long").alias("key"))
    rest = every.groupBy("key").count().join(
        table.groupBy("key").agg(F.count("*").alias("c")).select(F.col("key").alias("other"), "c"),
        F.col("key").eqNullSafe(F.col("other")), "left",
    )
    rest = rest.withColumn("missing", F.expr("count - coalesce(c, 0)")).where("missing > 0")
    rest = rest.select(F.expr("explode(sequence(1L, missing))"), "key").select(
        "key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id")
    )
    return found.union(rest).select(
        F.col("key").alias("vec_id"), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _apart(rough: float, certain: float):
    """Pairs of a leaf that are near but of different components.

    For each node and other component the nearest one if it is a link for certain, else
    all that may be one.
    """

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        x, ids, part = decode(frame["code"]), frame["id"].to_numpy(), frame["component"].to_numpy()
        d = squares(x, x)
        i, j = np.nonzero((d <= rough) & (part[:, None] != part[None, :]))
        order = np.lexsort((d[i, j], part[j], i))
        i, j = i[order], j[order]
        first = np.ones(len(i), dtype=bool)
        first[1:] = (i[1:] != i[:-1]) | (part[j[1:]] != part[j[:-1]])
        nearest = d[i, j][first][np.cumsum(first) - 1]
        ok = first | (nearest > certain)
        return pd.DataFrame({"a": ids[i[ok]], "b": ids[j[ok]]}).astype("int64")

    return work


def _between(full: DataFrame, table: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the vectors ``full`` of different components, one at least for each pair of balls with any.

    Vectors of a component are covered by balls of half the angle of a link around some of
    them. Only balls whose centres are no farther apart than a link and both radii can have
    a link, so the balls are compared in tiles, and then the vectors of those that are left.
    """
    reach = math.acos(min(1.0, max(-1.0, least)))
    groups = groups.select(F.col("node").alias("id"), "component")
    rows = stored(full.join(groups, "id").join(table.select("id", "v"), "id"), "full")
    sizes = stored(rows.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("long").alias("shares")), "sizes")
    rows = rows.join(sizes, "component").select(
        F.xxhash64("component", F.expr("pmod(xxhash64(id), shares)")).alias("tile"), "id", "component", "v"
    )

    def angles(x, y):
        return np.arccos(np.clip(x @ y.T, -1, 1))

    def cover(frame: pd.DataFrame) -> pd.DataFrame:
        x, ids = doubles(frame["v"]), frame["id"].to_numpy()
        ball, radius, left = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids)), np.arange(len(ids))
        while len(left):
            far = angles(x[left], x[left[:1]])[:, 0]
            far[0] = 0
            near = far <= reach / 2
            ball[left[near]], radius[left[near]] = ids[left[0]], far[near].max()
            left = left[~near]
        return frame[["id", "component", "v"]].assign(ball=ball, radius=radius)

    covered = _by_group(rows, "tile", cover, "id long, component long, v binary, ball long, radius double", 1 << 62)
    covered = stored(covered, "balls")
    balls = covered.where("id = ball").drop("ball")
    shares = max(1, math.ceil(balls.count() / TILE))
    balls = balls.withColumn("share", F.expr(f"pmod(xxhash64(id), {shares}L)")).withColumn(
        "other", F.explode(F.expr(f"sequence(0L, {shares - 1}L)"))
    )
    tile = F.xxhash64(F.least("share", "other"), F.greatest("share", "other"))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        x, ids, share = doubles(frame["v"]), frame["id"].to_numpy(), frame["share"].to_numpy()
        part, radius, one = frame["component"].to_numpy(), frame["radius"].to_numpy(), share == share.min()
        other = one if one.all() else ~one
        # radii and angles are rounded, least of all small ones
        near = angles(x[one], x[other]) <= reach + radius[one][:, None] + radius[other][None, :] + 1e-6
        i, j = np.nonzero(near & (part[one][:, None] != part[other][None, :]))
        return pd.DataFrame({"p": ids[one][i], "q": ids[other][j]})

    met = _by_group(balls.select(tile.alias("tile"), "id", "component", "v", "radius", "share"), "tile", meet, "p long, q long", 1 << 62)
    met = stored(met.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct(), "met")
    sides = met.select(F.xxhash64("p", "q").alias("pair"), F.explode(F.array("p", "q")).alias("ball"))

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        x, ids, ball = doubles(frame["v"]), frame["id"].to_numpy(), frame["ball"].to_numpy()
        one = ball == ball[0]
        found = x[one] @ x[~one].T
        i, j = np.unravel_index(found.argmax(), found.shape)
        ok = found[i, j] >= least
        return pd.DataFrame({"a": ids[one][i : i + ok], "b": ids[~one][j : j + ok]})

    rows = sides.join(covered.select("ball", "id", "v"), "ball").select("pair", "ball", "id", "v")
    return _by_group(rows, "pair", best, "a long, b long", 1 << 62)


def _verified(pairs: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose cosine in double precision reaches the threshold."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                ok = (doubles(batch["x"]) * doubles(batch["y"])).sum(axis=1) >= least
                yield batch.loc[ok, ["a", "b"]]

    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    met = once.join(table.select(F.col("id").alias("a"), F.col("v").alias("x")), "a")
    met = met.join(table.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
    return met.mapInPandas(work, "a long, b long")


def _missed(table: DataFrame, count: int, seed: int, groups: DataFrame, least: float) -> DataFrame:
    """Audit: links of ``count`` vectors, by a hash, that leave their component."""
    rows = table.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(count).select("id", "v").toPandas()
    asked, x = rows["id"].to_numpy(), doubles(rows["v"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                i, j = np.nonzero(x @ doubles(batch["v"]).T >= least)
                yield pd.DataFrame({"a": asked[i], "b": batch["id"].to_numpy()[j]})

    found = table.select("id", "v").mapInPandas(work, "a long, b long").where("a <> b")
    of = lambda name: groups.select(F.col("node").alias(name), F.col("component").alias(f"{name}_part"))
    return found.join(of("a"), "a").join(of("b"), "b").where("a_part <> b_part").select("a", "b")


def _count_links(table: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """Links of each vector within its component: (id, n_links).

    Components are split into shares of about ``TILE`` vectors; each pair of shares is a
    tile. Only components of several vectors take part.
    """
    sizes = groups.groupBy("component").agg(F.count("*").alias("c")).where("c > 1")
    sizes = stored(sizes.select("component", F.ceil(F.col("c") / TILE).cast("long").alias("shares")), "sizes")
    rows = groups.join(sizes, "component").withColumn("share", F.expr("pmod(xxhash64(node), shares)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, shares - 1)")))
    tile = F.xxhash64("component", F.least("share", "other"), F.greatest("share", "other"))
    rows = rows.select(tile.alias("tile"), F.col("node").alias("id"), "component", "share")
    met = rows.join(table.select("id", "v"), "id")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        x, ids, share = doubles(frame["v"]), frame["id"].to_numpy(), frame["share"].to_numpy()
        out = []
        one = share == share.min()
        if one.all():
            n = (x @ x.T >= least).sum(axis=1) - ((x * x).sum(axis=1) >= least)
            out.append(pd.DataFrame({"id": ids, "n": n}))
        else:
            near = x[one] @ x[~one].T >= least
            out.append(pd.DataFrame({"id": ids[one], "n": near.sum(axis=1)}))
            out.append(pd.DataFrame({"id": ids[~one], "n": near.sum(axis=0)}))
        return pd.concat(out, ignore_index=True).astype("int64")

    counted = _by_group(met, "tile", count, "id long, n long", 1 << 62)
    return counted.groupBy("id").agg(F.sum("n").alias("n_links"))
