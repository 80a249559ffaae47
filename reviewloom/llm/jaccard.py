"""Near-duplicate texts by the Jaccard similarity of their word shingles.

1. Each text becomes the set of the hashes of its shingles. Sets are banded by size. In a
   band the hash range is cut into more parts than two similar sets of that size can
   differ in elements, so that similar sets agree in at least one whole part. What a part
   holds is a candidate key. This loses no pair: a set also takes part in the next band
   if its size allows a partner there. Some parts are spare: a set does without its parts
   of fewest shingles, up to that number, since sets that have little in common meet there.
2. In a group of sets that share a key, those are tied whose sizes and bitmaps allow the
   overlap: a forest, so that no group is ever listed pair by pair. Where a key is so
   common that its group is large, all of the group is tied to one of them, which loses
   nothing either; a batch of texts does so ahead of the shuffle. Tied sets are a cluster.
   Keys are neither written nor shuffled one by one, but packed by parts of their range.
3. The members of a cluster meet as tiles of a bounded number of sets. In a tile, sets are
   ordered by size; a pair is passed over when sizes are too far apart, or when the bits
   that only one of two hashed bitmaps has leave too little overlap. The rest are
   intersected exactly, as sorted arrays. Sets already joined need no further pair.
4. A cluster of more than one tile has some sets in all of its tiles. What is still apart
   from the largest group of its cluster is then compared with every tile.

Texts with the same set are one member throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, prepared, stored
from .words import Runs, chunks, mix, signed

U64 = np.uint64
#: Sizes of a band grow by this ratio; it must be below any threshold in use.
RATIO = 0.75
#: Spare parts of any band, besides those for parts that hold one shingle.
EMPTY = 2
#: Sets in a tile, and sets of a large cluster that all of its tiles hold.
TILE, SHARED = 1000, 16
#: 64-bit words of a bitmap.
BITS = 16
#: Sets with a key in common that are compared by bitmaps, over all and in one batch of
#: texts; those of a larger group are tied without a look at them.
GROUP, LOCAL = 2000, 32
#: Candidate keys packed together, for each part of their range.
PACKED = 64


def bands(largest: int) -> np.ndarray:
    """Least sizes of the bands up to a size."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, math.ceil(out[-1] / RATIO)))
    return np.array(out, dtype=np.int64)


def parts(band: int, edges: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """Parts of the hash range in a band, more than similar sets can differ in, and how many
    of them are spare: about as many as hold one shingle at most in a small set of the band."""
    top = int(edges[band + 1]) - 1
    least = (den - num) * 2 * top // (den + num) + 1
    held = RATIO * top / least
    spare = EMPTY + int(least * math.exp(-held) * (1 + held))
    return least + spare, spare


def shingle_sets(texts: list, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, A-Z lower-cased.

    With fewer than k words the whole sequence is one; without words the set is empty.
    """
    for _, _, chunk in chunks(texts, lower=True):
        runs = Runs(chunk.hashes)
        for a, b in zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist()):
            if b == a:
                yield np.zeros(0, dtype=U64)
            elif b - a <= k:
                yield runs.hash(np.array([a]), np.array([b]))
            else:
                at = np.arange(a, b - k + 1)
                yield np.unique(runs.hash(at, at + k))


def set_id(values: np.ndarray) -> int:
    """One 63-bit number for a set."""
    total = mix(np.array([mix(values ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64) + U64(len(values))], dtype=U64))
    return int(total[0] >> U64(1))


def keys(values: np.ndarray, num: int, den: int, edges: np.ndarray) -> np.ndarray:
    """Candidate keys of a set: what its parts hold, in its own band and perhaps the next.

    Parts of fewer shingles than a bound are left out, which are no more than the spare ones.
    Similar sets agree in one part more than are spare. Of these, no more than the spare ones
    are below the higher of both bounds, so a key of both is left.
    """
    n, out = len(values), []
    band = int(np.searchsorted(edges, n, "right")) - 1
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(mix(values), out=sums[1:])
    # a set of the next band has its least size at least
    several = [band] + ([band + 1] if den * n >= num * int(edges[band + 1]) else [])
    for b in several:
        m, spare = parts(b, edges, num, den)
        cuts = (np.arange(m + 1, dtype=np.float64) / m * 2.0**64)[1:-1].astype(U64)
        at = np.concatenate(([0], np.searchsorted(values, cuts), [n]))
        count = np.diff(at)
        taken = count >= np.partition(count, spare)[spare]
        tag = mix(np.flatnonzero(taken).astype(U64) + U64(b << 32))
        held = (sums[at[1:]] - sums[at[:-1]])[taken]
        out.append(mix(held ^ tag))
    return signed(np.concatenate(out))


def bitmap(values: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS * 64, dtype=np.uint8)
    bits[(values & U64(BITS * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(U64)


def scaled_bitmap(values: np.ndarray) -> bytes:
    """A bitmap with two bits or more for each element, a power of two of words."""
    words = max(BITS, 1 << max(0, math.ceil(len(values) / 32) - 1).bit_length())
    bits = np.zeros(words * 64, dtype=np.uint8)
    bits[(values & U64(words * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(raw: list[bytes]) -> np.ndarray:
    """Bitmaps of several lengths, each folded to the shortest one."""
    words = min(map(len, raw)) // 8
    return np.array([np.bitwise_or.reduce(np.frombuffer(m, dtype=U64).reshape(-1, words), axis=0) for m in raw])


def likely_links(sizes: np.ndarray, maps: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A forest that joins all sets, in order of size, which may be similar by size and bitmap."""
    root, links = np.arange(len(sizes)), []
    for i in range(1, len(sizes)):
        lo = int(np.searchsorted(sizes, -(-num * sizes[i] // den)))
        j = np.arange(lo, i)
        j = j[root[j] != root[i]]
        if not len(j):
            continue
        for x in j[_able(sizes, maps, i, j, num, den)].tolist():
            if root[x] != root[i]:
                root[root == root[x]] = root[i]
                links.append((x, i))
    return links


def _able(sizes: np.ndarray, maps: np.ndarray, i: int, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the sets ``j`` the bitmaps leave the overlap with set ``i`` that num/den needs."""
    need = -(-num * (sizes[j] + sizes[i]) // (num + den))
    only_j = np.bitwise_count(maps[j] & ~maps[i]).sum(axis=1, dtype=np.int64)
    only_i = np.bitwise_count(maps[i] & ~maps[j]).sum(axis=1, dtype=np.int64)
    return np.minimum(sizes[j] - only_j, sizes[i] - only_i) >= need


def tile_links(sets: list[np.ndarray], num: int, den: int, against: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a forest that joins what is similar: index pairs.

    ``against`` marks sets that need comparing; a pair in which neither is marked is left
    out. All pairs of other sets that are not joined already are looked at.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
    maps = np.array([bitmap(sets[i]) for i in order]).reshape(-1, BITS)
    marked = None if against is None else against[order]
    root = np.arange(len(order))
    links = []
    for i in range(len(order)):
        lo = int(np.searchsorted(sizes, -(-num * sizes[i] // den)))
        j = np.arange(lo, i)
        j = j[root[j] != root[i]]
        if marked is not None and not marked[i]:
            j = j[marked[j]]
        if not len(j):
            continue
        for x in j[_able(sizes, maps, i, j, num, den)].tolist():
            if root[x] == root[i]:
                continue
            enough = -(-num * (int(sizes[x]) + int(sizes[i])) // (num + den))
            a, b = sets[order[x]], sets[order[i]]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            if int((b[at] == a).sum()) >= enough:
                root[root == root[x]] = root[i]
                links.append((order[x], order[i]))
    return links


def _compare(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of set ids within tiles: rows (tile, sid, t, apart) -> forests."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(held: dict) -> pd.DataFrame:
            ids = list(held)
            found = tile_links(
                [np.frombuffer(held[i][0], dtype=U64) for i in ids], num, den, np.array([held[i][1] for i in ids])
            )
            return pd.DataFrame([(ids[x], ids[y]) for x, y in found], columns=["a", "b"], dtype=np.int64)

        tile, held = None, {}
        for batch in batches:
            sets = shingle_sets(batch["t"].tolist(), k)
            for name, sid, apart, values in zip(batch["tile"], batch["sid"], batch["apart"], sets):
                if name != tile:
                    if len(held) > 1:
                        yield links(held)
                    tile, held = name, {}
                held[sid] = (values.tobytes(), bool(apart))
        if len(held) > 1:
            yield links(held)

    ordered = rows.repartition("tile").sortWithinPartitions("tile")
    return ordered.mapInPandas(work, "a long, b long")


def classes(
    df: DataFrame, k: int = 5, num: int = 8, den: int = 10, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Rows (key, n_shingles, component_id): texts joined by links of num/den or more.

    ``component_id`` is the smallest key reachable by links, the own one included. Texts
    that are null or have no words have no shingles and link with nothing. Texts with
    equal sets link. Keys are integers; a null key takes no part in links and is its own
    component; rows that repeat a key count as one text each but share what they reach.
    Empty tables stay empty; other columns are left out.
    """
    reach = _reach(df, k, num, den, text, key)
    texts = reach.where("k is not null").select(
        F.col("k").alias("a"), F.coalesce("part", F.xxhash64("k", F.lit("alone"))).alias("b")
    )
    least = reach.where("part is not null").groupBy("part").agg(F.min("k").alias("least"))
    out = reach.join(stored(least, "least"), "part", "left")
    out = out.select("k", "n", F.coalesce("least", "k").alias("c"))
    # a key in several parts joins them
    several = texts.distinct().groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    several = stored(several, "several")
    if not several.isEmpty():
        own = out.where("k is not null").select(F.col("k").alias("a"), F.col("c").alias("b")).distinct()
        final = components(own.join(several, "a").union(own.select("b", "b")).union(own.select("a", "a")))
        final = stored(final.select(F.col("node").alias("c"), F.col("component").alias("whole")), "keys")
        out = out.join(final, "c", "left").select("k", "n", F.coalesce("whole", "c").alias("c"))
    return out.select(
        F.col("k").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("k").isNull(), F.col("k")).otherwise(F.col("c")).alias("component_id"),
    )


def unique(df: DataFrame, k: int = 5, num: int = 8, den: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` without near copies: of each group of linked texts one row stays.

    It is one with the smallest key, then the smallest hash of its text. Rows are told
    apart by key and text, so rows that repeat a key go or stay by their own texts; of
    rows that repeat both, one stays. Rows without words or key stay.
    """
    # only keys and hashes are grouped; texts move in the last joins
    reach = _reach(df, k, num, den, text, key).where("part is not null and k is not null")
    best = F.min(F.struct("k", "h")).alias("best")
    best = stored(reach.groupBy("part").agg(best), "best")
    rows = reach.groupBy("part", "k", "h").agg(F.count("*").alias("copies"))
    gone = stored(rows.join(best, "part").where("struct(k, h) <> best").select("k", "h"), "gone")
    again = stored(rows.join(best, "part").where("struct(k, h) = best and copies > 1").select("k", "h"), "copies")
    made = F.col(f"`{key}`").cast("long"), F.xxhash64(f"`{text}`")
    named = df.select(F.struct("*").alias("row"), made[0].alias("k"), made[1].alias("h"))
    left = named.join(gone, ["k", "h"], "left_anti")
    if not again.isEmpty():
        one = left.join(again, ["k", "h"], "left_semi").dropDuplicates(["k", "h"])
        left = left.join(again, ["k", "h"], "left_anti").unionByName(one)
    return left.select("row.*")


def _reach(df: DataFrame, k: int, num: int, den: int, text: str, key: str) -> DataFrame:
    """Rows (k, h, n, part), one per text: key, hash of the text, size of its set, and what
    it is joined with; no part where the set is empty."""
    if not num / den > RATIO:
        raise ValueError(f"the threshold must be above {RATIO}")
    spark = prepared(df.sparkSession)
    named = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    named = named.withColumn("h", F.xxhash64("t"))

    few, most, bits = LOCAL, GROUP, _range_bits(spark)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per batch: a row (k, h, n, sid) for each text, and (n, sid, bits) for each set."""
        for batch in batches:
            if not len(batch):
                continue
            known, texts, maps = set(), [], []
            for name, h, values in zip(batch["k"].tolist(), batch["h"].tolist(), shingle_sets(batch["t"].tolist(), k)):
                sid = set_id(values) if len(values) else None
                texts.append((name, h, len(values), sid))
                if sid is not None and sid not in known:
                    known.add(sid)
                    maps.append((len(values), sid, scaled_bitmap(values)))
            yield _columns(texts, ["k", "h", "n", "sid"])
            if known:
                yield _columns(maps, ["n", "sid", "bits"])

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The candidate keys of the sets, packed by parts of their range."""
        edges, held, size = bands(1000), [], 0
        for batch in batches:
            known = {}
            for values in shingle_sets(batch["t"].tolist(), k):
                sid = set_id(values) if len(values) else None
                if sid is not None and sid not in known:
                    if len(values) >= edges[-2]:
                        edges = bands(2 * len(values))
                    known[sid] = keys(values, num, den, edges)
            if known:
                held.append(_local_groups(known, few))
                size += len(held[-1][0])
            if size >= PACKED << bits:
                yield _packed(held, bits)
                held, size = [], 0
        if held:
            yield _packed(held, bits)

    rows = stored(named.mapInPandas(describe, "k long, h long, n long, sid long, bits binary"), "sets")
    texts = rows.where("bits is null").select("k", "h", "n", "sid")
    maps = rows.where("bits is not null").select("sid", "n", "bits").dropDuplicates(["sid"])

    blocks = named.select("t").mapInPandas(locate, "part int, keys binary, sids binary, which binary, whole binary")
    keyed = blocks.repartition("part").mapInPandas(_unpacked, "candidate long, sid long, whole boolean")
    ordered = keyed.sortWithinPartitions("candidate", "sid")
    met = stored(ordered.mapInPandas(lambda batches: _groups(batches, most), "shared long, a long, b long").distinct(), "met")
    held = met.where("shared is not null").select("shared", F.col("a").alias("sid")).join(maps, "sid")

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Ties within each group, whose rows come one after another in order of size."""
        last, sid, sizes, bits = None, [], [], []

        def finish() -> list[tuple[int, int]]:
            links = likely_links(np.array(sizes, dtype=np.int64), folded(bits), num, den)
            links = [(sid[x], sid[y]) for x, y in links]
            for held in (sid, sizes, bits):
                held.clear()
            return links

        for batch in batches:
            names, out = batch["shared"].to_numpy(), []
            if not len(names):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)])).tolist()
            columns = [batch[c].tolist() for c in ("sid", "n", "bits")]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if sid and names[a] != last:
                    out += finish()
                last = names[a]
                for held, values in zip((sid, sizes, bits), columns):
                    held += values[a:b]
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
        if sid:
            yield pd.DataFrame(finish(), columns=["a", "b"], dtype=np.int64)

    together = held.repartition("shared").sortWithinPartitions("shared", "n", "sid")
    ties = together.mapInPandas(likely, "a long, b long").union(met.where("shared is null").select("a", "b"))
    ties = stored(ties.distinct(), "ties")
    clusters = stored(components(ties).withColumnRenamed("node", "sid"), "clusters")

    # one text of each set; members of a cluster in tiles
    one = texts.where("sid is not null and k is not null").groupBy("sid").agg(F.min(F.struct("k", "h")).alias("k"))
    counts = clusters.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles"))
    members = clusters.join(one, "sid").join(counts, "component")
    members = members.withColumn("tile", F.expr("pmod(xxhash64(sid), tiles)"))
    large = counts.where("tiles > 1")
    shared = clusters.join(large.select("component"), "component").groupBy("component").agg(
        *[F.max_by("sid", F.xxhash64("sid", F.lit(i))).alias(f"s{i}") for i in range(SHARED)]
    )
    hubs = shared.select("component", F.explode(F.array(*[f"s{i}" for i in range(SHARED)])).alias("sid")).distinct()
    hubs = hubs.join(one, "sid").join(large, "component").withColumn("tile", F.explode(F.expr("sequence(0L, tiles - 1)")))
    placed = members.select("component", "tile", "sid", "k").union(hubs.select("component", "tile", "sid", "k")).distinct()
    placed = placed.select(F.xxhash64("component", "tile").alias("tile"), "sid", "k", F.lit(True).alias("apart"))
    need = members.select("k.*", "sid")
    bodies = named.join(need, ["k", "h"]).groupBy("sid").agg(F.first("t").alias("t"))
    bodies = stored(bodies, "bodies")
    first = stored(_compare(placed.join(bodies.select("sid", "t"), "sid").select("tile", "sid", "t", "apart"), k, num, den), "links")

    # large clusters: what is apart from the largest group meets all tiles
    loops = clusters.join(large.select("component"), "component").select(F.col("sid").alias("a"), F.col("sid").alias("b"))
    groups = stored(components(first.union(loops)).select(F.col("node").alias("sid"), F.col("component").alias("part")), "parts")
    state = clusters.join(large, "component").join(groups, "sid")
    sizes = state.groupBy("component", "part").agg(F.count("*").alias("c"))
    main = sizes.groupBy("component").agg(F.max_by("part", F.struct("c", "part")).alias("main"))
    state = state.join(main, "component").withColumn("apart", F.col("part") != F.col("main"))
    own = state.select("component", F.expr("pmod(xxhash64(sid), tiles)").alias("tile"), "sid", "apart")
    spread = state.where("apart").select("component", F.explode(F.expr("sequence(0L, tiles - 1)")).alias("tile"), "sid", "apart")
    again = own.union(spread).distinct().select(F.xxhash64("component", "tile").alias("tile"), "sid", "apart")
    second = _compare(again.join(bodies.select("sid", "t"), "sid").select("tile", "sid", "t", "apart"), k, num, den)

    # from sets to texts
    links = stored(first.union(second), "links")
    final = components(links).select(F.col("node").alias("sid"), F.col("component").alias("part"))
    reach = texts.join(final, "sid", "left").withColumn("part", F.coalesce("part", "sid"))
    return stored(reach.select("k", "h", "n", "part"), "reach")


def _range_bits(spark) -> int:
    """Bits of a key that name its part of the range: some parts for each shuffle partition."""
    return min(15, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length() + 2)


def _packed(held: list[tuple], bits: int) -> pd.DataFrame:
    """Rows (part, keys, sids, which, whole) of candidate keys: one for each part of their
    range, with 40 further bits of each key and the place of its set among ``sids``."""
    cand, sid, whole = (np.concatenate(x) for x in zip(*held))
    cand = cand.view(U64)
    order = np.argsort(cand)
    cand, sid, whole = cand[order], sid[order], whole[order]
    part = (cand >> U64(64 - bits)).astype(np.int64)
    low = ((cand >> U64(24 - bits)) & U64((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))).tolist()
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        sids, which = np.unique(sid[a:b], return_inverse=True)
        if len(sids) > 1 << 16 or 8 * len(sids) + 2 * (b - a) > 8 * (b - a):
            sids, which = sid[a:b], np.zeros(0)
        packed = np.packbits(whole[a:b]).tobytes() if whole[a:b].any() else b""
        rows.append((int(part[a]), low[a:b].tobytes(), sids.tobytes(), which.astype("<u2").tobytes(), packed))
    return pd.DataFrame(rows, columns=["part", "keys", "sids", "which", "whole"])


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (candidate, sid, whole) of packed ones; candidates have their part and 40 bits."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            n = len(row.keys) // 5
            low = np.zeros((n, 8), dtype=np.uint8)
            low[:, :5] = np.frombuffer(row.keys, np.uint8).reshape(n, 5)
            sids = np.frombuffer(row.sids, np.int64)
            whole = np.unpackbits(np.frombuffer(row.whole, np.uint8), count=n).astype(bool) if row.whole else np.zeros(n, bool)
            yield pd.DataFrame(
                {
                    "candidate": low.view("<u8").ravel().astype(np.int64) | (row.part << 40),
                    "sid": sids[np.frombuffer(row.which, "<u2")] if row.which else sids,
                    "whole": whole,
                }
            )


def _columns(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows of ``describe`` with some of its columns, the others null."""
    whole = lambda values: pd.array([None if pd.isna(v) else int(v) for v in values], dtype="Int64")
    given = dict(zip(names, zip(*rows)))
    out = {name: whole(given.get(name, [None] * len(rows))) for name in ("k", "h", "n", "sid")}
    return pd.DataFrame(out).assign(bits=pd.Series(given.get("bits", [None] * len(rows)), dtype=object))


def _local_groups(known: dict[int, np.ndarray], few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of the sets of a batch: (candidate, sid, whole).

    If more than ``few`` sets have a key, the first keeps it, as one whose group is
    whole. Each other one is tied to that set by a key of their own, which is whole too,
    so a group of copies leaves the batch as a few rows.
    """
    sid = np.repeat(np.fromiter(known, dtype=np.int64), [len(v) for v in known.values()])
    cand = np.concatenate(list(known.values()))
    order = np.lexsort((sid, cand))
    cand, sid = cand[order], sid[order]
    new = np.concatenate(([True], (cand[1:] != cand[:-1]) | (sid[1:] != sid[:-1])))
    cand, sid = cand[new], sid[new]
    start = np.flatnonzero(np.concatenate(([True], cand[1:] != cand[:-1])))
    count = np.diff(np.append(start, len(cand)))
    large, hub = np.repeat(count > few, count), np.repeat(sid[start], count)
    stays = ~large | (sid == hub)
    tied = np.unique(np.column_stack((hub, sid))[~stays], axis=0)
    made = signed(mix(tied[:, 0].astype(U64) ^ U64(0x5DEECE66D1CE4E5B)))
    return (
        np.concatenate((cand[stays], made, made)),
        np.concatenate((sid[stays], tied[:, 0], tied[:, 1])),
        np.concatenate((large[stays], np.ones(2 * len(tied), dtype=bool))),
    )


def _larger(batches: Iterator[pd.DataFrame], rows: int = 1 << 16) -> Iterator[pd.DataFrame]:
    """Batches of narrow rows, put together to some ``rows`` each."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def _groups(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Rows in order of candidate and set -> groups of several sets, and ties.

    A group is named by its members, so that sets with many keys in common meet once:
    rows (shared, a). Of a group that is whole or has more than ``most`` sets, each is
    tied to the first: rows (null, a, b). A run that a batch cuts off waits for the next
    one, or, once it is that large, leaves its first set there.
    """
    none = np.zeros(0, dtype=np.int64)
    cand, sid, whole = none, none, np.zeros(0, dtype=bool)

    def cut(cand, sid, whole):
        new = np.concatenate(([True], (cand[1:] != cand[:-1]) | (sid[1:] != sid[:-1])))
        start = np.flatnonzero(np.concatenate(([True], cand[1:] != cand[:-1])))
        marked = np.logical_or.reduceat(whole, start)
        marked = np.repeat(marked, np.diff(np.append(start, len(cand))))
        cand, sid, whole = cand[new], sid[new], marked[new]
        start = np.flatnonzero(np.concatenate(([True], cand[1:] != cand[:-1])))
        return cand, sid, whole, start, np.diff(np.append(start, len(cand)))

    def made(cand, sid, whole) -> pd.DataFrame:
        cand, sid, whole, start, count = cut(cand, sid, whole)
        named = np.add.reduceat(mix(sid.astype(U64)), start) ^ mix(count.astype(U64))
        several = np.repeat(count > 1, count)
        tied = several & (whole | np.repeat(count > most, count))
        met, hub = several & ~tied, np.repeat(sid[start], count)
        tied &= hub != sid
        shared = pd.array(np.repeat(signed(mix(named)), count)[met], dtype="Int64")
        groups = pd.DataFrame({"shared": shared, "a": sid[met], "b": pd.array([None] * len(shared), dtype="Int64")})
        ties = pd.DataFrame({"shared": pd.array([None] * int(tied.sum()), dtype="Int64"), "a": hub[tied], "b": sid[tied]})
        return pd.concat([groups, ties.astype("Int64")], ignore_index=True).astype("Int64").drop_duplicates()

    for batch in _larger(batches):
        cand = np.concatenate((cand, batch["candidate"].to_numpy(np.int64)))
        sid = np.concatenate((sid, batch["sid"].to_numpy(np.int64)))
        whole = np.concatenate((whole, batch["whole"].to_numpy(bool)))
        end = int(np.searchsorted(cand, cand[-1]))
        if end:
            yield made(cand[:end], sid[:end], whole[:end])
            cand, sid, whole = cand[end:], sid[end:], whole[end:]
        if len(cand) > most:
            cand, sid, whole, _, _ = cut(cand, sid, whole)
            if len(cand) > most:
                whole[:] = True
                yield made(cand, sid, whole)
                cand, sid, whole = cand[:1], sid[:1], whole[:1]
    if len(cand):
        yield made(cand, sid, whole)
