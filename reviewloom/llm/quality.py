"""Quality of documents by hierarchical empirical Bayes.

Evidence of a document: log likelihood ratios of the features it has, learned from
labelled documents. Features are its words, lower-cased and without marks around them,
the first letters of longer words (a stem with many endings is one feature), and what its
form is like: shares of capitals, of marks, of repeated lines. Only features that a good
part of the bad documents have count, so that words of a few copied texts do not.

Prior of a document: how often documents of its place turn out bad. Places form levels,
here the host (``source``) and the path below it (``lang``). The expected number of bad
documents of a place, from the evidence alone, is shrunk towards the rate of the level
above by as many pseudo-documents as the spread between places calls for, so a place
with few documents says what its parent says. The posterior adds both in log odds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared, stored

#: Labelled documents that are fitted on at most, chosen by a hash of their key.
LABELLED = 20_000
#: Features kept at most; documents, and share of the bad ones, that a feature must be in.
FEATURES, SEEN, SHARE = 5_000, 4, 0.02
#: Evidence a feature must give at least, in log odds and in standard errors, and that it
#: counts for at most.
LEAST, SURE, MOST = 3.0, 3.3, 8.0
#: Lengths of the beginnings of words that are features, in bytes.
STEMS = (4, 5)
_EDGES = (0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75)
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass
class Model:
    """Log likelihood ratios of features, and how their sum and the length give evidence."""

    ratios: dict[bytes, float] = field(default_factory=dict)
    #: Of 1, the sum, the length and its square; log odds against the rate of the labelled.
    line: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0)

    def total(self, found: set[bytes]) -> float:
        return float(sum(self.ratios[f] for f in self.ratios.keys() & found))

    def evidence(self, found: set[bytes], length: float) -> float:
        a, b, c, d = self.line
        return a + b * self.total(found) + c * length + d * length * length


def features(text: str | None) -> tuple[set[bytes], float]:
    """Features of a whole text (words, pairs of form and step of its share) and its length:
    the logarithm to base 2 of one more than its words."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    found = {w.strip(_MARKS).lower() for w in set(words)}
    found.discard(b"")
    for size in STEMS:
        found |= {b"\x01" + w[:size] for w in found if len(w) > size and w[0] != 1}
    n = max(1, len(raw))
    letters = np.frombuffer(raw, dtype=np.uint8)
    capitals = int(((letters >= 65) & (letters <= 90)).sum())
    small = int(((letters >= 97) & (letters <= 122)).sum())
    marks = sum(raw.count(bytes([m])) for m in _MARKS)
    digits = int(((letters >= 48) & (letters <= 57)).sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = {
        b"\x00capitals": capitals / max(1, capitals + small),
        b"\x00marks": marks / n,
        b"\x00digits": digits / n,
        b"\x00lines": 1 - len(set(lines)) / max(1, len(lines)),
        b"\x00words": 1 - len(set(words)) / max(1, len(words)),
        b"\x00bars": raw.count(b"|") / n,
    }
    for name, share in shares.items():
        found.add(name + b"%d" % sum(share > e for e in _EDGES))
    length = math.log2(1 + len(words))
    found.add(b"\x00length%d" % min(9, int(length)))
    return found, length


def learn(df: DataFrame, labels: DataFrame, bad: str, text: str = "text", key: str = "doc_id") -> Model:
    """Evidence of features, from labelled documents by grouped counts.

    ``bad`` is a condition on the labels. At most ``LABELLED`` labelled documents take
    part, by a hash of their key; null conditions and keys without a label do not. A model
    without labels of both kinds is empty.
    """
    marked = labels.select(F.col(f"`{key}`").alias("k"), F.expr(bad).cast("int").alias("bad"))
    marked = marked.where("bad is not null and k is not null").groupBy("k").agg(F.max("bad").alias("bad"))
    marked = marked.orderBy(F.xxhash64("k"), "k").limit(LABELLED)
    half = F.pmod(F.xxhash64("k", F.lit("half")), F.lit(2)).cast("int").alias("half")
    known = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(
        F.broadcast(marked), "k"  # LABELLED rows of a key and a number at most
    ).select("t", "bad", half)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple[bytes, int], list[int]] = {}
            for t, b, h in zip(batch["t"], batch["bad"], batch["half"]):
                for f in (*features(t)[0], b""):
                    sums.setdefault((f, int(h)), [0, 0])[int(b)] += 1
            yield pd.DataFrame([(*f, *c) for f, c in sums.items()], columns=["f", "half", "good", "bad"])

    counts = known.mapInPandas(count, "f binary, half int, good long, bad long").groupBy("f").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("half") == h, F.col(c))), F.lit(0)).alias(f"{c}{h}")
            for c in ("good", "bad")
            for h in (0, 1)
        ]
    )
    counts = counts.withColumns({c: F.col(f"{c}0") + F.col(f"{c}1") for c in ("good", "bad")})
    counts = stored(counts.where(f"good + bad >= {SEEN} or f = X''"), "features")
    model = Model(_ratios(counts, ""))
    halves = [_ratios(counts, str(h)) for h in (0, 1)]
    if model.ratios and all(halves):
        model.line = _line(known, [Model(r) for r in halves])
    return model


def _ratios(counts: DataFrame, half: str) -> dict[bytes, float]:
    """Features that tell bad from good by the counts of a half, or of all."""
    counts = counts.select("f", F.col(f"good{half}").alias("good"), F.col(f"bad{half}").alias("bad"))
    total = counts.where("f = X''").first()
    if total is None or not total.bad or not total.good:
        return {}
    ratio = F.log((F.col("bad") + 0.5) / (total.bad + 1)) - F.log((F.col("good") + 0.5) / (total.good + 1))
    chosen = counts.where("f <> X''").where(F.col("bad") >= SHARE * total.bad).withColumn("llr", ratio)
    # the ratio against its standard error, which the smaller count sets
    sure = F.col("llr") / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    chosen = chosen.withColumn("sure", sure).where(f"llr >= {LEAST} and sure >= {SURE}")
    rows = chosen.orderBy(F.desc("sure"), "f").limit(FEATURES).select("f", "llr").collect()
    return {bytes(r.f): max(-MOST, min(MOST, float(r.llr))) for r in rows}


def _line(known: DataFrame, models: list[Model]) -> tuple[float, ...]:
    """Log odds by sum and length, against the overall rate: a logistic line.

    Each document is summed by the model of the other half. Only counts by rounded sum and
    length come to the driver, at most 2 x 201 x 161 of them.
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t, b, h in zip(batch["t"], batch["bad"], batch["half"]):
                found, length = features(t)
                rows.append((int(b), round(4 * min(50.0, models[1 - int(h)].total(found))), round(4 * min(40.0, length))))
            yield pd.DataFrame(rows, columns=["bad", "e", "l"])

    rows = known.mapInPandas(place, "bad int, e int, l int").groupBy("bad", "e", "l").count().orderBy("bad", "e", "l")
    y, e, size, n = (np.array(c, dtype=float) for c in zip(*rows.collect()))
    rate = (y * n).sum() / n.sum()
    base = math.log(rate / (1 - rate))
    x = np.stack([np.ones_like(e), e / 4, size / 4, (size / 4) ** 2], axis=1)
    # a prior that leaves the sum as it is where the labels say nothing else
    middle, precision = np.array([base, 1.0, 0.0, 0.0]), np.array([0.1, 1.0, 1.0, 10.0])
    at = middle.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (n * (y - p)) - precision * (at - middle)
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.diag(precision), slope)
        at = at + step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return (float(at[0]) - base, *(float(v) for v in at[1:]))


def posterior(
    df: DataFrame, models: list[Model], rates: list[float], levels: list[str],
    text: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """``df``, or its columns to ``keep``, with ``bad_odds``: log odds that a document is bad in the likeliest way.

    ``models`` and their overall ``rates`` stand for the ways to be bad. ``levels`` name
    the columns of the places from the top down; null is a place of its own. An empty or
    null text has the form features alone. Without a model every document has its prior.
    """
    n = len(models)
    inner = {name: f"c{i}" for i, name in enumerate(df.columns)}
    body = inner[text]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t) for t in batch[body]]
            out = batch[carried].copy()
            for i, model in enumerate(models):
                out[f"e{i}"] = [model.evidence(*fs) for fs in found]
            yield out

    names = [c for c in df.columns if keep is None or c in keep or c in levels]
    carried = [inner[c] for c in names]
    fields = ", ".join(f"{inner[c]} {kind}" for c, kind in df.dtypes if c in names)
    more = "".join(f", e{i} double" for i in range(n))
    rows = stored(df.toDF(*inner.values()).mapInPandas(score, fields + more), "scored")
    out = rows
    for i in range(n):
        rate = min(max(rates[i], 1e-4), 1 - 1e-4)
        base = math.log(rate / (1 - rate))
        chance = 1 / (1 + F.exp(-(F.col(f"e{i}") + base)))
        above: list[str] = []
        prior = None
        for level in levels:
            above = [*above, inner[level]]
            here = rows.groupBy(*above).agg(F.sum(chance).alias("x"), F.count("*").alias("n"))
            if prior is None:
                here = here.withColumn("up", F.lit(rate))
            else:
                on = [here[c].eqNullSafe(prior[c]) for c in above[:-1]]
                here = here.join(prior, on).select(*[here[c] for c in above], "x", "n", "up")
            here = stored(here, "places")
            # the spread between places beyond chance sets the weight of the level above
            spread = here.agg(
                F.sum(F.col("n")).alias("n"),
                F.sum(F.col("n") * F.pow(F.col("x") / F.col("n") - F.col("up"), 2)).alias("v"),
                F.sum(F.col("up") * (1 - F.col("up"))).alias("w"),
                F.avg(F.col("up") * (1 - F.col("up"))).alias("m"),
            ).first()
            extra = ((spread.v or 0.0) - (spread.w or 0.0)) / max(1, spread.n or 1)
            weight = min(1e6, max(10.0, (spread.m or 0.0) / extra if extra > 0 else 1e6))
            place = here.select(*above, ((F.col("x") + weight * F.col("up")) / (F.col("n") + weight)).alias("up"))
            prior = place
        if prior is None:
            out = out.withColumn(f"p{i}", F.lit(base))
        else:
            named = prior.select(*[F.col(c).alias(f"l{j}") for j, c in enumerate(above)], F.col("up"))
            on = [F.col(c).eqNullSafe(F.col(f"l{j}")) for j, c in enumerate(above)]
            odds = F.log(F.col("up") / (1 - F.col("up")))
            out = out.join(stored(named, "priors"), on, "left").withColumn(f"p{i}", F.coalesce(odds, F.lit(base)))
            out = out.drop("up", *[f"l{j}" for j in range(len(above))])
    each = [F.col(f"e{i}") + F.col(f"p{i}") for i in range(n)]
    top = F.greatest(*each) if n > 1 else each[0] if n else F.lit(float("-inf"))
    return out.select(*[F.col(inner[c]).alias(c) for c in (keep or df.columns)], top.alias("bad_odds"))


#: What makes a document bad, as conditions on its labels.
WAYS = ("quality = 0", "toxic = 1")


def classify(
    df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None
) -> DataFrame:
    """``df`` with ``bad_odds`` and ``kept``: false where a document is more likely bad.

    ``keep`` names the columns to carry along, all by default.

    Labels are (key, quality, toxic), with nulls where not known. Documents of either kind
    are rejected. Rows stay as they are, repeated ones too; every null or empty text gets
    a decision. Without labels all are kept. Columns of these two names are replaced.
    """
    prepared(df.sparkSession)
    plain = df.drop("bad_odds", "kept")
    models = [learn(plain, labels, way, text, key) for way in WAYS]
    rates = []
    for way in WAYS:
        seen = labels.agg(F.avg(F.expr(way).cast("double"))).first()[0]
        rates.append(seen or 0.0)
    levels = [c for c in ("source", "lang") if c in plain.columns]
    out = posterior(plain, models, rates, levels, text, keep)
    return out.withColumn("kept", F.col("bad_odds") <= 0)
