"""Aggregation of topic answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers
from ..functions.numbers import tally
from .ranking import explode_items, item_counts, top_k, top_k_per_group

#: Fields of a topic answer that are ranked.
RANKED = ("main_topics", "issues", "praise")


def parse_topics(df: DataFrame, content: str = "content") -> DataFrame:
    """M6: replace the answer text by its topic fields; unreadable answers go.

    They go as empty lists: a filter on the parsed answer would parse it once more.
    """
    keep = [name for name in df.columns if name != content]
    listed = answers.with_topic_list(df, content, "_list")
    read = explode_items(listed, F.col("_list"), "_answer", *keep)
    return read.where(F.col("_answer").isNotNull()).select(*keep, "_answer.*")


def _top(df: DataFrame, field: str, name: str, k: int, weight: str | None) -> DataFrame:
    return top_k(item_counts(df, answers.items(F.col(field)), name, weight), name, k)


def top_topics(df: DataFrame, k: int = 5, weight: str | None = None) -> DataFrame:
    """A7."""
    return _top(df, "main_topics", "topic", k, weight)


def top_issues(df: DataFrame, k: int = 3, weight: str | None = None) -> DataFrame:
    """A8."""
    return _top(df, "issues", "issue", k, weight)


def top_praise(df: DataFrame, k: int = 3, weight: str | None = None) -> DataFrame:
    """A9."""
    return _top(df, "praise", "praise", k, weight)


def topic_total(df: DataFrame, weight: str | None = None) -> DataFrame:
    """A10: topics named in all answers, repeats included."""
    size = F.size(answers.items(F.col("main_topics"))).cast("bigint")
    if weight:
        size = size * F.col(weight)
    total = F.coalesce(F.sum(size), F.lit(0)).cast("bigint")
    return df.agg(total.alias("total_topics_extracted"))


def topic_summary(
    df: DataFrame, topics: int = 5, issues: int = 3, praise: int = 3, weight: str | None = None
) -> DataFrame:
    """A7 to A10 as one row: topic names in order, two maps in order, the total.

    The three fields are counted together, in one pass over the answers.
    """

    def tagged(field: str):
        name = F.lit(field).alias("field")
        return F.transform(answers.items(F.col(field)), lambda item: F.struct(name, item.alias("item")))

    carried = [weight] if weight else []
    cells = F.concat(*[tagged(field) for field in RANKED])
    counts = (
        explode_items(df, cells, "cell", *carried)
        .groupBy("cell.field", "cell.item")
        .agg(tally(weight).alias("count"))
    )
    best = top_k_per_group(counts, "field", "item", max(topics, issues, praise))

    def ordered(field: str, k: int):
        kept = (F.col("field") == field) & (F.col("rank") <= k)
        return F.sort_array(F.collect_list(F.when(kept, F.struct("rank", "item", "count"))))

    def ranking(field: str, k: int):
        pairs = F.transform(ordered(field, k), lambda row: F.struct(row["item"], row["count"]))
        return F.map_from_entries(pairs)

    names = F.transform(ordered("main_topics", topics), lambda row: row["item"])
    total = counts.agg(tally("count", F.col("field") == "main_topics")).scalar()
    return best.agg(
        names.alias("aggregated_topics"),
        ranking("issues", issues).alias("top_issues"),
        ranking("praise", praise).alias("top_praise"),
    ).withColumn("total_topics_extracted", total)
