"""Profile of a table: counts, distributions, lengths, nulls, quartiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions import parsing
from ..functions import text as textfn
from ..functions.keys import distinct_key, row_key
from ..functions.numbers import tally
from .clean import lower_headers, numeric_rating, require_columns
from .quantiles import exact_quantiles, histogram_quantiles
from .ranking import value_counts
from .words import vocabulary, word_counts


def row_count(df: DataFrame) -> DataFrame:
    """P1."""
    return df.agg(tally().alias("count"))


def category_counts(df: DataFrame) -> DataFrame:
    """P2."""
    return value_counts(df, "category")


def rating_counts(df: DataFrame) -> DataFrame:
    """P3."""
    return value_counts(df, "rating")


def rating_distribution(df: DataFrame) -> DataFrame:
    """Counts in rating order."""
    require_columns(df, "rating")
    counts = df.where(F.col("rating").isNotNull()).groupBy("rating").agg(tally().alias("count"))
    return counts.orderBy("rating")


def average_rating(df: DataFrame) -> DataFrame:
    """P5: zeros count, nulls do not."""
    require_columns(df, "rating")
    return df.agg(F.avg(numeric_rating(df)).alias("average_rating"))


def distinct_ratings(df: DataFrame) -> DataFrame:
    """L5."""
    require_columns(df, "rating")
    return df.select("rating").distinct().orderBy("rating")


def _length_counts(df: DataFrame, column: str) -> DataFrame:
    """(length, n) of a column's text: as many rows as there are lengths.

    Missing texts stay as one row with a null length. A filter on the column would
    be moved below the cleaning and compute the cleaned text twice.
    """
    require_columns(df, column)
    length = F.length(F.col(column).cast("string"))
    return df.select(length.alias("length")).groupBy("length").agg(tally().alias("n"))


def _mean_length() -> Column:
    texts = F.sum(F.when(F.col("length").isNotNull(), F.col("n")))
    return F.round(F.try_divide(F.sum(F.col("length") * F.col("n")), texts), 2)


def _median_length() -> Column:
    return F.round(histogram_quantiles(F.col("length"), [0.5], F.col("n"))[0], 2)


def length_stats(df: DataFrame, column: str = "comment") -> DataFrame:
    """Average, median, min and max length in code points."""
    return _length_counts(df, column).agg(
        _mean_length().alias("average"),
        _median_length().alias("median"),
        F.min("length").alias("min"),
        F.max("length").alias("max"),
    )


def column_length(df: DataFrame, column: str = "comment") -> DataFrame:
    """Average and median length of any column as text."""
    return _length_counts(df, column).agg(
        _mean_length().alias("avg_length"), _median_length().alias("median_length")
    )


def date_range(df: DataFrame) -> DataFrame:
    """P8, F6."""
    require_columns(df, "date")
    return df.agg(
        parsing.iso_text(F.min("date")).alias("start"), parsing.iso_text(F.max("date")).alias("end")
    )


def _summary_groups(df: DataFrame) -> DataFrame:
    """All counts behind the summary, from one scan and one small shuffle.

    Grouping sets over category, rating and comment length turn the table into as
    many rows as there are categories, ratings and lengths, plus one for the whole.
    """
    df = lower_headers(df)
    comment = "comments" if "comments" in df.columns else "comment"
    require_columns(df, comment)
    has = {name: name in df.columns for name in ("category", "rating", "date")}
    narrow = df.select(
        (F.col("category") if has["category"] else F.lit(None).cast("string")).alias("category"),
        (numeric_rating(df) if has["rating"] else F.lit(None).cast("double")).alias("rating"),
        (F.col("date") if has["date"] else F.lit(None).cast("timestamp")).alias("date"),
        F.length(F.col(comment).cast("string")).alias("length"),
    )
    grouped = narrow.groupingSets(
        [["category"], ["rating"], ["length"], []], "category", "rating", "length"
    ).agg(
        F.grouping_id().alias("grouping"),
        tally().alias("n"),
        F.avg("rating").alias("average_rating"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
    )
    # An empty table has no groups at all: this row stands for the whole of it.
    whole = df.sparkSession.range(1).select(
        F.lit(0b111).cast("bigint").alias("grouping"), F.lit(0).cast("bigint").alias("n")
    )
    grouped = grouped.unionByName(whole, allowMissingColumns=True)
    # grouping_id has a bit set for every column that is *not* grouped by.
    kind = (
        F.when(F.col("grouping") == 0b011, F.lit("category"))
        .when(F.col("grouping") == 0b101, F.lit("rating"))
        .when(F.col("grouping") == 0b110, F.lit("length"))
        .otherwise(F.lit("whole"))
    )
    return (
        grouped.withColumn("kind", kind)
        .groupBy("kind", "category", "rating")
        .agg(
            F.sum("n").alias("n"),
            F.max("average_rating").alias("average_rating"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.struct(
                _mean_length().alias("average"),
                _median_length().alias("median"),
                F.min("length").alias("min"),
                F.max("length").alias("max"),
            ).alias("lengths"),
        )
    )


def data_summary(df: DataFrame) -> DataFrame:
    """P9 in tall form: (metric, key, value, text); dates are in ``text``."""

    def line(metric: str, key, value=None, text=None) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            (key if isinstance(key, Column) else F.lit(key)).cast("string").alias("key"),
            (F.lit(None) if value is None else value).cast("double").alias("value"),
            (F.lit(None) if text is None else text).cast("string").alias("text"),
        )

    lines = (
        F.when(
            F.col("kind") == "whole",
            F.array(
                line("total_records", None, F.col("n")),
                line("average_rating", None, F.col("average_rating")),
                line("date_range", "start", text=parsing.iso_text(F.col("start"))),
                line("date_range", "end", text=parsing.iso_text(F.col("end"))),
            ),
        )
        .when(
            F.col("kind") == "length",
            F.array(
                *[
                    line("comment_length_stats", part, F.col(f"lengths.{part}"))
                    for part in ("average", "median", "min", "max")
                ]
            ),
        )
        .when(
            (F.col("kind") == "category") & F.col("category").isNotNull(),
            F.array(line("categories", F.col("category"), F.col("n"))),
        )
        .when(
            (F.col("kind") == "rating") & F.col("rating").isNotNull(),
            F.array(line("rating_distribution", F.col("rating"), F.col("n"))),
        )
    )
    return _summary_groups(df).select(F.explode(lines).alias("line")).select("line.*")


def data_summary_row(df: DataFrame) -> DataFrame:
    """P9 as one row: scalars, two maps ordered by count, length and date structs.

    The maps are part of one row, as in a report; for a column with very many
    categories read the tall form.
    """

    def one(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    def counts(kind: str, column: str) -> Column:
        pair = F.struct(
            (-F.col("n")).alias("order"), F.col(column).cast("string").alias("key"), F.col("n")
        )
        present = (F.col("kind") == kind) & F.col(column).isNotNull()
        ordered = F.sort_array(F.collect_list(F.when(present, pair)))
        return F.map_from_entries(F.transform(ordered, lambda p: F.struct(p["key"], p["n"])))

    return _summary_groups(df).agg(
        one("whole", "n").alias("total_records"),
        counts("category", "category").alias("categories"),
        counts("rating", "rating").alias("rating_distribution"),
        one("whole", "average_rating").alias("average_rating"),
        one("length", "lengths").alias("comment_length_stats"),
        F.struct(
            parsing.iso_text(one("whole", "start")).alias("start"),
            parsing.iso_text(one("whole", "end")).alias("end"),
        ).alias("date_range"),
    )


def _by_column(row: DataFrame, columns: list[str], *fields: str) -> DataFrame:
    """Turn one row of structs, one per column, into one row per column."""
    cells = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}`.{f}").alias(f) for f in fields])
        for c in columns
    ]
    return row.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def null_counts(df: DataFrame) -> DataFrame:
    """P10: (column, null_count)."""
    row = df.agg(
        *[
            F.struct(tally(when=F.col(f"`{c}`").isNull()).alias("null_count")).alias(c)
            for c in df.columns
        ]
    )
    return _by_column(row, df.columns, "null_count")


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, distinct_count), nulls left out.

    The exact form shuffles each column's distinct values once; long texts travel as
    16-byte digests. The approximate form keeps one sketch per column.
    """

    def count(field) -> Column:
        column = F.col(f"`{field.name}`")
        if approximate:
            return F.approx_count_distinct(column)
        return F.count_distinct(distinct_key(column, field.dataType))

    row = df.agg(
        *[F.struct(count(f).alias("distinct_count")).alias(f.name) for f in df.schema.fields]
    )
    return _by_column(row, df.columns, "distinct_count")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows.

    Counts digests of rows, so the rows themselves are not shuffled.
    """
    groups = df.select(row_key(df).alias("key")).groupBy("key").agg(tally().alias("n"))
    extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint")
    return groups.agg(extra.alias("duplicate_rows"))


def describe(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Statistics per column, numbers if there are any, else texts.

    Numbers: count, mean, std, min, q25, median, q75, max (quartiles exact and
    interpolated). Texts: count, unique, top (ties by value), freq.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    return _describe_numbers(df, numeric, digits) if numeric else _describe_texts(df)


def _describe_numbers(df: DataFrame, columns: list[str], digits: int | None) -> DataFrame:
    numbers = df.select(
        *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(c) for c in columns]
    )
    moments = numbers.agg(
        *[
            F.struct(
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
            ).alias(c)
            for c in (f"`{name}`" for name in columns)
        ]
    ).toDF(*columns)
    moments = _by_column(moments, columns, "count", "mean", "std", "min", "max")
    quartiles = (
        exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        .groupBy("column")
        .agg(
            *[
                F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name)
                for p, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))
            ]
        )
    )
    result = moments.join(quartiles, "column", "left")
    order = ["mean", "std", "min", "q25", "median", "q75", "max"]
    shown = [F.col(c) if digits is None else F.round(c, digits).alias(c) for c in order]
    return result.select("column", "count", *shown)


#: Characters of a text that go with its digest, to order texts that occur equally often.
_AHEAD = 64


def _cells(df: DataFrame, **values) -> DataFrame:
    """A row (column, *values) for every cell; values are functions of a column's text."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                *[make(F.col(f"`{c}`").cast("string")).alias(name) for name, make in values.items()],
            )
            for c in df.columns
        ]
    )
    return df.select(F.explode(cells).alias("cell")).select("cell.*")


def _describe_texts(df: DataFrame) -> DataFrame:
    """Texts are counted by digest and first characters, so whole ones stay where they are.

    The second scan counts by text, but only those that begin like the most frequent one
    of their column; it has few texts to send.
    """

    def key(text: Column) -> Column:
        return distinct_key(text, StringType())

    def ahead(text: Column) -> Column:
        return F.substring(text, 1, _AHEAD)

    counts = _cells(df, key=key, ahead=ahead).groupBy("column", "key", "ahead").agg(tally().alias("n"))
    present = F.col("key").isNotNull()
    best = F.min(F.when(present, F.struct((-F.col("n")).alias("n"), "ahead")))
    totals = counts.groupBy("column").agg(
        tally("n", present).alias("count"), tally(when=present).alias("unique"), best.alias("best")
    )
    # one short row per column of the table
    leaders = F.broadcast(totals.select("column", F.col("best.ahead").alias("ahead")))
    texts = _cells(df, ahead=ahead, text=lambda text: text).join(leaders, ["column", "ahead"])
    top = (
        texts.groupBy("column", "text")
        .agg(tally().alias("n"))
        .groupBy("column")
        .agg(F.min(F.struct((-F.col("n")).alias("n"), "text"))["text"].alias("top"))
    )
    return totals.join(top, "column", "left").select(
        "column", "count", "unique", "top", (-F.col("best.n")).alias("freq")
    )


def schema_profile(df: DataFrame) -> DataFrame:
    """(position, column, dtype, non_null, rows), one row per column."""
    row = df.agg(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(dtype).alias("dtype"),
                F.count(f"`{name}`").alias("non_null"),
                tally().alias("rows"),
            ).alias(name)
            for position, (name, dtype) in enumerate(df.dtypes)
        ]
    )
    profile = _by_column(row, df.columns, "position", "dtype", "non_null", "rows")
    return profile.select("position", "column", "dtype", "non_null", "rows")


def _word_count_boxes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Word counts per rating, counted, and their quartiles."""
    require_columns(df, "rating", "comment")
    counted = (
        df.select("rating", textfn.word_count(F.col("comment")).alias("word_count"))
        .groupBy("rating", "word_count")
        .agg(tally().alias("n"))
    )
    box = counted.groupBy("rating").agg(
        tally("n", F.col("word_count").isNotNull()).alias("count"),
        histogram_quantiles(F.col("word_count"), [0.25, 0.5, 0.75], F.col("n")).alias("q"),
    )
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    bounds = box.select(
        "rating",
        "count",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
        (F.col("q")[0] - reach).alias("lowest"),
        (F.col("q")[2] + reach).alias("highest"),
    )
    return counted, bounds


def boxplot_stats(df: DataFrame) -> DataFrame:
    """Box of the word counts per rating, whiskers at the last point within
    1.5 times the quartile range, and the number of points beyond them."""
    counted, bounds = _word_count_boxes(df)
    inside = F.col("word_count").between(F.col("lowest"), F.col("highest"))
    lowest_inside = F.min(F.when(inside, F.col("word_count")))
    highest_inside = F.max(F.when(inside, F.col("word_count")))
    boxes = ["rating", "count", "q1", "median", "q3"]
    return (
        counted.join(bounds, "rating")
        .groupBy(*boxes)
        .agg(
            lowest_inside.cast("double").alias("low"),
            highest_inside.cast("double").alias("high"),
            tally("n", ~inside).alias("outliers"),
        )
        .select(
            *boxes,
            F.least("low", "q1").alias("whisker_low"),
            F.greatest("high", "q3").alias("whisker_high"),
            "outliers",
        )
    )


def boxplot_outliers(df: DataFrame) -> DataFrame:
    """The points beyond the whiskers, as (rating, word_count, n)."""
    counted, bounds = _word_count_boxes(df)
    beyond = ~F.col("word_count").between(F.col("lowest"), F.col("highest"))
    return counted.join(bounds, "rating").where(beyond).select("rating", "word_count", "n")


def _statistic(metric: str, key: Column | None, value: Column) -> Column:
    return F.struct(
        F.lit(metric).alias("metric"),
        (F.lit(None) if key is None else key).cast("string").alias("key"),
        value.cast("double").alias("value"),
    )


def summary_statistics(summary: DataFrame) -> DataFrame:
    """P18 from a one-row summary: count, lengths and ratings in tall form."""
    scalars = F.array(
        _statistic("count", None, F.col("total_records")),
        _statistic("avg_length", None, F.col("comment_length_stats.average")),
        _statistic("median_length", None, F.col("comment_length_stats.median")),
    )
    ratings = F.transform(
        F.map_entries("rating_distribution"),
        lambda entry: _statistic("rating_distribution", entry["key"], entry["value"]),
    )
    lines = F.explode(F.concat(scalars, ratings)).alias("line")
    return summary.select(lines).select("line.*")


def word_statistics(df: DataFrame, column: str = "comment", k: int = 10) -> DataFrame:
    """P18 from the words: the k most frequent ones and the vocabulary in tall form.

    The words are counted once for both.
    """
    counts = word_counts(df, column)
    top = counts.orderBy(F.desc("count"), "word").limit(k)
    size = counts.agg(vocabulary().alias("n"))
    frequency = _statistic("word_frequency", F.col("word"), F.col("count")).alias("line")
    total = _statistic("total_unique_words", None, F.col("n")).alias("line")
    return top.select(frequency).unionByName(size.select(total)).select("line.*")


def stats_bundle(df: DataFrame, column: str = "comment", k: int = 10) -> DataFrame:
    """Count, lengths, word frequency and rating distribution in tall form."""
    require_columns(df, column)
    summary = data_summary(df.withColumn("comments", F.col(column)))
    metric = (
        F.when(F.col("metric") == "total_records", "count")
        .when((F.col("metric") == "comment_length_stats") & (F.col("key") == "average"), "avg_length")
        .when((F.col("metric") == "comment_length_stats") & (F.col("key") == "median"), "median_length")
        .when(F.col("metric") == "rating_distribution", "rating_distribution")
    )
    key = F.when(F.col("metric") == "rating_distribution", F.col("key"))
    lines = summary.select(metric.alias("metric"), key.alias("key"), "value").where("metric is not null")
    return lines.unionByName(word_statistics(df, column, k))
