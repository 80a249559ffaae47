"""Profiles."""

from uuid import uuid4

from pyspark.sql import functions as F

from reviewloom.functions import parsing
from reviewloom.operators import increments, profile, ranking
from reviewloom.session import shared_folder

from .inputs import ISO, TOKENS, VOTES_SQL, ctes
from .registry import query


def _lengths(column: str, table: str) -> str:
    return f"(select length({column}) as length from {table} where {column} is not null)"


@query("row_count", ctes("clean") + "select count(*) as count from clean")
def row_count(t):
    return profile.row_count(t.clean("rating"))


@query("category_counts", ctes("clean") + "select category, count(*) as count from clean group by category")
def category_counts(t):
    return profile.category_counts(t.clean("category"))


@query("rating_counts", ctes("clean") + "select rating, count(*) as count from clean group by rating")
def rating_counts(t):
    return profile.rating_counts(t.clean("rating"))


@query(
    "rating_distribution",
    ctes("clean") + "select rating, count(*) as count from clean group by rating order by rating",
)
def rating_distribution(t):
    return profile.rating_distribution(t.clean("rating"))


@query("average_rating", ctes("clean") + "select avg(rating) as average_rating from clean")
def average_rating(t):
    return profile.average_rating(t.clean("rating"))


@query("distinct_ratings", ctes("clean") + "select distinct rating from clean order by rating")
def distinct_ratings(t):
    return profile.distinct_ratings(t.clean("rating"))


@query(
    "length_stats",
    ctes("clean")
    + f"""select round(avg(length), 2) as average, round(median(length), 2) as median,
 cast(min(length) as int) as min, cast(max(length) as int) as max from {_lengths("comment", "clean")}""",
)
def length_stats(t):
    return profile.length_stats(t.clean())


@query(
    "column_length",
    "select round(avg(length), 2) as avg_length, round(median(length), 2) as median_length from "
    + _lengths("cast(user_id as varchar)", "events"),
)
def column_length(t):
    return profile.column_length(t.read("events"), "user_id")


@query(
    "date_range",
    ctes("clean") + f"""select strftime(min(date), {ISO}) as "start", strftime(max(date), {ISO}) as "end" from clean""",
)
def date_range(t):
    return profile.date_range(t.clean("date"))


SUMMARY_LINES = f"""
select 'total_records' as metric, cast(null as varchar) as key, cast(count(*) as double) as value, cast(null as varchar) as text from clean
union all select 'average_rating', null, avg(rating), null from clean
union all select 'date_range', 'start', null, strftime(min(date), {ISO}) from clean
union all select 'date_range', 'end', null, strftime(max(date), {ISO}) from clean
union all select 'comment_length_stats', 'average', round(avg(length(comment)), 2), null from clean
union all select 'comment_length_stats', 'median', round(median(length(comment)), 2), null from clean
union all select 'comment_length_stats', 'min', min(length(comment)), null from clean
union all select 'comment_length_stats', 'max', max(length(comment)), null from clean
union all select 'categories', category, count(*), null from clean group by category
union all select 'rating_distribution', cast(rating as varchar), count(*), null from clean group by rating
"""


@query("data_summary", ctes("clean") + SUMMARY_LINES)
def data_summary(t):
    return profile.data_summary(t.clean())


_RAW_COLUMNS = ["review_id", "title", "customer_name", "rating", "date", "category", "comments", "useful"]


@query(
    "null_counts",
    ctes("raw")
    + " union all ".join(
        f"""select '{c}' as "column", count(*) - count({c}) as null_count from raw""" for c in _RAW_COLUMNS
    ),
)
def null_counts(t):
    return profile.null_counts(t.raw())


@query(
    "distinct_counts",
    ctes("raw")
    + " union all ".join(
        f"""select '{c}' as "column", count(distinct {c}) as distinct_count from raw""" for c in _RAW_COLUMNS
    ),
)
def distinct_counts(t):
    return profile.distinct_counts(t.raw())


@query(
    "duplicate_count",
    ctes("raw")
    + "select (select count(*) from raw) - (select count(*) from (select distinct * from raw)) as duplicate_rows",
)
def duplicate_count(t):
    return profile.duplicate_count(t.raw())


@query("value_counts", "select event_type, count(*) as count from events group by event_type")
def value_counts(t):
    return ranking.value_counts(t.read("events"), "event_type")


@query(
    "value_percent",
    ctes("raw", votes=f"select {VOTES_SQL} as useful from raw")
    + """select useful, cast(100 as double) * count(*) / (select count(*) from votes) as percent
from votes group by useful""",
)
def value_percent(t):
    votes = t.raw().select(parsing.useful_votes(F.col("useful")).alias("useful"))
    return ranking.value_percent(votes, "useful")


def _numbers(column: str, table: str) -> str:
    return f"""select '{column}' as "column", count({column}) as count,
 round(avg({column}), 4) as mean, round(stddev_samp({column}), 4) as std,
 round(cast(min({column}) as double), 4) as min, round(quantile_cont({column}, 0.25), 4) as q25,
 round(quantile_cont({column}, 0.5), 4) as median, round(quantile_cont({column}, 0.75), 4) as q75,
 round(cast(max({column}) as double), 4) as max from {table}"""


@query(
    "describe_numbers",
    " union all ".join(_numbers(c, "orders") for c in ("o_orderkey", "o_custkey", "o_totalprice")),
)
def describe_numbers(t):
    orders = t.read("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return profile.describe(orders, digits=4)


def _texts(column: str) -> str:
    return f"""select '{column}' as "column", count({column}) as count, count(distinct {column}) as "unique",
 (select {column} from raw where {column} is not null group by {column} order by count(*) desc, {column} limit 1) as top,
 (select max(n) from (select count(*) as n from raw where {column} is not null group by {column})) as freq from raw"""


@query("describe_texts", ctes("raw") + " union all ".join(_texts(c) for c in _RAW_COLUMNS if c != "review_id"))
def describe_texts(t):
    return profile.describe(t.raw().drop("review_id"))


_ORDERS = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderdate": "timestamp",
    "o_orderpriority": "string",
}


@query(
    "schema_profile",
    " union all ".join(
        f"""select {i} as position, '{c}' as "column", '{kind}' as dtype, count({c}) as non_null,
 count(*) as "rows" from orders"""
        for i, (c, kind) in enumerate(_ORDERS.items())
    ),
)
def schema_profile(t):
    # The test tables hold timestamps without a zone; both kinds are shown as one.
    orders = t.read("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return profile.schema_profile(orders)


_BOXES = dict(
    points=f"select rating, len(regexp_extract_all(comment, '{TOKENS}')) as word_count from clean",
    boxes="""select rating, count(*) as count, quantile_cont(word_count, 0.25) as q1,
 quantile_cont(word_count, 0.5) as median, quantile_cont(word_count, 0.75) as q3
 from points group by rating""",
    marked="""select p.rating, p.word_count, b.count, b.q1, b.median, b.q3,
 p.word_count between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
 from points p join boxes b on p.rating = b.rating""",
)


@query(
    "boxplot_stats",
    ctes("clean", **_BOXES)
    + """select rating, count, q1, median, q3,
 least(min(case when inside then cast(word_count as double) end), q1) as whisker_low,
 greatest(max(case when inside then cast(word_count as double) end), q3) as whisker_high,
 cast(sum(case when inside then 0 else 1 end) as bigint) as outliers
 from marked group by rating, count, q1, median, q3""",
)
def boxplot_stats(t):
    return profile.boxplot_stats(t.clean())


@query(
    "boxplot_outliers",
    ctes("clean", **_BOXES)
    + """select rating, cast(word_count as int) as word_count, count(*) as n from marked
 where not inside group by rating, word_count""",
)
def boxplot_outliers(t):
    return profile.boxplot_outliers(t.clean())


STATISTICS_CTES = dict(
    words=f"select unnest(regexp_extract_all(lower(comment), '{TOKENS}')) as word from clean",
    counted="select word, count(*) as n from words group by word",
)
STATISTICS_LINES = """
select 'count' as metric, cast(null as varchar) as key, cast(count(*) as double) as value from clean
union all select 'avg_length', null, round(avg(length(comment)), 2) from clean
union all select 'median_length', null, round(median(length(comment)), 2) from clean
union all select 'rating_distribution', cast(rating as varchar), count(*) from clean group by rating
union all select 'total_unique_words', null, count(*) from counted
union all select 'word_frequency', word, n from (select * from counted order by n desc, word limit 10)
"""


@query("stats_bundle", ctes("clean", **STATISTICS_CTES) + STATISTICS_LINES)
def stats_bundle(t):
    return profile.stats_bundle(t.clean())


# ---- states that merge: two loads, each written by itself


def _loads(t, rows, state):
    """The states of two halves of the rows, written and read."""
    for rest in (0, 1):
        path = f"{shared_folder(t.spark)}/state-{uuid4().hex}"
        state(rows.where(F.col("review_id") % 2 == rest)).write.parquet(path)
        yield t.spark.read.parquet(path)


@query(
    "distinct_sketches",
    ctes("raw")
    + " union all ".join(
        f"""select '{c}' as "column", count(distinct {c}) as distinct_count, true as within_five_percent from raw"""
        for c in _RAW_COLUMNS
    ),
)
def distinct_sketches(t):
    """Sketches of two loads, merged, beside the exact counts."""
    raw = t.raw()
    merged = increments.merged_sketches(*_loads(t, raw, increments.distinct_sketches))
    estimate = increments.estimated_counts(merged).withColumnRenamed("distinct_count", "estimate")
    exact = F.col("distinct_count")
    within = F.abs(F.col("estimate") - exact) <= F.lit(0.05) * exact
    return profile.distinct_counts(raw).join(estimate, "column").select(
        "column", "distinct_count", within.alias("within_five_percent")
    )


def _kind(kind: str, value: str) -> str:
    return f"""select '{kind}' as kind, count({value}) as count, round(avg({value}), 6) as mean,
 cast(min({value}) as double) as min, quantile_cont(cast({value} as double), 0.25) as q25,
 quantile_cont(cast({value} as double), 0.5) as median, quantile_cont(cast({value} as double), 0.75) as q75,
 cast(max({value}) as double) as max from clean"""


@query(
    "profile_merged",
    ctes("clean")
    + " union all ".join(
        [
            _kind("length", "length(comment)"),
            _kind("words", f"len(regexp_extract_all(comment, '{TOKENS}'))"),
            _kind("rating", "rating"),
        ]
    ),
)
def profile_merged(t):
    """The profile of all reviews from the states of two loads."""
    state = increments.merged_states(*_loads(t, t.clean(), increments.profile_state))
    return increments.state_statistics(state).withColumn("mean", F.round("mean", 6))
