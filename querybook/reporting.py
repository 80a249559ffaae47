"""The report and the full analysis."""

from uuid import uuid4

from pyspark.sql import functions as F

from reviewloom.operators import prompts, profile, sentiment, topics
from reviewloom.plans.analysis import analyze
from reviewloom.plans.report import as_json, report_chunks as build_report_chunks, report_prompt as build_report_prompt
from reviewloom.session import shared_folder

from .answering import (
    MODEL,
    PARSED,
    RESIDUAL_NEUTRAL,
    TOPICS,
    names_sql,
    ranking_sql,
    summary_sql,
    _sentiments,
    _topics,
)
from .inputs import ISO, ctes
from .profiles import STATISTICS_CTES, STATISTICS_LINES
from .registry import query
from .standin import confidence_sql, rendered_sql, sentiment_label_sql, packing_client, standin_client


def _counts(column: str) -> str:
    return f"""(select '{{' || string_agg(to_json(cast(key as varchar)) || ':' || n, ',' order by n desc, cast(key as varchar)) || '}}'
 from (select {column} as key, count(*) as n from clean group by {column}))"""


DATA_JSON = f"""select '{{"total_records":' || count(*) || ',"categories":' || {_counts("category")}
 || ',"rating_distribution":' || {_counts("rating")} || ',"average_rating":' || to_json(avg(rating))
 || ',"comment_length_stats":{{"average":' || to_json(round(avg(length(comment)), 2)) || ',"median":'
 || to_json(round(median(length(comment)), 2)) || ',"min":' || min(length(comment)) || ',"max":' || max(length(comment))
 || '}},"date_range":{{"start":"' || strftime(min(date), {ISO}) || '","end":"' || strftime(max(date), {ISO}) || '"}}}}'
 as json from clean"""


def sentiment_json(rows: str) -> str:
    fields = [
        "total_comments",
        *[f"{label}_{kind}" for label in ("positive", "negative", "neutral") for kind in ("count", "percentage")],
        "average_confidence",
        "overall_sentiment",
    ]
    return f"""select '{{' || {" || ',' || ".join(f"'{chr(34)}{f}{chr(34)}:' || to_json({f})" for f in fields)} || '}}' as json
 from ({summary_sql(RESIDUAL_NEUTRAL, rows)})"""


def topic_json(rows: str) -> str:
    return f"""select '{{"aggregated_topics":' || {names_sql(rows, "main_topics", 5)} || ',"top_issues":' || {ranking_sql(rows, "issues", 3)}
 || ',"top_praise":' || {ranking_sql(rows, "praise", 3)} || ',"total_topics_extracted":'
 || (select cast(sum(len(main_topics)) as bigint) from {rows}) || '}}' as json"""


_REPORT_PROMPT = "select " + rendered_sql(
    prompts.SUMMARY_PROMPT,
    data_summary="(select json from data_json)",
    sentiment_results="(select json from sentiment_json)",
    topic_results="(select json from topic_json)",
) + " as prompt"


@query(
    "report_prompt",
    ctes(
        "clean",
        "responses",
        **PARSED,
        **TOPICS,
        data_json=DATA_JSON,
        sentiment_json=sentiment_json("parsed"),
        topic_json=topic_json("topics"),
    )
    + _REPORT_PROMPT,
)
def report_prompt(t):
    return build_report_prompt(
        profile.data_summary_row(t.clean()),
        sentiment.sentiment_summary_residual(_sentiments(t)),
        topics.topic_summary(_topics(t)),
    )


_LINES = """select 'categories' as metric, category as key, count(*) as n from clean where category is not null group by category
union all select 'rating_distribution', cast(rating as varchar), count(*) from clean where rating is not null group by rating"""


@query(
    "report_chunks",
    ctes(
        "clean",
        report_lines=_LINES,
        numbered="select *, row_number() over (order by metric, n desc, key) - 1 as number from report_lines",
    )
    + """select number // 10 as chunk, count(*) as "lines", string_agg(concat_ws(' ', metric, key, n), chr(10) order by number) as text
 from numbered group by number // 10""",
)
def report_chunks(t):
    """The counts of the summary as numbered chunks of ten lines."""
    lines = profile.data_summary(t.clean("category", "rating", "comment"))
    lines = lines.where(F.col("metric").isin("categories", "rating_distribution"))
    n = F.col("value").cast("bigint")
    order = [F.col("metric"), (-n).alias("least"), F.col("key")]
    return build_report_chunks(lines, order, F.concat_ws(" ", "metric", "key", n.cast("string")), size=10)


_SENT = rendered_sql(prompts.SENTIMENT_PROMPT, feedback="comment")
_TOPIC = rendered_sql(prompts.TOPIC_PROMPT, comment="comment")


_FULL_ANALYSIS = (
    ctes(
        "clean",
        **STATISTICS_CTES,
        sent=f"select length({_SENT}) as n, length({_TOPIC}) as m from clean",
        answered=f"select {sentiment_label_sql('n')} as sentiment, {confidence_sql('n')} as confidence from sent",
        topics="""select [concat('t', m % 9), concat('t', m % 4)] as main_topics, [concat('i', m % 6)] as issues,
 [concat('p', m % 5)] as praise from sent""",
        data_json=DATA_JSON,
        sentiment_json=sentiment_json("answered"),
        topic_json=topic_json("topics"),
        prompt=_REPORT_PROMPT,
        statistics=STATISTICS_LINES,
    )
    + """select 'data_summary' as section, cast(null as varchar) as metric, cast(null as varchar) as key,
 cast(null as double) as value, json as text from data_json
union all select 'sentiment_analysis', null, null, null, json from sentiment_json
union all select 'topic_extraction', null, null, null, json from topic_json
union all select 'final_summary', 'recommendations', null, null, 'Report on ' || length(prompt) || ' characters' from prompt
union all select 'statistics', metric, key, value, null from statistics"""
)


@query("full_analysis", _FULL_ANALYSIS)
def full_analysis(t):
    """The whole analysis over the whole table, every result in one tall frame."""
    return _tall(t, standin_client)


@query("full_analysis_packed", _FULL_ANALYSIS)
def full_analysis_packed(t):
    """The same with five prompts a request, some of which lack an answer."""
    return _tall(t, packing_client, batch_size=5, rows_per_bucket=100)


def _tall(t, client, **packing):
    work_dir = f"{shared_folder(t.spark)}/analysis-{uuid4().hex}"
    result = analyze(t.raw(), work_dir, {"standin": client}, MODEL, **packing)

    def lines(section, frame, metric, key, value, text):
        return frame.select(
            F.lit(section).alias("section"),
            metric.cast("string").alias("metric"),
            key.cast("string").alias("key"),
            value.cast("double").alias("value"),
            text.cast("string").alias("text"),
        )

    none = F.lit(None)
    tall = lines("statistics", result.statistics, F.col("metric"), F.col("key"), F.col("value"), none)
    for section in ("data_summary", "sentiment_analysis", "topic_extraction"):
        row = as_json(getattr(result, section))
        tall = tall.unionByName(lines(section, row, none, none, none, F.col("json")))
    report = lines("final_summary", result.final_summary, F.col("insight_type"), none, none, F.col("report"))
    return tall.unionByName(report)
