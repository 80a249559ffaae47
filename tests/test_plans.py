"""What the plans look like: no Python in cleaning, pruned scans, bounded top-k, no
cross joins, and what is used twice computed once."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry
from querybook import RUN
from conftest import SMALL
from reviewloom.plans.report import report_chunks
from reviewloom.operators import inference, profile, ranking, sentiment, topics, words
from reviewloom.operators.clean import clean_reviews
from reviewloom.sources.response_cache import append_responses, read_responses

#: Queries that run jobs of their own while they are built.
EAGER = {
    "cache_first", "cache_lookup", "csv_scan", "full_analysis", "full_analysis_packed", "describe_numbers",
    "frequent_words", "distinct_sketches", "profile_merged",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    text = plan(df)
    return text.split("== Initial Plan ==")[0]


def test_cleaning_stays_in_the_jvm(tables):
    text = plan(clean_reviews(tables.raw()))
    assert "Python" not in text and "ArrowEval" not in text
    assert text.count("Exchange") == 1


def test_comments_are_cleaned_once_and_after_the_shuffle(tables):
    text = plan(profile.length_stats(clean_reviews(tables.raw())))
    below = text[text.rindex("Exchange") :]
    assert "Expand" not in text and "trim(" not in below


def test_missing_comments_and_dates_go_before_the_shuffle(tables):
    text = plan(clean_reviews(tables.raw()))
    assert "gettimestamp" in text[text.rindex("Exchange") :]


def test_scans_read_only_what_is_needed(tables):
    text = plan(profile.rating_distribution(tables.read("orders").withColumnRenamed("o_totalprice", "rating")))
    assert "ReadSchema: struct<o_totalprice:double>" in text
    assert "PushedFilters: [IsNotNull(o_totalprice)]" in text


def test_counts_are_partial_before_the_shuffle(tables):
    text = plan(words.word_frequency(tables.read("documents"), "text"))
    assert "TakeOrderedAndProject" in text
    assert text.index("functions=[count(1)]") < text.index("Exchange") < text.index("partial_count(1)")
    # The tokens are computed in one place only.
    assert text.count("regexp_extract_all") == 1


def test_first_appearance_needs_no_sort(tables):
    text = plan(words.word_frequency(tables.read("documents"), "text", first_seen=["doc_id"]))
    assert "SortAggregate" not in text and "HashAggregate" in text


def test_hot_prompt_is_split_in_the_lookup(spark, tmp_path):
    """Two thirds of the rows share a prompt; the limits are scaled down to the data."""
    limits = {
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {name: spark.conf.get(name, None) for name in limits}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(0, 60_000, 1, 8).selectExpr(
            "id as review_id", "if(id % 3 < 2, 'same', concat('text ', id)) as prompt"
        )
        keyed = inference.with_prompt_key(rows, "m")
        answer = ["'a' as content", "'m' as model", "'p' as provider", "5 as tokens_used"]
        answer += ["0.5D as response_time", "cast(null as double) as cost"]
        answers = keyed.where("review_id % 5 = 0").selectExpr("prompt_hash", *answer)
        append_responses(answers, str(tmp_path / "store"))
        cache = read_responses(spark, str(tmp_path / "store"))
        found = inference.cache_lookup(keyed, cache, ("review_id",))
        assert "skew=true" in final_plan(found)
        # The hot prompt is answered for all its rows, and so is every fifth of the rest.
        assert found.where("content = 'a'").count() == 44_000 and found.count() == 60_000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def test_top_k_per_group_is_cut_before_the_shuffle(tables):
    answers = tables.responses().select(F.col("sentiment_answer").alias("content"))
    text = plan(sentiment.top_emotions(sentiment.parse_sentiments(answers)))
    assert re.search(r"WindowGroupLimit.*Partial", text)
    answers = tables.responses().select(F.col("topic_answer").alias("content"))
    assert re.search(r"WindowGroupLimit.*Partial", plan(topics.topic_summary(topics.parse_topics(answers))))


def test_words_are_counted_once_for_ranking_and_vocabulary(tables):
    df = tables.read("documents").withColumnRenamed("text", "comment").withColumn("rating", F.lit(1.0))
    assert "ReusedExchange" in final_plan(profile.stats_bundle(df))


def test_boxes_and_points_share_one_count(tables):
    df = tables.read("documents").selectExpr("text as comment", "cast(doc_id % 5 as double) as rating")
    assert "ReusedExchange" in final_plan(profile.boxplot_stats(df))


def test_percentages_scan_once(tables):
    shares = ranking.value_percent(tables.read("orders"), "o_orderstatus")
    assert "ReusedExchange" in final_plan(shares)


def test_summary_scans_once(tables):
    text = plan(profile.data_summary(tables.read("documents").withColumnRenamed("text", "comment")))
    assert text.count("FileScan") == 1


def test_answers_are_parsed_once(tables):
    answers = tables.responses().select("review_id", F.col("sentiment_answer").alias("content"))
    parsed = sentiment.parse_sentiments(answers)
    assert plan(parsed).count("from_json") == 1
    assert plan(sentiment.sentiment_summary(parsed)).count("from_json") == 1
    assert plan(sentiment.top_emotions(parsed)).count("from_json") == 1
    answers = tables.responses().select("review_id", F.col("topic_answer").alias("content"))
    assert plan(topics.top_topics(topics.parse_topics(answers))).count("from_json") == 1


def test_prompts_are_hashed_once(tables, spark):
    keyed = inference.with_prompt_key(tables.read("documents").withColumnRenamed("text", "prompt"), "m")
    cache = spark.createDataFrame([("k", "c")], "prompt_hash string, content string")
    assert plan(inference.answers_per_prompt(keyed, cache)).count("md5(") == 1
    assert plan(inference.cache_misses(keyed, cache)).count("md5(") == 1


def test_prompts_are_not_shuffled_for_a_lookup(tables, spark):
    keyed = inference.with_prompt_key(tables.read("documents").withColumnRenamed("text", "prompt"), "m")
    cache = spark.createDataFrame([("k", "c")], "prompt_hash string, content string")
    text = plan(inference.cache_lookup(keyed, cache, ("doc_id",)))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    misses = plan(inference.cache_misses(keyed, cache))
    # Texts go through one shuffle: grouping and join ask for the same partitioning.
    assert misses.count("Exchange hashpartitioning(prompt_hash") == 2


@pytest.mark.parametrize("name", sorted(set(RUN) - EAGER))
def test_no_cross_joins(spark, name):
    text = plan(RUN[name](spark, SMALL))
    assert "CartesianProduct" not in text
    assert "NestedLoopJoin" not in text


def test_texts_stay_out_of_the_shuffle_where_few_columns_are_read(spark, tables):
    for name in ("row_count", "category_counts", "rating_distribution", "average_rating", "date_range"):
        text = plan(RUN[name](spark, SMALL))
        assert "Exchange" in text
        for line in text.split("\n"):
            if "Exchange" in line or "HashAggregate(keys=" in line:
                assert "comment" not in line and "text" not in line and "useful" not in line, line
    assert "md5" in text
    whole = plan(clean_reviews(tables.raw()))
    assert "comment" in next(line for line in whole.split("\n") if "HashAggregate(keys=" in line)


def test_a_lookup_does_not_aggregate_answers(spark, tables):
    text = plan(RUN["cache_lookup"](spark, SMALL))
    below = text[text.index("Join") :]
    answers = below.split("key_range")[0]
    assert "key_range" in below and "min(struct" not in text and answers.count("HashAggregate") <= 2


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["metric", "key", "value", "text"] and df.count() > 5


def test_whole_texts_are_not_shuffled_by_describe(tables):
    """Only the texts that begin like the most frequent one are sent by their text."""
    text = plan(profile.describe(tables.read("documents").select("text", "source")))
    assert len(re.findall(r"Exchange hashpartitioning\(column#\d+, text#\d+", text)) <= 1
    assert re.search(r"Exchange hashpartitioning\(column#\d+, key#\d+, ahead#\d+", text)


def test_statistics_gather_no_ratings_in_a_row(tables):
    df = tables.read("documents").withColumnRenamed("text", "comment").withColumn("rating", F.lit(1.0))
    assert "collect_list" not in plan(profile.stats_bundle(df))


def test_chunks_of_a_report(spark):
    lines = spark.range(2503).selectExpr("id", "concat('line ', id) as line")
    chunks = report_chunks(lines, [F.col("id")], F.col("line"), size=100).orderBy("chunk").collect()
    assert [c.lines for c in chunks] == [100] * 25 + [3]
    assert "\n".join(c.text for c in chunks).split("\n") == [f"line {i}" for i in range(2503)]
    assert report_chunks(lines.limit(0), [F.col("id")], F.col("line")).count() == 0
