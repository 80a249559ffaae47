"""Prompts, answers and their aggregation."""

from uuid import uuid4

from pyspark.sql import functions as F

from reviewloom.operators import inference, prompts, sentiment, topics
from reviewloom.operators.calls import infer_batched as call_batched
from reviewloom.operators.inference import with_prompt_key
from reviewloom.plans.analysis import sentiment_prompts
from reviewloom.schema import CACHE_ENTRY
from reviewloom.session import shared_folder
from reviewloom.sources.response_cache import append_responses, read_responses

from .inputs import ctes, quoted
from .registry import query
from .standin import (
    REFUSED,
    confidence_sql,
    emotion_sql,
    list_client,
    rendered_sql,
    sentiment_label_sql,
    standin_client,
)

MODEL = "standin"
SYSTEM_PROMPT = "You read reviews."

_SENTIMENT_PROMPT = rendered_sql(prompts.SENTIMENT_PROMPT, feedback="comment")
_TOPIC_PROMPT = rendered_sql(prompts.TOPIC_PROMPT, comment="comment")


def _key(prompt: str) -> str:
    return f"md5('{MODEL}:' || {prompt})"


# ---- prompts


@query(
    "prompt_render",
    ctes("clean")
    + f"""select review_id, {_SENTIMENT_PROMPT} as sentiment_prompt, {_TOPIC_PROMPT} as topic_prompt from clean""",
)
def prompt_render(t):
    both = prompts.render(t.clean(), prompts.SENTIMENT_PROMPT, "sentiment_prompt", feedback="comment")
    both = prompts.render(both, prompts.TOPIC_PROMPT, "topic_prompt", comment="comment")
    return both.select("review_id", "sentiment_prompt", "topic_prompt")


@query(
    "prompt_key",
    ctes("clean")
    + f"""select review_id, {_key(f"{quoted(SYSTEM_PROMPT)} || chr(10) || chr(10) || {_SENTIMENT_PROMPT}")} as prompt_hash
from clean""",
)
def prompt_key(t):
    return sentiment_prompts(t.clean(), MODEL, SYSTEM_PROMPT).select("review_id", "prompt_hash")


ROWS_PER_BUCKET = 100

_PACKED = dict(
    keyed=f"select {_key(_SENTIMENT_PROMPT)} as prompt_hash, {_SENTIMENT_PROMPT} as prompt from clean",
    distinct_prompts="select distinct prompt_hash, prompt from keyed",
    bucketed=f"""select *, cast('0x' || substr(prompt_hash, 1, 8) as bigint)
 % (select cast(ceil(count(*) / cast({ROWS_PER_BUCKET} as double)) as bigint) from distinct_prompts) as bucket
 from distinct_prompts""",
    numbered="""select *, row_number() over (partition by bucket order by prompt_hash) - 1 as place from bucketed""",
    packed=f"""select concat(bucket, '-', place // 5) as batch_id, list(prompt_hash order by place) as keys,
 {quoted(prompts.PACKED_HEADING)} || string_agg(concat(place % 5 + 1, '. ', prompt, chr(10)), '' order by place) as prompt
 from numbered group by bucket, place // 5""",
)


def _packed(t):
    keyed = sentiment_prompts(t.clean(), MODEL).select("prompt_hash", "prompt")
    distinct = keyed.groupBy("prompt_hash").agg(F.any_value("prompt").alias("prompt"))
    return prompts.pack_prompts(distinct, 5, rows_per_bucket=ROWS_PER_BUCKET)


@query(
    "prompt_batches",
    ctes("clean", **_PACKED) + "select batch_id, array_to_string(keys, ',') as keys, prompt from packed",
)
def prompt_batches(t):
    return _packed(t).select("batch_id", F.array_join("keys", ",").alias("keys"), "prompt")


@query(
    "batch_unpack",
    ctes(
        "clean",
        **_PACKED,
        spread="""select batch_id, unnest(keys) as prompt_hash, generate_subscripts(keys, 1) - 1 as position,
 length(prompt) as n from packed""",
    )
    + f"""select batch_id, prompt_hash, cast(position as int) as position,
 case when position < n % 6 then {sentiment_label_sql("n + position")} else 'neutral' end as sentiment,
 case when position < n % 6 then {confidence_sql("n + position")} else 0.5 end as confidence
from spread""",
)
def batch_unpack(t):
    packed = _packed(t)
    answered = inference.infer(packed, standin_client, MODEL, "standin", keep=("batch_id", "keys"))
    parsed = sentiment.parse_sentiments(inference.unpack_answers(answered, "batch_id"))
    return parsed.select("batch_id", "prompt_hash", "position", "sentiment", "confidence")


# ---- parsing


def _fence_free(column: str) -> str:
    return f"""case when starts_with({column}, '```json')
 then replace(replace({column}, '```json' || chr(10), ''), '```', '')
 when starts_with({column}, '```') then replace(replace({column}, '```' || chr(10), ''), '```', '')
 else {column} end"""


def _read(kind: str) -> dict[str, str]:
    """Tables ``<kind>_bare`` (fence taken off) and ``<kind>_read`` (judged readable)."""
    bare = _fence_free(f"trim({kind}_answer, chr(10))")
    return {
        f"{kind}_bare": f"select *, trim({bare}, chr(10)) as answer from responses",
        f"{kind}_read": f"""select *,
 case when json_valid(answer) then json_type(answer) = 'OBJECT' else false end as readable from {kind}_bare""",
    }


PARSED = dict(
    **_read("sentiment"),
    parsed="""select review_id,
 case when readable then json_extract_string(answer, '$.sentiment') else 'neutral' end as sentiment,
 case when readable then cast(json_extract_string(answer, '$.confidence') as double) else 0.5 end as confidence,
 case when readable then json_extract_string(answer, '$.reasoning') else 'Parse error' end as reasoning,
 case when readable then cast(json_extract(answer, '$.key_emotions') as varchar[]) end as key_emotions
 from sentiment_read""",
)

TOPICS = dict(
    **_read("topic"),
    topics="""select review_id, cast(json_extract(answer, '$.main_topics') as varchar[]) as main_topics,
 cast(json_extract(answer, '$.issues') as varchar[]) as issues,
 cast(json_extract(answer, '$.praise') as varchar[]) as praise from topic_read where readable""",
)


def _sentiments(t):
    answers = t.responses().select("review_id", F.col("sentiment_answer").alias("content"))
    return sentiment.parse_sentiments(answers)


def _topics(t):
    answers = t.responses().select("review_id", F.col("topic_answer").alias("content"))
    return topics.parse_topics(answers)


@query(
    "parse_sentiment",
    ctes("responses", **PARSED)
    + """select review_id, sentiment, confidence, reasoning,
 array_to_string(key_emotions, '|') as key_emotions from parsed""",
)
def parse_sentiment(t):
    return _sentiments(t).withColumn("key_emotions", F.array_join("key_emotions", "|"))


@query(
    "parse_topics",
    ctes("responses", **TOPICS)
    + """select review_id, array_to_string(main_topics, '|') as main_topics,
 array_to_string(issues, '|') as issues, array_to_string(praise, '|') as praise from topics""",
)
def parse_topics(t):
    lists = {name: F.array_join(name, "|") for name in topics.RANKED}
    return _topics(t).withColumns(lists).select("review_id", *topics.RANKED)


# ---- inference


_ANSWERED = dict(
    sent=f"select review_id, length({_SENTIMENT_PROMPT}) as n, {_key(_SENTIMENT_PROMPT)} as prompt_hash from clean"
)
_ANSWER = f"{sentiment_label_sql('n')} as sentiment, {confidence_sql('n')} as confidence"


@query("infer_column", ctes("clean", **_ANSWERED) + f"select review_id, {_ANSWER}, n % 1000 as tokens_used from sent")
def infer_column(t):
    keyed = sentiment_prompts(t.clean(), MODEL)
    answered = inference.infer(keyed, standin_client, MODEL, "standin", keep=("review_id",))
    parsed = sentiment.parse_sentiments(answered)
    return parsed.select(
        "review_id", "sentiment", "confidence", F.col("tokens_used").cast("bigint").alias("tokens_used")
    )


@query(
    "infer_batched",
    ctes("clean", **_ANSWERED)
    + f"""select review_id, case when n % {REFUSED} = 0 then 'neutral' else {sentiment_label_sql('n')} end as sentiment,
 case when n % {REFUSED} = 0 then cast(0.5 as double) else {confidence_sql('n')} end as confidence,
 case when n % {REFUSED} <> 0 then n % 1000 end as tokens_used,
 case when n % {REFUSED} = 0 then 'ValueError: refused' end as error from sent""",
)
def infer_batched(t):
    """Calls of eight prompts, four in flight in each task; failing prompts by themselves."""
    keyed = sentiment_prompts(t.clean(), MODEL)
    answered = call_batched(
        keyed, list_client, MODEL, "standin", keep=("review_id",), batch_size=8, in_flight=4
    )
    parsed = sentiment.parse_sentiments(answered)
    return parsed.select(
        "review_id", "sentiment", "confidence", F.col("tokens_used").cast("bigint").alias("tokens_used"), "error"
    )


@query("cache_first", ctes("clean", **_ANSWERED) + f"select review_id, {_ANSWER}, prompt_hash from sent")
def cache_first(t):
    """Stores the answers in a fresh table of the shared folder, then looks them up."""
    path = f"{shared_folder(t.spark)}/responses-{uuid4().hex}"
    keyed = sentiment_prompts(t.clean(), MODEL)
    stored = inference.store_answers(keyed, path, standin_client, MODEL, "standin")
    answered = inference.cache_lookup(keyed, stored, ("review_id",))
    return sentiment.parse_sentiments(answered).select(
        "review_id", "sentiment", "confidence", "prompt_hash"
    )


_CACHE = dict(
    sent=f"select review_id, {_key('comment')} as prompt_hash, comment as prompt from clean",
    cache="""select md5('standin:' || lower(trim(text))) as prompt_hash, min(sentiment_answer) as content
 from documents join responses on doc_id = review_id where provider = 'provider_a' group by 1""",
)


def _cache_parts(t):
    """Comments as prompts, and a store that has the answers of one provider."""
    keyed = with_prompt_key(t.clean().withColumn("prompt", F.col("comment")), MODEL)
    answered = t.responses("lower(trim(text))").where(F.col("provider") == "provider_a")
    stored = with_prompt_key(answered, MODEL).withColumnRenamed("sentiment_answer", "content")
    stored = stored.select(*CACHE_ENTRY.names)
    return keyed, stored


@query(
    "cache_lookup",
    ctes("clean", "responses", **_CACHE)
    + "select review_id, prompt_hash, content is not null as hit from sent left join cache using (prompt_hash)",
)
def cache_lookup(t):
    """Through a store of its own, which is written first."""
    keyed, answers = _cache_parts(t)
    path = f"{shared_folder(t.spark)}/responses-{uuid4().hex}"
    append_responses(answers, path)
    found = inference.cache_lookup(keyed, read_responses(t.spark, path), ("review_id",))
    return found.select("review_id", "prompt_hash", F.col("content").isNotNull().alias("hit"))


@query(
    "cache_misses",
    ctes("clean", "responses", **_CACHE)
    + "select distinct prompt_hash, prompt from sent where prompt_hash not in (select prompt_hash from cache)",
)
def cache_misses(t):
    keyed, stored = _cache_parts(t)
    return inference.cache_misses(keyed, stored)


@query(
    "cache_stats",
    ctes(
        "clean",
        "responses",
        **_CACHE,
        found="select content is not null as hit from sent left join cache using (prompt_hash)",
    )
    + """select cast(count_if(hit) as bigint) as hits, cast(count_if(not hit) as bigint) as misses,
 count(*) as total, round(count_if(hit) * cast(100 as double) / count(*), 1) as hit_rate,
 (select count(*) from cache) as cache_size from found""",
)
def cache_stats(t):
    return inference.cache_stats(*_cache_parts(t))


@query(
    "model_timing",
    ctes("responses")
    + """select provider, model, count(*) as calls, avg(response_time) as avg_response_time,
 cast(sum(tokens_used) as bigint) as tokens_used, sum(cost) as cost from responses group by provider, model""",
)
def model_timing(t):
    return inference.model_timing(t.responses())


# ---- sentiment


def summary_sql(neutral: str, rows: str = "parsed") -> str:
    return f"""select total_comments, positive_count, round(positive_count / total_comments * 100, 2) as positive_percentage,
 negative_count, round(negative_count / total_comments * 100, 2) as negative_percentage,
 neutral_count, round(neutral_count / total_comments * 100, 2) as neutral_percentage,
 round(confidence / total_comments, 3) as average_confidence,
 case when positive_count > negative_count then 'positive' when negative_count > positive_count then 'negative'
  else 'neutral' end as overall_sentiment
from (select count(*) as total_comments, cast(count_if(sentiment = 'positive') as bigint) as positive_count,
 cast(count_if(sentiment = 'negative') as bigint) as negative_count, cast({neutral} as bigint) as neutral_count,
 sum(coalesce(confidence, 0)) as confidence from {rows})"""


EXACT_NEUTRAL = "count_if(sentiment = 'neutral')"
RESIDUAL_NEUTRAL = "count(*) - count_if(sentiment = 'positive') - count_if(sentiment = 'negative')"


@query("sentiment_summary", ctes("responses", **PARSED) + summary_sql(EXACT_NEUTRAL))
def sentiment_summary(t):
    return sentiment.sentiment_summary(_sentiments(t))


@query("sentiment_summary_residual", ctes("responses", **PARSED) + summary_sql(RESIDUAL_NEUTRAL))
def sentiment_summary_residual(t):
    return sentiment.sentiment_summary_residual(_sentiments(t))


def _bucket(name: str, condition: str) -> str:
    return f"select '{name}' as bucket, cast(count_if({condition}) as bigint) as count from parsed"


_LEVELS = {
    "high": "coalesce(confidence, 0) >= 0.8",
    "medium": "coalesce(confidence, 0) >= 0.6 and coalesce(confidence, 0) < 0.8",
    "low": "coalesce(confidence, 0) < 0.6",
}


@query(
    "confidence_buckets",
    ctes("responses", **PARSED)
    + " union all ".join(
        [
            _bucket(f"{level}_confidence_{label}", f"sentiment = '{label}' and {condition}")
            for label in ("positive", "negative")
            for level, condition in _LEVELS.items()
        ]
        + [_bucket("neutral", "coalesce(sentiment, 'neutral') not in ('positive', 'negative')")]
    ),
)
def confidence_buckets(t):
    return sentiment.confidence_buckets(_sentiments(t))


@query(
    "top_emotions",
    ctes(
        "responses",
        **PARSED,
        emotions="""select sentiment, unnest(key_emotions) as emotion from parsed
 where sentiment in ('positive', 'negative')""",
        counted="select sentiment, emotion, count(*) as count from emotions group by sentiment, emotion",
        ranked="""select sentiment, cast(row_number() over (partition by sentiment order by count desc, emotion) as int) as rank,
 emotion, count from counted""",
    )
    + "select * from ranked where rank <= 5",
)
def top_emotions(t):
    return sentiment.top_emotions(_sentiments(t))


@query(
    "polarity_trend",
    ctes("responses", **PARSED, summary=summary_sql(EXACT_NEUTRAL))
    + """select case when positive_percentage > negative_percentage then 'improving'
 when negative_percentage > positive_percentage then 'declining' else 'stable' end as trend,
 positive_percentage, negative_percentage from summary""",
)
def polarity_trend(t):
    return sentiment.polarity_trend(_sentiments(t))


@query(
    "summary_prompt",
    ctes(
        "responses",
        **PARSED,
        summary=summary_sql(EXACT_NEUTRAL),
        sentence="""select concat('Analyzed ', total_comments, ' comments: ', positive_count, ' positive, ',
 negative_count, ' negative, ', neutral_count, ' neutral') as feedback_summary from summary""",
        prompts=f"""select feedback_summary,
 {rendered_sql(prompts.SENTIMENT_PROMPT, feedback="feedback_summary")} as prompt from sentence""",
    )
    + "select feedback_summary, prompt, substr(prompt, 1, 200) as prompt_preview from prompts",
)
def summary_prompt(t):
    return sentiment.summary_prompt(sentiment.sentiment_summary(_sentiments(t)))


# ---- topics


def _top(field: str, name: str, k: int) -> str:
    return (
        ctes("responses", **TOPICS, items=f"select unnest({field}) as {name} from topics")
        + f"select {name}, count(*) as count from items group by {name} order by count desc, {name} limit {k}"
    )


@query("top_topics", _top("main_topics", "topic", 5))
def top_topics(t):
    return topics.top_topics(_topics(t))


@query("top_issues", _top("issues", "issue", 3))
def top_issues(t):
    return topics.top_issues(_topics(t))


@query("top_praise", _top("praise", "praise", 3))
def top_praise(t):
    return topics.top_praise(_topics(t))


@query(
    "topic_total",
    ctes("responses", **TOPICS)
    + "select cast(sum(len(main_topics)) as bigint) as total_topics_extracted from topics",
)
def topic_total(t):
    return topics.topic_total(_topics(t))


def ranking_sql(rows: str, field: str, k: int) -> str:
    """A JSON object of the k most frequent items, most frequent first."""
    return f"""(select coalesce('{{' || string_agg(to_json(item) || ':' || n, ',' order by n desc, item) || '}}', '{{}}')
 from (select item, count(*) as n from (select unnest({field}) as item from {rows}) group by item order by n desc, item limit {k}))"""


def names_sql(rows: str, field: str, k: int) -> str:
    return f"""(select '[' || string_agg(to_json(item), ',' order by n desc, item) || ']'
 from (select item, count(*) as n from (select unnest({field}) as item from {rows}) group by item order by n desc, item limit {k}))"""


@query(
    "topic_summary",
    ctes("responses", **TOPICS)
    + f"""select {names_sql("topics", "main_topics", 5)} as aggregated_topics, {ranking_sql("topics", "issues", 3)} as top_issues,
 {ranking_sql("topics", "praise", 3)} as top_praise,
 (select cast(sum(len(main_topics)) as bigint) from topics) as total_topics_extracted""",
)
def topic_summary(t):
    summary = topics.topic_summary(_topics(t))
    as_json = ("aggregated_topics", "top_issues", "top_praise")
    return summary.withColumns({name: F.to_json(name) for name in as_json})
