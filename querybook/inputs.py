"""Inputs of the registered queries, derived from the driver's tables.

Reviews and model answers are made from ``documents``; the answers' moods, topics and
emotions come from the words of the text. Each formula is one SQL
expression that reads the same on both engines, so the Spark frame and the check's
common table expression come from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.text import SPACE_CLASS, WHITESPACE
from reviewloom.operators.clean import clean_reviews
from reviewloom.session import configure

RAW_FIELDS = {
    "review_id": "doc_id",
    "title": "concat('Review ', doc_id)",
    "customer_name": "concat('cust', doc_id % 97)",
    "rating": """case when doc_id % 23 = 0 then null when doc_id % 29 = 0 then 'no rating'
        when doc_id % 7 = 0 then '4.5 out of 5 stars'
        else concat(1 + doc_id % 5, '.0 out of 5 stars') end""",
    "date": """case when doc_id % 31 = 0 then '2018-10-01' when doc_id % 41 = 0 then null
        else concat('on ', 1 + doc_id % 28,
                    case when doc_id % 2 = 0 then ' September' else ' October' end, ' 2018') end""",
    "category": "source",
    "comments": "case when doc_id % 37 = 0 then null else concat('  ', text, ' ') end",
    "useful": """case doc_id % 4 when 0 then 'One person found this helpful'
        when 1 then concat(doc_id % 50, ' people found this helpful')
        when 2 then '' else null end""",
}


def _word(place: int | str) -> str:
    """The letters of a word of the text, by its place; negative ones count from the end."""
    return f"regexp_extract(split_part(coalesce(text, ''), ' ', {place}), '[A-Za-z]+', 0)"


def _times(piece: str) -> str:
    """How many characters the occurrences of a piece take in the text."""
    return f"(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{piece}', '')))"


_SIZE = "length(coalesce(text, ''))"
# The mood is the commoner one of two pieces of words; topics and emotions are words.
_MOOD = f"({_times('on')} - {_times('er')})"

RESPONSE_FIELDS = {
    "review_id": "doc_id",
    "sentiment_answer": f"""case when {_SIZE} % 13 = 0 then 'Mock response'
        when {_SIZE} % 19 = 0 then '[{{"sentiment":"positive"}}]'
        when {_SIZE} % 17 = 0 then concat('```json', chr(10),
            '{{"sentiment":"negative","confidence":0.7,"key_emotions":["', {_word(1)}, '"]}}', chr(10), '```')
        else concat('{{"sentiment":"',
            case when {_MOOD} > 0 then 'positive' when {_MOOD} < 0 then 'negative' else 'neutral' end,
            '","confidence":0.', abs({_MOOD}) % 10, ',"key_emotions":["', {_word(2)}, '","', {_word(-2)}, '"]}}') end""",
    "topic_answer": f"""case when {_SIZE} % 13 = 0 then 'Mock response'
        else concat('{{"main_topics":["', {_word(3)}, '","', {_word(-3)}, '"],"issues":["',
                    {_word(4)}, '"],"praise":["', {_word(-4)}, '"]}}') end""",
    "provider": f"case when {_SIZE} % 2 = 0 then 'provider_a' else 'provider_b' end",
    "model": "concat('model_', lang)",
    "tokens_used": f"cast(10 + {_SIZE} % 90 as int)",
    "response_time": f"cast({_SIZE} % 40 as double) / 8",
    "cost": "cast(null as double)",
}


class Tables:
    """The driver's tables and the inputs derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _derived(self, fields: dict[str, str]) -> DataFrame:
        documents = self.read("documents")
        return documents.select(*[F.expr(text).alias(name) for name, text in fields.items()])

    def raw(self) -> DataFrame:
        """Review texts as collected, every tenth twice."""
        copies = F.expr("case when review_id % 10 = 0 then array(1, 2) else array(1) end")
        return self._derived(RAW_FIELDS).withColumn("copy", F.explode(copies)).drop("copy")

    def clean(self, *columns: str) -> DataFrame:
        """Cleaned reviews, with the named columns only if there are any."""
        return clean_reviews(self.raw(), columns=columns or None)

    def responses(self, prompt: str = "text") -> DataFrame:
        """Model answers: good, fenced, an array where an object was due, no JSON."""
        return self._derived({**RESPONSE_FIELDS, "prompt": prompt})


# ---- the same inputs for the check


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _select(fields: dict[str, str]) -> str:
    return "select " + ", ".join(f"{text} as {name}" for name, text in fields.items())


SPACES = f"[{SPACE_CLASS}]+"
TOKENS = f"[^{SPACE_CLASS}]+"


def stripped(column: str) -> str:
    return f"trim({column}, {quoted(WHITESPACE)})"


RATING_SQL = r"try_cast(nullif(regexp_extract(rating, '\d+(\.\d+)?'), '') as double)"
RATING_INT_SQL = r"try_cast(nullif(regexp_extract(rating, '\d+'), '') as double)"
VOTES_SQL = (
    rf"coalesce(try_cast(nullif(regexp_extract(regexp_replace(lower(useful), 'one{SPACES}person[^\n]*', '1'),"
    r" '\d+'), '') as bigint), 0)"
)
DATE_SQL = (
    rf"try_strptime(regexp_replace(nullif(regexp_extract(lower(date), 'on{SPACES}\d{{1,2}}{SPACES}[a-z]+{SPACES}\d{{4}}'), ''),"
    rf" '{SPACES}', ' ', 'g'), 'on %d %B %Y')"
)
COMMENT_SQL = f"lower({stripped('comments')})"
ISO = "'%Y-%m-%dT%H:%M:%S'"

_CTES = {
    "raw": f"raw_once as ({_select(RAW_FIELDS)} from documents), "
    "raw as (select * from raw_once union all select * from raw_once where review_id % 10 = 0)",
    "clean": f"""review_parts as (select review_id, title, coalesce({RATING_SQL}, 0) as stars, {DATE_SQL} as day,
        category, {COMMENT_SQL} as body, {VOTES_SQL} as votes from (select distinct * from raw)),
      clean as (select review_id, title, stars as rating, day as date, category, body as comment, votes as useful
        from review_parts where day is not null and body is not null)""",
    "responses": f"responses as ({_select(RESPONSE_FIELDS)} from documents)",
}


def ctes(*names: str, **more: str) -> str:
    """``with`` clause: known inputs by name, then others as name=query."""
    needed = ["raw", *names] if "clean" in names and "raw" not in names else list(names)
    parts = [_CTES[name] for name in needed] + [f"{k} as ({v})" for k, v in more.items()]
    return "with " + ",\n".join(parts) + "\n"
