"""Schemas of the tables that flow through the library."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields):
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


#: A review file as it arrives: seven text columns under their original headers.
RAW_REVIEWS = StructType(
    [
        StructField(name, StringType(), True)
        for name in (
            "Review Title",
            "Customer name",
            "Rating",
            "Date",
            "Category",
            "Comments",
            "Useful",
        )
    ]
)

CLEAN_REVIEWS = _struct(
    title=StringType(),
    rating=DoubleType(),
    date=TimestampType(),
    category=StringType(),
    comment=StringType(),
    useful=LongType(),
)

#: What one call of a model yields, beside the key columns of the prompt.
RESPONSE = _struct(
    content=StringType(),
    model=StringType(),
    provider=StringType(),
    tokens_used=IntegerType(),
    response_time=DoubleType(),
    cost=DoubleType(),
)

#: A stored response: one row per prompt key.
CACHE_ENTRY = StructType([StructField("prompt_hash", StringType(), True), *RESPONSE.fields])

SENTIMENT_ANSWER = _struct(
    sentiment=StringType(),
    confidence=DoubleType(),
    reasoning=StringType(),
    key_emotions=ArrayType(StringType()),
)

TOPIC_ANSWER = _struct(
    main_topics=ArrayType(StringType()),
    product_aspects=ArrayType(StringType()),
    issues=ArrayType(StringType()),
    praise=ArrayType(StringType()),
)
