"""Review files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import RAW_REVIEWS

# Texts that a CSV reader of data frames takes for a missing value.
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
# ---- end of fixed values


def null_tokens(df: DataFrame) -> DataFrame:
    """Null tokens in text columns become null."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns(
        {name: F.when(~F.col(f"`{name}`").isin(NULL_TOKENS), F.col(f"`{name}`")) for name in text}
    )


def read_reviews(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | None = RAW_REVIEWS,
    multi_line: bool = True,
    encoding: str = "ISO-8859-1",
    line_end: str | None = None,
    rejected: str | None = None,
) -> DataFrame:
    """CSV, Latin-1 by default, with a header, quoted newlines and doubled quotes.

    The header of every file is checked against the schema. With ``schema=None``
    the columns are those of the header, all text. A file with quoted newlines
    cannot be split, so it is one task: give many files, or ``multi_line=False``
    when no comment holds a newline. A missing path raises when the plan is built.

    A row with more fields than the header fails the job, also where only some columns
    are read or rows are counted; missing fields at the end of a row are null. Line
    ends are those of the first header, or ``line_end``, and must be the same in all
    files, or else the check of the header raises. Line ends inside quotes stay as
    they are.

    With ``rejected`` such a row does not fail the job: that column has its text, and its
    first fields are in the others. In good rows it is null. ``split_rejects`` parts them.
    """
    if line_end is None:
        first = spark.read.text(path, lineSep="\n").first()
        line_end = "\r\n" if first is not None and first[0].endswith("\r") else "\n"
    reader = spark.read.options(
        header=True,
        encoding=encoding,
        lineSep=line_end,
        multiLine=multi_line,
        quote='"',
        escape='"',
        inferSchema=False,
    )
    schema = schema or reader.csv(path).schema
    reader = reader.options(enforceSchema=False, columnPruning=False)
    if rejected is None:
        # All fields of a row are looked at, so that a surplus one is found in any query.
        return null_tokens(reader.schema(schema).options(maxColumns=len(schema)).csv(path))
    wide = StructType([*schema.fields, StructField(rejected, StringType())])
    rows = reader.schema(wide).options(columnNameOfCorruptRecord=rejected).csv(path)
    # The reader also marks rows with too few fields. Separators outside quotes tell.
    record = F.col(f"`{rejected}`")
    bare = F.regexp_replace(record, '"[^"]*"', "")
    surplus = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) >= len(schema)
    # Spark does not read the record alone, so counts look at a field too; no length is negative.
    surplus = surplus | (F.length(F.col(f"`{schema.fields[0].name}`").cast("string")) < 0)
    fields = null_tokens(rows.withColumn(rejected, F.struct(F.when(surplus, record).alias("text"))))
    return fields.withColumn(rejected, F.col(f"`{rejected}`.text"))


def split_rejects(df: DataFrame, rejected: str) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the rejected ones, of a scan with ``rejected``."""
    bad = F.col(f"`{rejected}`").isNotNull()
    return df.where(~bad).drop(rejected), df.where(bad)
