"""S1 to S7."""

from datetime import datetime

import pytest
from pyspark.errors import AnalysisException

from reviewloom.schema import CACHE_ENTRY, RAW_REVIEWS
from reviewloom.sources.response_cache import (
    append_responses,
    compact_responses,
    current_version,
    find_response,
    read_responses,
)
from reviewloom.sources.reviews import NULL_TOKENS, null_tokens, read_reviews, split_rejects
from reviewloom.sources.sinks import REPORT_HEADING, timestamped, write_json, write_report

HEADER = "Review Title,Customer name,Rating,Date,Category,Comments,Useful\n"


def _file(tmp_path, text, name="reviews.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode("latin-1"))
    return str(path)


def test_csv(spark, tmp_path):
    body = 'Caf\xe9,NA,"4.0 out of 5 stars",on 1 May 2018,Camera,"He said ""hi""\nand left",\n'
    row = read_reviews(spark, _file(tmp_path, HEADER + body)).first()
    assert row["Review Title"] == "Café"
    assert row["Customer name"] is None and row["Useful"] is None
    assert row["Comments"] == 'He said "hi"\nand left'


def test_csv_surplus_fields_raise(spark, tmp_path):
    path = _file(tmp_path, HEADER + "a,b,c,d,e,f,g\na,b,c,d,e,f,g,DROPPED\n")
    for multi_line in (True, False):
        df = read_reviews(spark, path, multi_line=multi_line)
        for job in (df.collect, df.count, df.select("Rating").collect):
            with pytest.raises(Exception, match="FAILED_READ_FILE"):
                job()
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        read_reviews(spark, path, schema=None).count()


def test_csv_short_row_is_filled_with_nulls(spark, tmp_path):
    df = read_reviews(spark, _file(tmp_path, HEADER + "a,b,c\n"))
    assert df.count() == 1 and list(df.first()) == ["a", "b", "c", None, None, None, None]


def test_csv_line_ends_in_quotes_stay(spark, tmp_path):
    for end in ("\n", "\r\n"):
        body = f'a,b,c,d,e,"one\r\ntwo\nthree",g{end}a,b,c,d,e,f,{end}'
        path = _file(tmp_path, HEADER.replace("\n", end) + body, f"{len(end)}.csv")
        rows = read_reviews(spark, path).collect()
        assert [r["Comments"] for r in rows] == ["one\r\ntwo\nthree", "f"]
        assert [r["Useful"] for r in rows] == ["g", None]
        with pytest.raises(Exception):
            read_reviews(spark, path, line_end="\r\n" if end == "\n" else "\n").collect()


def test_csv_other_encoding(spark, tmp_path):
    path = tmp_path / "euro.csv"
    path.write_bytes((HEADER + "a,b,c,d,e,5 \u20ac,g\n").encode("utf-8"))
    assert read_reviews(spark, str(path), encoding="UTF-8").first()["Comments"] == "5 \u20ac"


def test_csv_header_must_match_the_schema(spark, tmp_path):
    path = _file(tmp_path, "Rating,Review Title,Customer name,Date,Category,Comments,Useful\na,b,c,d,e,f,g\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_reviews(spark, path).collect()
    assert read_reviews(spark, path, schema=None).first()["Rating"] == "a"


def test_csv_split_by_line(spark, tmp_path):
    path = _file(tmp_path, HEADER + "a,b,c,d,e,f,g\n" * 3)
    assert read_reviews(spark, path, multi_line=False).count() == 3


def test_missing_file(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_reviews(spark, str(tmp_path / "none.csv"))


def test_null_tokens(spark):
    df = spark.createDataFrame([(t, 1) for t in [*NULL_TOKENS, "na", "NaNs", " "]], "c string, n int")
    assert [r.c for r in null_tokens(df).collect() if r.c is not None] == ["na", "NaNs", " "]


def _entry(key, content, model="m"):
    return (key, content, model, "p", 5, 0.5, None)


def test_response_cache_round_trip(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert read_responses(spark, path).count() == 0
    append_responses(spark.createDataFrame([_entry("k1", "one"), _entry("k2", "")], CACHE_ENTRY), path)
    append_responses(spark.createDataFrame([_entry("k1", "two"), _entry("k3", "x")], CACHE_ENTRY), path)
    stored = {r.prompt_hash: r.content for r in read_responses(spark, path).collect()}
    # One answer per key, the same one every time; an empty answer is not kept.
    assert stored == {"k1": "one", "k3": "x"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("line\nbreak", None)], "report string, other string")
    path = write_json(df, str(tmp_path))
    assert spark.read.text(path).first()[0] == '{"report":"line\\nbreak","other":null}'
    path = write_report(df, str(tmp_path))
    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    assert text == REPORT_HEADING + "line\nbreak"
    moment = datetime(2025, 1, 2, 3, 4, 5)
    assert timestamped("out/", "summary", moment) == "out/summary_20250102_030405"


def test_raw_schema_is_all_text():
    assert {f.dataType.simpleString() for f in RAW_REVIEWS} == {"string"}


def _answers(spark, keys, content):
    return spark.createDataFrame([_entry(k, content) for k in keys], CACHE_ENTRY)


def test_concurrent_appends_keep_each_key_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from hashlib import md5

    path = str(tmp_path / "cache")
    keys = [md5(str(i).encode()).hexdigest() for i in range(40)]
    base = append_responses(_answers(spark, keys[:5], "first"), path)
    # writers that all start from the same version, with overlapping keys
    shares = [keys[5 + 5 * i : 20 + 5 * i] for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda n: append_responses(_answers(spark, shares[n], f"w{n}"), path, base), range(4)))
    assert len({version.number for version in made}) == 4
    stored = read_responses(spark, path).collect()
    assert sorted(r.prompt_hash for r in stored) == sorted(keys[:35])
    for row in stored:
        holders = {"first"} if row.prompt_hash in keys[:5] else {f"w{n}" for n in range(4) if row.prompt_hash in shares[n]}
        assert row.content in holders
    before = {(r.prompt_hash, r.content) for r in stored}
    old = read_responses(spark, path)
    version = compact_responses(spark, path, digits=2)
    assert len(version.runs) == 1 and version.digits == 2 and current_version(spark, path) == version
    assert {(r.prompt_hash, r.content) for r in read_responses(spark, path).collect()} == before
    assert old.count() == 35
    append_responses(_answers(spark, [*keys[30:38], None], "late"), path)
    assert read_responses(spark, path).count() == 38


def test_a_key_reads_its_range_only(spark, tmp_path):
    from hashlib import md5

    path = str(tmp_path / "cache")
    keys = [md5(str(i).encode()).hexdigest() for i in range(60)]
    append_responses(_answers(spark, keys, "x"), path)
    row = find_response(spark, path, keys[7])
    assert row.first().content == "x"
    assert {file.split("key_range=")[1][0] for file in row.inputFiles()} >= {keys[7][0]}
    text = row._jdf.queryExecution().executedPlan().toString()
    assert f"(key_range#" in text.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert find_response(spark, path, "0" * 32).count() == 0
    assert find_response(spark, str(tmp_path / "none"), "0" * 32).count() == 0


def test_an_unfinished_append_is_not_seen(spark, tmp_path):
    path = tmp_path / "cache"
    version = append_responses(_answers(spark, ["aa", "bb"], "x"), str(path))
    (path / "run=lost" / "key_range=c").mkdir(parents=True)
    (path / "_versions" / f"v{version.number + 1:012d}.json").write_text("")
    assert read_responses(spark, str(path)).count() == 2


def test_rows_with_too_many_fields_are_put_aside(spark, tmp_path):
    good = 'a,b,4.0,on 1 May 2018,c,"one, ""two""\nthree",1\n'
    short = "a,b,5.0\n"
    bad = 'x,b,4.0,on 1 May 2018,c,"one, two",1,more\n'
    empty = "y,b,4.0,on 1 May 2018,c,d,,\n"
    path = _file(tmp_path, HEADER + good + bad + short + empty)
    rows = read_reviews(spark, path, rejected="why")
    kept, rejects = split_rejects(rows, "why")
    assert [r["Review Title"] for r in kept.collect()] == ["a", "a"]
    assert kept.columns == RAW_REVIEWS.names
    assert kept.first()["Comments"] == 'one, "two"\nthree'
    assert [r["why"].strip() for r in rejects.orderBy("why").collect()] == [bad.strip(), empty.strip()]
    assert rejects.count() == 2 and rows.count() == 4
