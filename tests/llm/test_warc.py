import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from reviewloom.llm import warc


def brute(rows, least=0):
    """What the contract says, for (key, url, payload) rows."""
    first = {}
    for key, _, payload in rows:
        body = (payload or "").encode()
        if len(body) >= least:
            first.setdefault(body, []).append((key is None, key if key is not None else 0))
    out, used = [], set()
    for key, _, payload in rows:
        body = (payload or "").encode()
        original = min(first[body]) if body in first else None
        mine = (key is None, key if key is not None else 0)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if original is None or (mine == original and body not in used):
            used.add(body)
            out.append((key, len(body), digest, "response", None))
        else:
            out.append((key, len(body), digest, "revisit", None if original[0] else original[1]))
    return sorted(out, key=str)


INNER = warc.VERSION + "WARC-Type: response\r\nContent-Length: 9\r\n\r\nx\r\n\r\n"
ROWS = [
    (3, "http://a/1", "same"),
    (1, "http://a/2", "same"),
    (2, None, "same"),
    (2, None, "same"),
    (5, "", None),
    (4, "http://b/\r\nX-Record-Key: 99", ""),
    (None, "http://b/ c", "same"),
    (6, "http://é/WARC/1.1", INNER * 3),
    (7, "http://c/", warc.VERSION),
    (8, "http://c/", "\r\n\r\n" + warc.VERSION * 2 + "\r\n\r\n"),
    (9, "u", "ü😀" * 70_000),
    (10, "u", "W" + warc.VERSION[:-1] + warc.VERSION),
    (11, "u", INNER * 3),
    (None, "v", "alone"),
    (None, "v", "alone"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_contract_and_whole_payloads(spark, tmp_path, least):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, record_id string, payload int")
    warc.write_archives(warc.records(df.repartition(3)), f"{tmp_path}/a")
    warc.deduplicate(spark, f"{tmp_path}/a", f"{tmp_path}/b", least)
    got = warc.digests(spark, f"{tmp_path}/b")
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, least)
    back = warc.read_archives(spark, f"{tmp_path}/b").collect()
    payloads = {r.payload_digest: bytes(r.payload) for r in back if r.record_type == "response"}
    assert set(payloads.values()) == {(p or "").encode() for _, _, p in ROWS}
    ids = {r.record_id for r in back}
    assert len(ids) == len(ROWS) and all(r.refers_to_id in ids for r in back if r.record_type == "revisit")
    urls = {r.record_key: r.url for r in back}
    assert urls["4"] == "http://b/%0D%0AX-Record-Key:%2099" and urls["2"] is None and urls["6"] == "http://é/WARC/1.1"
    # archives with revisits can be read and resolved again, with the same result
    warc.deduplicate(spark, f"{tmp_path}/b", f"{tmp_path}/c", least)
    assert sorted(map(tuple, warc.digests(spark, f"{tmp_path}/c").collect()), key=str) == brute(ROWS, least)


def test_files_are_archives(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "<p>é</p>")], "page_id long, url string, html string")
    warc.write_archives(warc.records(df.coalesce(1)), f"{tmp_path}/a")
    (file,) = Path(f"{tmp_path}/a").glob("part-*.gz")
    text = gzip.decompress(file.read_bytes())
    head, block = text.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:")
    size = int(head.rsplit(b"Content-Length: ", 1)[1])
    assert len(block) == size + 4 and block.endswith("\r\n\r\n<p>é</p>\r\n\r\n".encode())


def test_empty_table_and_broken_archives(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.records(df), f"{tmp_path}/a")
    warc.deduplicate(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    assert warc.digests(spark, f"{tmp_path}/b").count() == 0
    reader = warc.Reader(True)
    with pytest.raises(ValueError, match="version line"):
        reader.add("f", b"x")
    text = warc.as_text(warc.records(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")))
    raw = text.first().value.encode()[len(warc.VERSION) :]
    for bad in (raw, raw[:-1] + b"\r\n\r\n", raw.replace(b"abc", b"abd") + b"\r\n\r\n"):
        reader = warc.Reader(True)
        reader.add("f", b"")
        reader.add("f", bad)
        with pytest.raises(ValueError):
            reader.end()


def test_hot_payloads(spark, tmp_path):
    rows = [(i, f"u{i}", "hot" if i % 3 else f"p{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    warc.write_archives(warc.records(df), f"{tmp_path}/a")
    warc.deduplicate(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    assert sorted(map(tuple, warc.digests(spark, f"{tmp_path}/b").collect()), key=str) == brute(rows)
