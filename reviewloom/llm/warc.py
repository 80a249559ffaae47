"""WARC archives, and the removal of repeated payloads by revisit records.

1. Every row becomes a response record; the archives are written without a shuffle.
2. The headers of all records, without payloads, are grouped by payload digest: one record
   of each group is its original. The other headers are joined to it and are revisits.
3. New archives are written: revisits are made of headers alone; the originals get their
   payloads by an anti-join on the record's own id, which is evenly spread however often a
   payload repeats. All headers are fresh.

Spark writes and reads the archives: a record is a row of text that ends in two line
breaks, and a file is gzip, so that one task reads it from its start. Reading cuts a file
at each version line into rows and puts them together again by the length that a record
states, so a payload may hold anything, whole archives too, and a task holds one record
at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, stored

# The version line, names of headers, and the profile of revisits.
VERSION = "WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# ---- end of fixed values

#: Records in a file at most; their number also bounds what a task writes at once.
RECORDS_PER_FILE = 100_000

#: What a record is, as a row.
FIELDS = (
    "record_id string, record_type string, record_key string, url string, made string, "
    "payload_digest string, payload_bytes long, refers_to string, refers_to_id string"
)
NAMES = [part.split()[0] for part in FIELDS.split(", ")]


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32, upper case: eight groups of five hexadecimal digits, four letters each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """One response record per row, with its ``payload`` as text: ``FIELDS`` and payload.

    A null payload is empty. A null key or URL stays null. Repeated rows are records of
    their own; an empty table has none; other columns are left out. Record ids are new in
    each evaluation, so write the records before anything reads them twice. White space
    and control characters of a URL, and any of a key, are percent-encoded.
    """
    named = df.select(
        F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{url}`").alias("u"), F.col(f"`{payload}`").alias("p")
    )
    body = F.coalesce(F.col("p").cast("string"), F.lit(""))
    return named.select(
        F.concat(F.lit("urn:uuid:"), F.uuid()).alias("record_id"),
        F.lit("response").alias("record_type"),
        _one_line(F.col("k")).alias("record_key"),
        _one_line(F.col("u")).alias("url"),
        _now().alias("made"),
        base32_sha1(body.cast("binary")).alias("payload_digest"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.lit(None).cast("string").alias("refers_to"),
        F.lit(None).cast("string").alias("refers_to_id"),
        body.alias("payload"),
    )


def _now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _one_line(text: Column) -> Column:
    """A value that a header can hold: no control characters or spaces."""
    odd = r"[\x00-\x20\x7F]"
    coded = F.transform(
        F.split(text, ""), lambda c: F.when(c.rlike(odd), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    )
    return F.when(text.rlike(odd), F.array_join(coded, "")).otherwise(text)


def _header(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def as_text(rows: DataFrame) -> DataFrame:
    """Records as one text each, without the two line breaks at the end."""
    block = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
        F.col("payload"),
    )
    revisit = F.col("record_type") == "revisit"
    return rows.withColumn("block", block).select(
        F.concat(
            F.lit(VERSION),
            _header("WARC-Type", F.col("record_type")),
            _header("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
            _header("WARC-Date", F.col("made")),
            _header("WARC-Target-URI", F.col("url")),
            _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            _header("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_id"), F.lit(">"))),
            _header("X-Refers-To-Key", F.col("refers_to")),
            _header("X-Record-Key", F.col("record_key")),
            F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
            F.octet_length("block").cast("string"),
            F.lit("\r\n\r\n"),
            F.col("block"),
        ).alias("value")
    )


def write_archives(rows: DataFrame, path: str) -> None:
    """Write records (``FIELDS`` and ``payload``) as gzip archives, one or more per task."""
    as_text(rows).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(
        path, compression="gzip"
    )


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives in a folder: ``FIELDS``, and ``payload`` (binary) on demand.

    Digest and length of a response are taken from its payload and held against its
    headers; those of a revisit are its headers'. Anything that is not a whole record
    raises.
    """
    lines = prepared(spark).read.option("lineSep", VERSION).schema("value string").text(path)
    lines = lines.select(
        F.col("value").cast("binary").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(payloads)
        for batch in batches:
            rows = []
            for value, file, block in zip(batch["value"], batch["file"], batch["block"]):
                if block:
                    raise ValueError(f"{file}: only gzip archives can be read, a task needs the whole file")
                rows += reader.add(file, value)
            yield _frame(rows, payloads)
        yield _frame(reader.end(), payloads)

    return lines.mapInPandas(work, FIELDS + (", payload binary" if payloads else ""))


def _frame(rows: list[tuple], payloads: bool) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=NAMES + ["payload"] * payloads)
    return out.assign(payload_bytes=out["payload_bytes"].astype("Int64"))


class Reader:
    """Records out of the parts between version lines, which a payload may hold too."""

    def __init__(self, payloads: bool):
        self.payloads, self.file = payloads, None
        self.parts: list[bytes] = []
        self.size = self.need = 0  # bytes held, and bytes of the record once its header is known

    def add(self, file: str, part: bytes) -> list[tuple]:
        """Records that are whole now that the next part of a file is there."""
        if file != self.file:
            done = self.end()
            self.file = file
            if part:
                raise ValueError(f"{file}: does not start with a version line")
            self.parts = []
            return done
        done = []
        if self.parts and (not self.need or self.size < self.need):
            # the version line before this part belongs to the record
            self.parts += [VERSION.encode(), part]
            self.size += len(VERSION) + len(part)
        else:
            done = self._record() if self.parts else []
            self.parts, self.size, self.need = [part], len(part), 0
        if not self.need:
            self._find_length()
        return done

    def _find_length(self) -> None:
        head = self.parts[0] if len(self.parts) == 1 else b"".join(self.parts)
        end = head.find(b"\r\n\r\n")
        if end < 0:
            self.parts = [head]
            return
        fields = _fields(head[:end])
        self.need = end + 4 + int(fields["content-length"]) + 4

    def end(self) -> list[tuple]:
        done = self._record() if self.parts else []
        self.parts, self.size, self.need = [], 0, 0
        return done

    def _record(self) -> list[tuple]:
        whole = self.parts[0] if len(self.parts) == 1 else b"".join(self.parts)
        if not self.need or len(whole) != self.need or not whole.endswith(b"\r\n\r\n"):
            raise ValueError(f"{self.file}: a record is not as long as it says")
        end = whole.index(b"\r\n\r\n")
        fields = _fields(whole[:end])
        at = whole.index(b"\r\n\r\n", end + 4) + 4
        payload = whole[at:-4]
        digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
        size = int(_fields(whole[end + 4 : at - 4])["content-length"])
        if kind == "response":
            made = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if made != digest or len(payload) != size:
                raise ValueError(f"{self.file}: the payload of {fields['warc-record-id']} is not what its header says")
        row = (
            fields["warc-record-id"][1:-1],
            kind,
            fields.get("x-record-key"),
            fields.get("warc-target-uri"),
            fields["warc-date"],
            digest,
            size,
            fields.get("x-refers-to-key"),
            fields["warc-refers-to"][1:-1] if "warc-refers-to" in fields else None,
        )
        return [(*row, payload) if self.payloads else row]


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; lines without a colon are left out."""
    lines = (line.split(":", 1) for line in head.decode("utf-8", "surrogateescape").split("\r\n") if ":" in line)
    return {name.lower(): value.strip() for name, value in lines}


def resolve(headers: DataFrame, least: int = 0, kind: str = "long") -> DataFrame:
    """Revisits among record headers: (record_id, original), original as a struct of key and id.

    Of the responses with equal digest and length, of ``least`` bytes or more, the one with
    the smallest key (as ``kind``; nulls last, then by URL and record id) is the original.
    Revisits that are there already find theirs in the same way; one without an original
    raises. Digests are grouped before they are joined; a hot one is split in the join,
    whose sides both come straight from a shuffle.
    """
    key = F.col("record_key").cast(kind)
    order = F.struct(key.isNull().alias("none"), key.alias("key"), F.coalesce("url", F.lit("")).alias("url"), "record_id")
    original = F.min(F.when(F.col("record_type") == "response", order)).alias("original")
    groups = headers.groupBy("payload_digest", "payload_bytes").agg(original, F.count("*").alias("n"))
    repeated = stored(groups.where((F.col("n") > 1) | F.col("original").isNull()), "originals")
    if not repeated.where("original is null").isEmpty():
        raise ValueError("a revisit has no response with its digest")
    # null record types are none, so the sizes alone decide
    large = headers.where((F.col("payload_bytes") >= least) | (F.col("record_type") == "revisit"))
    met = large.select("record_id", "payload_digest", "payload_bytes").join(
        repeated.drop("n"), ["payload_digest", "payload_bytes"]
    )
    return met.where("record_id <> original.record_id").select("record_id", "original")


def deduplicate(spark: SparkSession, source: str, target: str, least: int = 0, kind: str = "long") -> None:
    """Read archives, resolve revisits, and write new archives with fresh headers.

    ``least`` and ``kind`` are those of ``resolve``. Only headers are shuffled by digest.
    Payloads move once, on record ids, and only those of originals are written.
    """
    headers = stored(read_archives(spark, source, payloads=False), "headers")
    revisits = stored(resolve(headers, least, kind), "revisits")
    whole = read_archives(spark, source).join(revisits.select("record_id"), "record_id", "left_anti")
    whole = whole.select(*NAMES, F.col("payload").cast("string").alias("payload"))
    bare = headers.drop("refers_to", "refers_to_id").join(revisits, "record_id").select(
        "*",
        F.col("original.key").cast("string").alias("refers_to"),
        F.col("original.record_id").alias("refers_to_id"),
    )
    bare = bare.withColumns({"record_type": F.lit("revisit"), "payload": F.lit("")}).select(*NAMES, "payload")
    write_archives(whole.unionByName(bare).withColumn("made", _now()), target)


def digests(spark: SparkSession, path: str, key: str = "page_id", kind: str = "long") -> DataFrame:
    """Rows (key, payload_bytes, payload_digest, record_type, refers_to) of the archives in a folder."""
    return read_archives(spark, path, payloads=False).select(
        F.col("record_key").cast(kind).alias(key),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
