"""WARC: archives of pages, and revisit resolution.

Headers (id, payload digest, payload size) are written once and shuffled by digest without payloads; map-side aggregation
keeps one row per digest and partition, and rows of one digest are spread over SALTS keys when they look up their
original. Payloads are shuffled once, by id and digest, to meet what became of them. Records whose payload is the
original's become revisit records. Archives are written anew with fresh headers: each record is a gzip member of its own,
so a reader can seek to it, and a response is an HTTP message around its payload. Tasks put members together to the bytes
of whole archives, each begun by a warcinfo record, and Spark's text sink commits each archive as a file; the separator
that the sink writes behind it is the last byte of an empty gzip member.

An archive holds at most FILE_BYTES of payloads, or one payload that is larger, so a task holds about FILE_BYTES when it
writes or reads. Files are named by Spark (part-*).

Defined cases: a null payload is empty; payloads shorter than min_bytes are responses, each; of equal payloads the
largest id is the response, and rows that repeat that id and payload are responses too; null ids are never originals
unless all ids of a group are null; an empty table writes no archive with records. URLs may be null or hold line breaks (written
percent-encoded). Only id, url and payload are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convan.llm.common import saved

FILE_BYTES = 64 << 20  # payloads of an archive, unless one alone has more
SALTS = 64
END = b"\r\n\r\n"
# Fixed values of the formats: an empty gzip member but for its last byte, a zero, and the HTTP header of a page.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff030000000000000000")
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format


def _base32(hex40: Column) -> Column:
    """Upper-case base32 of a 40-digit hex string (160 bits are 32 base32 digits without padding), by built-in functions."""
    digits = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = []
    for k in range(4):  # 10 hex digits are 8 base32 digits
        n = F.conv(F.substring(hex40, 10 * k + 1, 10), 16, 10).cast("long")
        groups += [F.substring(digits, (F.shiftright(n, 5 * (7 - j)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*groups)


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """id, url, payload, bytes and digest of each page."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("digest"))


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Distinct (id, digest) of heads with `original`, the id that holds the payload."""
    lean = heads.select("id", "digest", "bytes")
    entries = lean.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).groupBy("digest", "salt", "id").agg(F.first("bytes").alias("bytes"))
    best = entries.groupBy("digest", "salt").agg(F.max("id").alias("top"), F.max("bytes").alias("bytes"))
    original = best.groupBy("digest").agg(F.max("top").alias("original"))
    known = best.select("digest", "salt", "bytes").join(original.hint("merge"), "digest")
    out = entries.drop("bytes").join(known.hint("merge"), ["digest", "salt"])
    return out.select("id", "digest", F.when(F.col("bytes") < min_bytes, F.col("id")).otherwise(F.col("original")).alias("original"))


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in (*fields, ("Content-Length", len(block))))
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + END, 6, mtime=0)


def page_record(page: dict, date: str) -> bytes:
    """The response or revisit record of a page: id, url, payload, bytes, digest (base32), original."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    revisit = page["id"] != page["original"]
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page["id"])), ("WARC-Date", date), ("WARC-Target-URI", page["uri"]), ("WARC-Payload-Digest", f"sha1:{page['digest']}"), ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        fields += [("WARC-Refers-To", name(page["original"])), ("WARC-Profile", PROFILE)]
    return record(fields, HTTP.format(page["bytes"]).encode() + (b"" if revisit else page["payload"]))


def _archives(date: str, most: int):
    """Pages to the bytes of whole archives, of at most so many bytes of payloads each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archive() -> pa.RecordBatch:
            info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            return pa.RecordBatch.from_arrays([pa.array([b"".join((info, *held, EMPTY_MEMBER))], pa.binary())], names=["file"])

        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                stored = 0 if page["id"] != page["original"] else page["bytes"]
                if held and size + stored > most:
                    yield archive()
                    held, size = [], 0
                held.append(page_record(page, date))
                size += stored
        if held:
            yield archive()

    return run


def write_archives(pages: DataFrame, path: str, date: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Deduplicated archives of pages under path: response records with payloads, revisit records without. date: of the records, by default the time of the call."""
    heads = headers(pages, id_col, url_col, payload_col)
    known = saved(resolve(saved(heads.select("id", "digest", "bytes"), "heads"), min_bytes), "originals").withColumnRenamed("id", "_id").withColumnRenamed("digest", "_digest")
    rows = heads.join(known.hint("shuffle_hash"), heads["id"].eqNullSafe(known["_id"]) & (heads["digest"] == known["_digest"]))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\s\x00-\x1f]", "%20").alias("uri")
    lean = rows.select("id", uri, "bytes", _base32(F.col("digest")).alias("digest"), "original", F.when(F.col("id").eqNullSafe(F.col("original")), F.col("payload")).otherwise(F.lit("")).cast("binary").alias("payload"))
    files = lean.mapInArrow(_archives(date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), FILE_BYTES), "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)  # bytes go through as they are


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, each decompressed, without empty ones."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, found = zlib.decompressobj(31), []
        while not member.eof:
            if at == len(view):
                raise ValueError("an archive ends inside a gzip member")
            piece = view[at : at + (1 << 16)]
            found.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        if any(found):
            yield b"".join(found)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each response or revisit among the records of data; others are passed over."""
    at = 0
    while at < len(data):
        stop = data.find(END, at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in data[at:stop].decode("utf-8").split("\r\n")[1:])
        block = data[stop + 4 : stop + 4 + int(fields["Content-Length"])]
        at = stop + 8 + len(block)
        if data[at - 4 : at] != END:
            raise ValueError(f"the record before byte {at} doesn't end there")
        if fields["WARC-Type"] in ("response", "revisit"):
            yield fields, block[block.index(END) + 4 :]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path: id, url, record_type, refers_to, digest, bytes, payload.

    A response's digest and bytes are those of the payload that was read, checked against its header."""

    def table_of(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["id", "url", "record_type", "refers_to", "digest", "bytes", "payload"]).astype({"id": "Int64", "refers_to": "Int64", "bytes": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: None if x in (None, "<urn:page:null>") else int(x[len("<urn:page:") : -1])
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for f, payload in (x for member in members(content) for x in parse(member)):
                    digest, bytes_ = f["WARC-Payload-Digest"].removeprefix("sha1:"), None
                    if f["WARC-Type"] == "response":
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{f['WARC-Record-ID']}: the payload doesn't have its digest")
                        bytes_ = len(payload)
                    rows.append((number(f["WARC-Record-ID"]), f["WARC-Target-URI"], f["WARC-Type"], number(f.get("WARC-Refers-To")), digest, bytes_, payload))
                    if len(rows) == 500:
                        yield table_of(rows)
                        rows = []
                if rows:
                    yield table_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(run, "id long, url string, record_type string, refers_to long, digest string, bytes long, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """Per record id: size and digest of the full payload; revisits are joined to the response that they refer to."""
    lean = records.select("id", "record_type", "refers_to", "digest", "bytes")
    responses = lean.where("record_type = 'response'")
    revisits = lean.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    # One row per original and salt of its revisits, so that a much-visited original is no hot key.
    wanted = revisits.groupBy("refers_to", "salt").agg(F.count("*").alias("n")).drop("n")
    originals = responses.where("id is not null").groupBy(F.col("id").alias("refers_to"), F.col("digest").alias("_digest")).agg(F.max("bytes").alias("_bytes"))
    found = wanted.join(originals.hint("merge"), "refers_to")
    back = revisits.drop("bytes").join(found.hint("merge"), ["refers_to", "salt"], "left").where("_digest is null or _digest = digest")
    return responses.select("id", "bytes", "digest", "record_type", "refers_to").unionByName(back.select("id", F.col("_bytes").alias("bytes"), "digest", "record_type", "refers_to"))
