"""WARC archives: writing captures as request, response or revisit, and metadata records, and assembling them again.

A record ends with two line breaks, which is just what Spark's text writer can put after each row, so archives go to any
file system that Spark writes to, without Python. Reading parses files of bounded size; the records of a capture meet
through WARC-Concurrent-To.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, ship, written

BREAK = "\r\n"
#: The profile that the WARC standard gives to revisits with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_type string, record_id string, concurrent_to string, refers_to string, uri string, digest string, fields map<string,string>, payload binary"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: 20 bits, so 4 letters, for every 5 hexadecimal digits."""
    hexed = F.sha1(text)
    digits = F.concat(*(F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str | Column, rid: Column, headers: list[Column], mime: str, block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    fixed = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), *headers]
    last = [F.lit(f"Content-Type: {mime}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(BREAK, *fixed, *last), F.lit(BREAK * 2), block)


def numbered(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """(page_, url_, body_, digest_, row_): the rows with their digests and numbers, to be written before they are read twice."""
    rows = pages.select(F.col(key).cast("long").alias("page_"), F.col(url).alias("url_"), F.coalesce(F.col(payload), F.lit("")).alias("body_"))
    return rows.withColumn("digest_", base32_sha1(F.col("body_"))).withColumn("row_", F.monotonically_increasing_id())


def with_roles(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``winner_``, the number of the row that a row revisits, or null for a response. Of rows with equal payloads of at
    least ``min_bytes`` those with the largest id are responses; smaller payloads are responses of their own.

    Roles are found from numbers, ids and digests alone, and only those of revisits go back to the payloads, by row number,
    so that a common payload gathers nowhere.
    """
    heads = rows.where(F.octet_length("body_") >= min_bytes).select("row_", "page_", "digest_")
    groups = heads.groupBy("digest_").agg(F.count("*").alias("n"), F.max(F.struct("page_", "row_")).alias("best")).where("n > 1")
    again = heads.join(groups, "digest_").where(~F.col("page_").eqNullSafe(F.col("best.page_")))
    roles = materialize(again.select(F.col("row_").alias("of_"), F.col("best.row_").alias("winner_")), "roles")
    return rows.join(roles, rows.row_ == roles.of_, "left").drop("of_")


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 32 << 20,
    key: str = "page_id", url: str = "url", payload: str = "html",
) -> None:
    """Writes gzip archives, a capture for each row, repeated ones and those without an id too. A null payload is empty, a null
    URL gives no target; line breaks in a URL are escaped.

    Captures are written by classes of payload size, so many to a file that its payloads stay below ``file_bytes``; a
    larger payload has a file of its own.
    """
    is_response = F.col("winner_").isNull()
    rid = {k: _id(F.lit(k), F.col("row_"), F.col("digest_")) for k in ("request", "capture", "metadata")}
    target = F.regexp_replace(F.regexp_replace("url_", "\r", "%0D"), "\n", "%0A")
    common = [F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), target)]
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), rid["capture"])
    host, rest = (F.regexp_extract(target, p, 1) for p in (r"^[a-z]+://([^/?#]*)", r"^[a-z]+://[^/?#]*([^#]*)"))
    asked = F.coalesce(F.when(rest == "", "/").otherwise(rest), F.lit("/"))
    ask = F.concat(F.lit("GET "), asked, F.lit(" HTTP/1.1" + BREAK + "Host: "), F.coalesce(host, F.lit("")), F.lit(BREAK * 2))
    top = BREAK.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])
    head = F.concat(F.lit(top), F.octet_length("body_").cast("string"), F.lit(BREAK * 2))
    body = F.when(is_response, F.concat(head, F.col("body_"))).otherwise(head)
    refers = F.concat(F.lit("WARC-Refers-To: "), _id(F.lit("capture"), F.col("winner_"), F.col("digest_")))
    answer = [*common, F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest_")), F.when(~is_response, refers), F.when(~is_response, F.lit(f"WARC-Profile: {PROFILE}"))]
    notes = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_").cast("string"), F.lit("")), F.lit(BREAK))
    records = [
        _record("request", rid["request"], [*common, concurrent], "application/http;msgtype=request", ask),
        _record(F.when(is_response, "response").otherwise("revisit"), rid["capture"], answer, "application/http;msgtype=response", body),
        _record("metadata", rid["metadata"], [*common, concurrent], "application/warc-fields", notes),
    ]
    size = F.octet_length("body_")
    steps = (-1, file_bytes >> 9, file_bytes >> 5, file_bytes, 1 << 31)
    classes = list(zip(steps, steps[1:], strict=False))
    with written(numbered(pages, key, url, payload), "pages") as rows:
        captures = with_roles(rows, min_bytes)
        of = F.coalesce(*(F.when(size <= high, F.lit(k)) for k, (_, high) in enumerate(classes))).alias("class_")
        with written(captures.select(F.concat_ws(BREAK * 2, *records).alias("value"), of), "records") as ready:
            for k in sorted(r.class_ for r in ready.select("class_").distinct().collect()) or [0]:
                out = ready.where(F.col("class_") == k).select("value").write.mode("append")
                out = out.option("lineSep", BREAK * 2).option("compression", "gzip")
                out.option("maxRecordsPerFile", max(1, file_bytes // classes[k][1])).text(path)


def parse(raw: bytes) -> Iterator[tuple]:
    """Records of an archive, as in RECORDS. The payload of an HTTP block is what follows its own header."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split(BREAK)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {lines[0][:40]!r}")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(h["content-length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"the record at byte {at} is cut short")
        at = end + 4 + size + 4
        fields, payload = [], None
        if h.get("content-type", "").startswith("application/http"):
            payload = block[block.index(b"\r\n\r\n") + 4 :]
        elif h.get("content-type") == "application/warc-fields":
            fields = [(k.strip(), v.strip()) for k, s, v in (x.partition(":") for x in block.decode().split(BREAK)) if s]
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if digest and h["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {h['warc-record-id']} doesn't match its digest")
        yield h["warc-type"], h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, fields, payload


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives in a folder, compressed or not."""
    ship(spark)
    names = [c.split()[0] for c in RECORDS.replace("map<string,string>", "map").split(", ")]
    kinds = [*[pa.string()] * 6, pa.map_(pa.string(), pa.string()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(0)[i].as_py()
                out = []
                while raw[:2] == b"\x1f\x8b":
                    d = zlib.decompressobj(31)
                    out.append(d.decompress(raw))
                    raw = d.unused_data
                raw = b"".join(out) or raw
                rows, size = [], 0
                for r in parse(raw):
                    rows.append(r)
                    size += len(r[-1] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``capture_id`` and the structs ``request``, ``response`` (or revisit) and ``metadata``.

    A capture's records meet under the id of its response or revisit. Missing records are null; of repeated ones, equal by
    the standard, one is kept.
    """
    kind = F.col("record_type")
    own = F.struct("record_id", "record_type", "uri", "digest", "refers_to", "payload")
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.max(F.when(kind == "request", F.struct("record_id", "uri", "payload"))).alias("request"),
        F.max(F.when(kind.isin("response", "revisit"), own)).alias("response"),
        F.max(F.when(kind == "metadata", F.struct("record_id", F.col("fields")["page-id"].alias("page_id")))).alias("metadata"),
    )
