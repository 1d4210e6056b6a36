"""Web archives: written as WARC files, read back, continuation records joined to whole payloads.

Writing is one pass of column functions into Spark's text sink, whose line separator is the blank line between
records. The payload is framed in chunks (``Transfer-Encoding: chunked``); a block longer than a segment goes on in
continuation records that name the first record as their origin. Chunks end inside every ``WARC/1.1`` of a
payload, so these bytes stand in the archive only where a record begins and the files can be split there
without an index.

Reading splits the files at record beginnings, parses the headers in each task, groups the continuation records
of a segmented record by origin, orders them by number, checks that none is missing and that their length is the
declared total, and undoes the chunks. A record that fails a check has an ``error`` and no payload.

A record id is ``<urn:page:ID:UUID>``. A revisit names the page it repeats, ``<urn:page:ID>``.

Defined results: a null payload is empty; equal payloads are compared by SHA-1, length and a second hash;
rows repeated whole give a record each (all of those with the smallest id are responses); a row with a null id is always
a response; control characters and spaces in a URL are escaped; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcal.llm.scratch import saved, shuffle_files_removed
from fieldcal.session import scratch_path

VERSION = "WARC/1.1"
#: Characters in a chunk, and in the block of one record.
CHUNK_CHARS = 8192
SEGMENT_CHARS = 32768
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: Column, n_bytes: int = 20) -> Column:
    """Upper-case base 32 of a hexadecimal digest whose length is a multiple of five bytes."""
    digits = [
        F.lpad(F.conv(F.substring(hex_digest, 1 + 2 * i, 10), 16, 32), 8, "0") for i in range(0, n_bytes, 5)
    ]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _slices(text: Column, length: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{length}}}"), F.lit(0))


def _chunked(payload: Column, length: int) -> Column:
    """The payload in chunks, each headed by its length in hexadecimal; no chunk holds ``WARC/1.1``."""
    plain = _slices(payload, length)
    broken = F.flatten(F.transform(F.split(payload, r"(?<=WARC)(?=/1\.1)", -1), lambda p: _slices(p, length)))
    # A slice may not put the two halves into one chunk again, nor end one half's chunk with the other.
    parts = F.when(F.contains(payload, F.lit(VERSION)), broken).otherwise(plain)
    framed = F.transform(parts, lambda p: F.concat(F.lower(F.hex(F.octet_length(p).cast("long"))), F.lit("\r\n"), p, F.lit("\r\n")))
    return F.concat(F.array_join(framed, ""), F.lit("0\r\n\r\n"))


def _header(*fields: tuple[str, Column]) -> Column:
    """Version line and named fields; a field whose value is null is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in fields]
    return F.concat(F.lit(f"{VERSION}\r\n"), *[F.coalesce(x, F.lit("")) for x in lines])


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    chunk_chars: int = CHUNK_CHARS, segment_chars: int = SEGMENT_CHARS,
) -> None:
    """Write a record per page into the folder ``path``: a response, or a revisit of an equal payload."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumn("sha", F.sha1(F.encode("payload", "UTF-8"))).withColumn("check", F.xxhash64("payload"))
    known = saved(pages.select("id", "sha", "check", F.octet_length("payload").alias("n_bytes")), "digests")
    same = ["sha", "check", "n_bytes"]
    groups = known.groupBy(*same).agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = saved(known.join(groups, same).filter("id > first").select("id", "sha", "first").distinct(), "revisits")
    rows = pages.join(again, ["id", "sha"], "left").withColumn("uuid", F.uuid())
    url = F.replace(F.regexp_replace("url", r"[\x00-\x20]", "%20"), F.lit("WARC/"), F.lit("WARC%2F"))
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    record = F.concat(F.lit("<urn:page:"), name, F.lit(":"), F.col("uuid"))
    block = F.when(F.col("first").isNotNull(), F.lit(_HTTP)).otherwise(
        F.concat(F.lit(_HTTP), _chunked(F.col("payload"), chunk_chars))
    )
    rows = rows.select(
        "id", "first", url.alias("url"), record.alias("record"), base32(F.col("sha")).alias("digest"),
        F.octet_length("payload").alias("n_bytes"), block.alias("block"),
    )
    rows = rows.withColumn("total", F.octet_length("block")).withColumn("parts", _slices(F.col("block"), segment_chars))
    rows = rows.withColumn("n_parts", F.size("parts")).select("*", F.posexplode("parts").alias("at", "part")).drop("parts", "block")
    many, is_first = F.col("n_parts") > 1, F.col("at") == 0
    number = F.when(many, (F.col("at") + 1).cast("string"))
    length = F.octet_length("part").cast("string")
    date = F.lit("2000-01-01T00:00:00Z")
    kind = F.when(F.col("first").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    head = _header(
        ("WARC-Type", kind), ("WARC-Record-ID", F.concat("record", F.lit(">"))), ("WARC-Date", date),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        ("WARC-Profile", F.when(F.col("first").isNotNull(), F.lit(_PROFILE))),
        ("WARC-Segment-Number", number), ("Content-Type", F.lit("application/http;msgtype=response")), ("Content-Length", length),
    )
    more = _header(
        ("WARC-Type", F.lit("continuation")),
        ("WARC-Record-ID", F.concat("record", F.lit("-"), F.col("at").cast("string"), F.lit(">"))), ("WARC-Date", date),
        ("WARC-Segment-Origin-ID", F.concat("record", F.lit(">"))), ("WARC-Segment-Number", number),
        ("WARC-Segment-Total-Length", F.when(F.col("at") + 1 == F.col("n_parts"), F.col("total").cast("string"))),
        ("Content-Length", length),
    )
    text = F.concat(F.when(is_first, head).otherwise(more), F.lit("\r\n"), "part")
    with shuffle_files_removed(pages.sparkSession):
        rows.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def unchunk(body: bytes) -> bytes:
    """Undo chunked framing; raises ValueError where it is broken or unfinished."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response block."""
    end = block.index(b"\r\n\r\n") + 4
    if re.search(rb"\r\ntransfer-encoding:\s*chunked\s*\r\n", block[:end], re.IGNORECASE):
        return unchunk(block[end:])
    return block[end:]


def _fields(header: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in header.split(b"\r\n"))
    return {name.strip().lower().decode("utf-8", "replace"): value.strip().decode("utf-8", "replace") for name, _, value in pairs}


_PARSED = "kind string, origin string, number int, total long, refers string, digest string, block binary, error string"
_WHOLE = "payload binary, payload_bytes long, payload_digest string, error string"


def _whole(block: bytes | None, digest: str | None, error: str | None, with_payload: bool) -> tuple:
    """Payload, its length and digest, and what is wrong with it."""
    if error is None:
        try:
            payload = payload_of(block)
            found = b32encode(hashlib.sha1(payload).digest()).decode()
            if digest is None or digest == f"sha1:{found}":
                return payload if with_payload else None, len(payload), found, None
            error = "the digest does not match"
        except ValueError as problem:
            error = f"bad framing: {problem}"
    return None, None, None, error


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _PARSED.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
    for batch in batches:
        rows = []
        for raw in batch.column(0).to_pylist():
            head, gap, rest = raw.partition(b"\r\n\r\n")
            f = _fields(head)
            length = f.get("content-length", "")
            error = None
            if not gap or not length.isdigit():
                error, length = "no header", "0"
            elif len(rest) < int(length):
                error = "the block is cut short"
            number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
            kind = f.get("warc-type")
            origin = f.get("warc-segment-origin-id") if kind == "continuation" else f.get("warc-record-id")
            rows.append((
                kind, origin, int(number) if number else None, int(total) if total else None,
                f.get("warc-refers-to"), f.get("warc-payload-digest"), rest[: int(length)], error,
            ))
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _decode(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    """Columns origin, kind, refers, digest pass; block and error become the columns of _WHOLE."""
    names = ["origin", "kind", "refers", "payload", "payload_bytes", "payload_digest", "error"]
    for batch in batches:
        cells = {n: batch.column(n).to_pylist() for n in ("kind", "digest", "block", "error")}
        done = [
            (None, None, (d or "").removeprefix("sha1:") or None, e) if k == "revisit" else _whole(b, d, e, with_payload)
            for k, d, b, e in zip(*cells.values())
        ]
        columns = list(zip(*done)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("origin"), batch.column("kind"), batch.column("refers")]
            + [pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.string(), pa.string()))],
            names,
        )


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per response or revisit record of an archive folder.

    record_id, page_id, record_type, refers_to (page id), payload (null for revisits), payload_bytes and payload_digest of
    the whole payload, error. A revisit has the length of the response it refers to.
    """
    pieces = spark.read.option("lineSep", f"{VERSION}\r\n").text(path).filter("length(value) > 0")
    parsed = pieces.select(F.col("value").cast("binary")).mapInArrow(_parse, _PARSED)
    parsed = parsed.filter("kind in ('response', 'revisit', 'continuation') or error is not null")
    plain = parsed.filter("number is null").select("origin", "kind", "refers", "digest", "block", "error")
    segment = F.struct("number", "kind", "refers", "digest", "total", "error", "block")
    joined = parsed.filter("number is not null").groupBy("origin").agg(F.sort_array(F.collect_list(segment)).alias("s"))
    last = F.element_at("s", -1)
    whole = F.expr("aggregate(s, cast('' as binary), (a, x) -> concat(a, x.block))")
    problem = F.expr(
        """coalesce(
             array_min(filter(transform(s, x -> x.error), e -> e is not null)),
             case when exists(transform(s, (x, i) -> x.number <> i + 1), b -> b) then 'a segment is missing'
                  when element_at(s, -1).total is null then 'the last segment is missing'
                  when octet_length(block) <> element_at(s, -1).total then 'the total length does not match' end)"""
    )
    joined = joined.withColumn("block", whole).withColumn("error", problem)
    first = F.element_at("s", 1)
    joined = joined.select(
        "origin", F.when(first["kind"] == "continuation", F.lit("response")).otherwise(first["kind"]).alias("kind"),
        first["refers"].alias("refers"), first["digest"].alias("digest"), "block", "error",
    )
    schema = f"origin string, kind string, refers string, {_WHOLE}"
    done = plain.unionByName(joined).mapInArrow(lambda batches: _decode(batches, with_payload), schema)
    page = F.expr("try_cast(regexp_extract(origin, '^<urn:page:(-?[0-9]+):', 1) as bigint)")
    refers = F.expr("try_cast(regexp_extract(refers, '^<urn:page:(-?[0-9]+)>', 1) as bigint)")
    records = done.select(
        F.col("origin").alias("record_id"), page.alias("page_id"), F.col("kind").alias("record_type"), refers.alias("refers_to"),
        "payload", "payload_bytes", "payload_digest", "error",
    )
    records = saved(records, "records")
    lengths = (
        records.filter("record_type = 'response' and error is null")
        .join(records.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct(), "page_id")
        .select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("__bytes")).distinct()
    )
    revisits = records.filter("record_type = 'revisit'").join(lengths, ["refers_to", "payload_digest"], "left")
    return records.filter("record_type <> 'revisit' or record_type is null").unionByName(
        revisits.withColumn("payload_bytes", F.col("__bytes")).select(*records.columns)
    )


def warc_round_trip(pages: DataFrame, with_payload: bool = False, **options) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path, with_payload)
