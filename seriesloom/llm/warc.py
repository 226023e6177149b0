"""WARC archives as a chunked record table: oversized payloads are segments, read back with incremental digests.

A record with a payload above ``CHUNK`` bytes becomes a first segment and ``continuation`` records, as the format
provides, so that no shuffle row, archive row or Python value holds more than one chunk. Archives are gzip files
written by Spark's own text writer: a record is one value and the format's record end is the line end.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
ARCHIVE = 1 << 30  # bytes that an archive has at most before compression, so that one is no oversized value to its reader
_HEADER = 1 << 16  # bytes of a record besides its chunk
_END = "\r\n\r\n"
_READ = 1 << 18
# Fixed value: the alphabet of base 32.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """Base 32 of a SHA-1 in hexadecimal: five hexadecimal digits are four letters."""

    def letters(i: int) -> list[Column]:
        bits = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(ALPHABET), (F.shiftright(bits, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*[x for i in range(8) for x in letters(i)])


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0,
    chunk: int = CHUNK, date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write one WARC record per row of ``pages``; payload is the UTF-8 text, null counts as empty.

    Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is the response and
    the others revisit it; rows that repeat both id and payload are all responses, a null id never is while another
    is there. Only ids and digests meet in the grouping; payloads are shuffled once, in chunks, by page. Columns other
    than the three named ones are not read. An empty table writes an empty archive.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    base = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), payload.alias("payload")
    ).withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    keys = base.select("page", "sha", "size").distinct()
    first = keys.where(F.col("size") >= least).groupBy("sha").agg(F.max("page").alias("original"))
    linked = keys.join(first, "sha", "left").select("page", "sha", F.coalesce("original", "page").alias("original"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / chunk)).cast("int")),
        lambda i: F.substring(F.col("payload"), i * chunk + 1, F.lit(chunk)),
    )
    rows = base.select("row", "page", "url", "sha", "size", F.size(pieces).alias("parts"), F.posexplode(pieces).alias("part", "data"))
    named = linked.select(F.col("page").alias("_page"), F.col("sha").alias("_sha"), "original")
    rows = rows.join(named, F.col("page").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha")))
    revisit = ~F.col("page").eqNullSafe(F.col("original"))
    rows = rows.where(~revisit | (F.col("part") == 0))
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("data"))
    split = (F.col("parts") > 1) & ~revisit
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    maybe = lambda when, text: F.when(when, text).otherwise(F.lit(""))
    id_of = lambda part: _uuid(F.col("row"), F.col("page"), part)
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").when(F.col("part") == 0, "response").otherwise("continuation")),
        line("WARC-Record-ID", id_of(F.col("part"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        maybe(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        maybe(revisit, line("WARC-Refers-To-Page", F.col("original"))),
        maybe(split, line("WARC-Segment-Number", F.col("part") + 1)),
        maybe(split & (F.col("part") > 0), line("WARC-Segment-Origin-ID", id_of(F.lit(0)))),
        maybe(split & (F.col("part") == F.col("parts") - 1), line("WARC-Segment-Total-Length", F.col("size"))),
        line("WARC-Page", F.coalesce(F.col("page").cast("string"), F.lit(""))),
        line("WARC-Row", F.col("row")),
        line("WARC-Payload-Length", F.col("size")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(_END)),
    )
    records = rows.select(F.concat(header.cast("binary"), body).cast("string").alias("value"))
    per_file = max(1, ARCHIVE // (chunk + _HEADER))
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


_SCHEMA = "row long, page_id long, record_type string, part long, data binary, payload_bytes long, digest string, refers_to long, source string"


def _records(blob: memoryview) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(header, first byte of the part in its record, part) of each record; a part has at most ``_READ`` bytes."""
    gz, at, held = zlib.decompressobj(31), 0, bytearray()

    def more() -> bool:
        nonlocal gz, at
        while at < len(blob) or gz.unconsumed_tail:
            got = gz.decompress(gz.unconsumed_tail or blob[at : at + _READ], _READ)
            if not gz.unconsumed_tail:
                at += _READ
            if gz.eof and gz.unused_data:  # another member follows
                at -= len(gz.unused_data)
                gz = zlib.decompressobj(31)
            if got:
                held.extend(got)
                return True
        return False

    while held or more():
        while (end := held.find(_END.encode())) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a record ends within its header")
                return
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        header = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        del held[: end + 4]
        left, seen = int(header["Content-Length"]), 0
        while True:
            if not held and left and not more():
                raise ValueError("a record ends within its payload")
            piece = bytes(held[: min(left, _READ)])
            del held[: len(piece)]
            left -= len(piece)
            yield header, seen, piece
            seen += len(piece)
            if not left:
                break
        while len(held) < 4 and more():
            pass
        del held[:4]


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows of all archives under ``path``: record row, page, type, part number, data and header fields.

    An archive is inflated piece by piece; a record in one piece carries its checked digest instead of its data, so
    only larger payloads travel on.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "page_id", "record_type", "part", "data", "payload_bytes", "digest", "refers_to", "source"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        out, held = [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                for header, seen, piece in _records(memoryview(content.as_buffer())):
                    size, digest = int(header["WARC-Payload-Length"]), header["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = "revisit" if header["WARC-Type"] == "revisit" else "response"
                    segment = int(header.get("WARC-Segment-Number", 1)) - 1
                    whole = kind == "revisit" or len(piece) == size
                    if kind == "response" and whole and base64.b32encode(hashlib.sha1(piece).digest()).decode() != digest:
                        raise ValueError(f"page {header['WARC-Page']}: the payload doesn't have its digest")
                    part = (segment << 40) + seen  # pieces by segment and byte
                    refers = header.get("WARC-Refers-To-Page")
                    out.append((int(header["WARC-Row"]), int(header["WARC-Page"]) if header["WARC-Page"] else None, kind, part, None if whole else piece, size, digest, int(refers) if refers else None, name.as_py()))
                    held += len(piece)
                    if held > 8 * CHUNK or len(out) >= 10_000:
                        yield batch_of(out)
                        out, held = [], 0
        if out:
            yield batch_of(out)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, _SCHEMA)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Pieces meet by record in their order and pass through one running SHA-1 and length, checked against the header.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, sha, size, fields = None, None, 0, None

        def closed() -> dict:
            page, kind, n, digest, refers = fields
            if sha is not None:
                if size != n or base64.b32encode(sha.digest()).decode() != digest:
                    raise ValueError(f"page {page}: the segments don't add up to the payload")
            return {"page_id": page, "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": refers}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["row"] != row:
                    if fields is not None:
                        out.append(closed())
                    row, sha, size = r["row"], None, 0
                    fields = (r["page_id"], r["record_type"], r["payload_bytes"], r["digest"], r["refers_to"])
                if r["data"] is not None:
                    sha = sha or hashlib.sha1()
                    sha.update(r["data"])
                    size += len(r["data"])
            yield pa.RecordBatch.from_pylist(out, schema=types)
        if fields is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema=types)

    types = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return read_chunks(spark, path).repartition("row").sortWithinPartitions("row", "part").mapInArrow(fold, schema)
