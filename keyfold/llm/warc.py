"""WARC archives written and read back by Spark.

Writing is SQL functions only: each row becomes a ``response`` record with a
chunked HTTP message as its block, cut into a first segment and continuation
records where the block is long; a row whose payload another row has becomes a
``revisit`` of that row's record. Files come from Spark's committing text writer
(the line separator ends a record), so any file system will do and a lost task
leaves nothing behind.

Reading parses whole files, then reassembles segments: continuation records are
grouped by origin identifier, ordered by segment number, and their joined length
is held against the declared total; then the chunked framing is decoded and the
payload's digest verified.

Defined results: a null payload is empty; a null URL has no target field, line
breaks in a URL are percent-encoded; a null id has no id field and is null again
when read; rows that repeat id and payload are the same record, written and read
as often; of equal payloads under equal ids either is the response; a payload of any
length is cut into chunks and segments; an empty table reads back empty; other
columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.sources.shared import store

END = "\r\n\r\n"
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RAW = (
    "record_id string, row_id string, warc_type string, target_uri string, payload_digest string, refers_to string, "
    "origin_id string, segment_number int, total_length long, block binary"
)
FIELDS = [x.split()[0] for x in RAW.split(", ")]
#: Bytes of blocks that a reader hands on together, about.
BATCH_BYTES = 8 << 20


def base32(digest: Column) -> Column:
    """A hexadecimal SHA-1 in upper-case base32: five hex digits are four base-32 digits."""
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), *BASE32)


def _blocks(data: Column, size: int, each) -> Column:
    """``each(part, index)`` of the consecutive parts of ``size`` bytes; at least one part."""
    last = F.floor((F.greatest(F.octet_length(data), F.lit(1)) - 1) / size)
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: each(F.substring(data, i * size + 1, F.lit(size)), i))


def decide(digests: DataFrame) -> DataFrame:
    """(record_id, refers_to) of the rows that revisit: among equal payloads all but the largest id.

    ``digests`` holds (id, sha, record_id). A digest's rows are partially
    aggregated before they meet, and the join back leaves a hot digest to skew
    handling.
    """
    keeper = digests.groupBy("sha").agg(F.max(F.struct("id", "record_id"))["record_id"].alias("refers_to"), F.count(F.lit(1)).alias("n"))
    keeper = keeper.where("n > 1").drop("n")
    return digests.join(keeper, "sha").where("record_id <> refers_to").select("record_id", "refers_to").distinct()


def record_id(row_id: Column, sha: Column) -> Column:
    """A URN that follows from the id and the payload's digest."""
    digest = F.md5(F.concat(F.coalesce(row_id.cast("string"), F.lit("-")), F.lit(" "), sha).cast("binary"))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def records(
    pages: DataFrame,
    id_col: str,
    url_col: str,
    payload_col: str,
    min_bytes: int = 0,
    chunk_bytes: int = 8192,
    segment_bytes: int = 65536,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """One ``record`` per WARC record, without its closing line breaks."""
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("p")).withColumn("sha", F.sha1("p"))
    plain = plain.withColumn("record_id", record_id(F.col("id"), F.col("sha")))
    digests = store(plain.where(F.octet_length("p") >= min_bytes).select("id", "sha", "record_id"), "digests")
    # written, so that its size is known: payloads are only shuffled where there are many revisits
    d = plain.join(store(decide(digests), "revisits"), "record_id", "left")
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    own = F.concat(
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("X-Row-Id: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit("")),
        F.lit(f"WARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"),
        base32(F.col("sha")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\n"),
    )
    chunk = lambda part, _: F.concat(F.lower(F.hex(F.octet_length(part).cast("long"))), F.lit("\r\n"), part.cast("string"), F.lit("\r\n"))
    body = F.when(F.octet_length("p") > 0, F.concat_ws("", _blocks(F.col("p"), chunk_bytes, chunk))).otherwise("")
    message = F.when(
        F.col("refers_to").isNull(),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"), body, F.lit("0\r\n\r\n")),
    ).otherwise("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    d = d.select("record_id", "refers_to", own.alias("own"), message.cast("binary").alias("block"))
    d = d.withColumn("total", F.octet_length("block")).select(
        "record_id", "refers_to", "own", "total", F.posexplode(_blocks(F.col("block"), segment_bytes, lambda part, _: part)).alias("i", "part")
    )
    several = F.col("total") > segment_bytes
    last = (F.col("i") + 1) * segment_bytes >= F.col("total")
    first = F.concat(
        F.when(F.col("refers_to").isNull(), "WARC-Type: response\r\n").otherwise(
            F.concat(F.lit(f"WARC-Type: revisit\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), F.col("refers_to"), F.lit("\r\n"))
        ),
        F.lit("WARC-Record-ID: "),
        F.col("record_id"),
        F.lit("\r\n"),
        F.col("own"),
        F.when(several, "WARC-Segment-Number: 1\r\n").otherwise(""),
    )
    further = F.concat(
        F.lit("WARC-Type: continuation\r\nWARC-Record-ID: "),
        F.concat(F.substring_index("record_id", ">", 1), F.lit(":"), (F.col("i") + 1).cast("string"), F.lit(">")),
        F.lit("\r\nWARC-Segment-Origin-ID: "),
        F.col("record_id"),
        F.lit("\r\nWARC-Segment-Number: "),
        (F.col("i") + 1).cast("string"),
        F.lit(f"\r\nWARC-Date: {date}\r\n"),
        F.when(last, F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("total").cast("string"), F.lit("\r\n"))).otherwise(""),
    )
    size = F.concat(F.lit("Content-Length: "), F.octet_length("part").cast("string"), F.lit(END))
    head = F.when(F.col("i") == 0, first).otherwise(further)
    return d.select(F.concat(F.lit("WARC/1.1\r\n"), head, size, F.col("part").cast("string")).alias("record"))


def write_archive(pages: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, file_bytes: int = 32 << 20, **options) -> None:
    """Write gzipped archives below ``path``; a file closes after records of about ``file_bytes`` of payload."""
    n, total = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length(payload_col).cast("long") + 512)).first()
    each = max(1, file_bytes * n // total) if n else 1
    rows = records(pages, id_col, url_col, payload_col, **options)
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", each).text(path)


def _inflated(data: bytes) -> bytes:
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        z = zlib.decompressobj(31)
        out += (z.decompress(data), z.flush())
        data = z.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record of a plain or gzipped archive."""
    data, at = _inflated(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = end + 4, int(fields["content-length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end after {size} bytes")
        yield fields, data[start : start + size]
        at = start + size + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path`` as they stand there, segments apart."""
    names = ["warc-record-id", "x-row-id", "warc-type", "warc-target-uri", "warc-payload-digest", "warc-refers-to", "warc-segment-origin-id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block in parse(content.as_py()):
                    number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                    rows.append((*map(f.get, names), number and int(number), total and int(total), block))
                    size += len(block)
                    if size > BATCH_BYTES or len(rows) == 2000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], FIELDS)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], FIELDS)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, RAW)


def reassemble(segments: DataFrame) -> DataFrame:
    """Whole records from first and continuation segments, one row an origin and copy, with ``complete``.

    ``complete`` is false if a number is missing or the joined length is not the
    declared total; such records keep what there is.
    """
    origin = F.coalesce("origin_id", "record_id")
    s = segments.select(
        origin.alias("record_id"),
        F.struct("segment_number", "block", "total_length").alias("s"),
        F.when(F.col("segment_number") == 1, F.struct("row_id", "warc_type", "target_uri", "payload_digest", "refers_to")).alias("head"),
    )
    s = s.groupBy("record_id").agg(
        F.array_sort(F.collect_set("s")).alias("parts"), F.first("head", ignorenulls=True).alias("head"), F.count("head").alias("copies")
    )
    block = F.expr("concat_ws('', transform(parts, x -> cast(x.block as string)))").cast("binary")
    numbered = F.expr("transform(parts, x -> x.segment_number) = sequence(1, size(parts))")
    total = F.element_at("parts", -1)["total_length"]
    s = s.withColumns({"block": block, "complete": F.coalesce(numbered & (total == F.octet_length(block)), F.lit(False))})
    s = s.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)).cast("int"))))
    return s.select("record_id", "head.*", "block", "complete")


def decode_http(message: bytes) -> bytes:
    """The payload of an HTTP message, chunked framing removed."""
    head, _, body = message.partition(b"\r\n\r\n")
    if b"\ntransfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError(f"a chunk of {size} bytes is cut short")
        at = end + 4 + size


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Whole records with decoded ``payload`` and ``digest_ok``; a revisit's payload is null.

    Archives are parsed once; only segments are shuffled.
    """
    names = ["record_id", "row_id", "warc_type", "target_uri", "payload_digest", "refers_to", "complete", "block"]
    read = store(read_records(spark, path), "warc-parsed")
    whole = read.where("segment_number is null").withColumn("complete", F.lit(True)).select(names)
    joined = whole.unionByName(reassemble(read.where("segment_number is not null")).select(names))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, block, ok = (batch.column(x).to_pylist() for x in ("warc_type", "block", "complete"))
            payload = [decode_http(b) if o and k != "revisit" else None for k, b, o in zip(kind, block, ok)]
            yield pa.record_batch([*batch.columns[:-1], pa.array(payload, pa.binary())], [*names[:-1], "payload"])

    fields = "record_id string, row_id string, warc_type string, target_uri string, payload_digest string, refers_to string, complete boolean, payload binary"
    d = joined.mapInArrow(decode, fields)
    return d.withColumn("digest_ok", F.col("payload_digest") == F.concat(F.lit("sha1:"), base32(F.sha1("payload"))))


def resolve(read: DataFrame) -> DataFrame:
    """``read`` (stored, without payloads) with the response's row id and size on its revisits."""
    kept = [c for c in read.columns if c not in ("payload_bytes", "digest")]
    responses, revisits = read.where("refers_to is null"), read.where("refers_to is not null")
    named = responses.where("warc_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("row_id").alias("refers_row"), F.col("payload_bytes").alias("__n"), F.col("digest").alias("__d")
    )
    found = revisits.join(named.distinct(), "refers_to", "left").select(
        *kept, "refers_row", F.coalesce("payload_bytes", "__n").alias("payload_bytes"), F.coalesce("digest", "__d").alias("digest")
    )
    return found.unionByName(responses.select(*kept, F.lit(None).cast("string").alias("refers_row"), "payload_bytes", "digest"))
