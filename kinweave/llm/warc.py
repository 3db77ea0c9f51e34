"""WARC archives: writing page captures, reading records, and assembling transactions.

A page becomes three records: a request, a response (or a revisit of an
earlier one) and metadata, the first and last concurrent to the second. The
archives are written by Spark's text writer, whose record separator is the
blank lines that end a WARC record, so any file system works and retried tasks
leave no trace. Spark's text reader inflates them bit by bit, cut at the same
separator; the parser puts the pieces together by the records' Content-Length
and takes any WARC, holding one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, fresh, remove, small_batches, stage, tidy

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
SEPARATOR = b"\r\n\r\n"
#: Broadcast the table of repeated payloads up to so many rows of about 150 bytes.
BROADCAST_ROWS = 100_000

RECORDS = "record_id string, type string, concurrent_to string, target_uri string, date string, refers_to string, digest string, payload_bytes long, payload binary, fields map<string,string>"


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record as text; headers of null value are left out."""
    lines = [F.lit(f"{VERSION}{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: <"), record_id, F.lit(">" + CRLF)]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in headers]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def write_archives(pages: DataFrame, path: str, min_payload: int = 100, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 256 << 20, pages_per_file: int = 2000, level: str = "BEST_SPEED") -> None:
    """Write every row of pages (page_id, url, html) as a transaction of three records to gzip files under path.

    The payload is the html in UTF-8, empty for null. Of pages with equal
    payloads of at least min_payload bytes, that with the smallest page_id (a
    null counts as the largest; then by url) holds the response, the others
    revisit it. Rows equal in all three columns are captures of their own,
    numbered; the first of them may be the response. Files get pages_per_file
    pages, fewer where pages are so large on average that a file would have
    more than file_bytes before compression. `level` is zlib's: its default
    takes three times as long and saves an eighth. Other columns are ignored.
    """
    payload = F.coalesce("html", F.lit(""))
    slim = pages.select("page_id", "url", payload.alias("payload")).withColumns({"bytes": F.octet_length("payload").cast("long"), "sha": F.sha2(F.col("payload").cast("binary"), 256)})
    key = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.md5(F.concat_ws("|", F.coalesce(F.hex("url"), F.lit("-")), F.col("sha"))))
    slim = slim.withColumn("id", F.concat(F.lit("urn:page:"), key))
    # payloads that several rows bear; `copies` tells whether rows that are equal are among them
    known = slim.groupBy("sha", "bytes", "page_id", "id").agg(F.count("*").alias("rows"))
    order = F.struct(F.coalesce("page_id", F.lit((1 << 63) - 1)).alias("p"), F.col("id").alias("i"))
    known = stage(known.groupBy("sha", "bytes").agg(F.min(order)["i"].alias("original"), F.count("*").alias("ids"), F.sum("rows").alias("rows")).withColumn("many", F.col("bytes") >= min_payload), "payloads")
    size = known.agg(F.sum(F.col("bytes") * F.col("rows")), F.sum("rows")).first()
    repeated = known.filter("rows > ids or (many and ids > 1)").select("sha", "original", (F.col("rows") > F.col("ids")).alias("copies"))
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    found = slim.join(repeated, "sha", "left")
    once = found.filter("copies is null or not copies").withColumn("nth", F.lit(1))
    # equal rows are combined where they stand, then numbered
    equal = found.filter("copies").groupBy("id", "sha").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "payload", "bytes", "original", "copies")], F.count("*").cast("int").alias("n"))
    equal = equal.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    rows = once.unionByName(equal)
    rows = rows.withColumn("again", F.coalesce((F.col("original") != F.col("id")) | (F.col("nth") > 1), F.lit(False)) & (F.col("bytes") >= min_payload))
    rows = rows.withColumn("id", F.when(F.col("nth") > 1, F.concat_ws(":", "id", "nth")).otherwise(F.col("id")))
    each = max(1, min(pages_per_file, int(file_bytes * (size[1] or 1) / max(1, size[0] or 1))))

    clean = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f<>]", "_")
    shared = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", clean)]
    link = F.concat(F.lit("<"), F.col("id"), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("sha")))
    kind = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", F.col("id"), [*shared, digest, kind], F.concat(http, F.col("payload")))
    revisit = _record("revisit", F.col("id"), [*shared, digest, kind, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", F.concat(F.lit("<"), F.col("original"), F.lit(">")))], http)
    asked = F.concat(F.lit("GET "), F.coalesce(clean, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}User-Agent: kinweave{CRLF}{CRLF}"))
    request = _record("request", F.concat("id", F.lit(":request")), [*shared, ("WARC-Concurrent-To", link), ("Content-Type", F.lit("application/http; msgtype=request"))], asked)
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF), F.coalesce(F.concat(F.lit("page-url-base64: "), F.translate(F.base64(F.col("url").cast("binary")), "\r\n", ""), F.lit(CRLF)), F.lit("")))
    metadata = _record("metadata", F.concat("id", F.lit(":metadata")), [*shared, ("WARC-Concurrent-To", link), ("Content-Type", F.lit("application/warc-fields"))], about)
    records = rows.select(F.explode(F.array(request, F.when(F.col("again"), revisit).otherwise(response), metadata)).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("zlib.compress.level", level).option("maxRecordsPerFile", 3 * each).text(path)
    drop(known)


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file that comes in pieces; blank lines between records are skipped."""
    held, size = [next(pieces, b"")], 0
    size = len(held[0])

    def more() -> bool:
        nonlocal size
        piece = next(pieces, None)
        if piece is None:
            return False
        held.append(piece)
        size += len(piece)
        return True

    while True:
        data = b"".join(held)
        start = len(data) - len(data.lstrip(b"\r\n"))
        stop = data.find(b"\r\n\r\n", start)
        if stop < 0:
            held, size = [data[start:]], len(data) - start
            if more():
                continue
            if held[0]:
                raise ValueError(f"the file ends in the headers of a record: {held[0][:40]!r}")
            return
        head = data[start:stop].decode("utf-8", "replace").split(CRLF)
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {head[0][:40]!r}")
        headers = {}
        for line in head[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        end = stop + 4 + int(headers.get("content-length", 0))
        held, size = [data], len(data)
        while size < end:
            if not more():
                raise ValueError(f"the file ends {end - size} bytes before its record does")
        data = b"".join(held) if len(held) > 1 else data
        yield headers, data[stop + 4 : end]
        held, size = [data[end:]], len(data) - end


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind, payload, length, fields = headers.get("warc-type"), None, None, {}
    if kind in ("response", "revisit"):
        top, _, body = block.partition(b"\r\n\r\n")
        for line in top.split(b"\r\n")[1:]:
            if line.lower().startswith(b"content-length:"):
                length = int(line[15:])
        if kind == "response":
            payload, length = body, len(body)
    elif kind == "metadata":
        for line in block.decode("utf-8", "replace").split(CRLF):
            name, colon, value = line.partition(":")
            if colon:
                fields[name.strip().lower()] = value.strip()
    bare = lambda k: headers[k].strip("<>") if k in headers else None
    digest = hashlib.sha256(payload).hexdigest() if payload is not None else headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
    return bare("warc-record-id"), kind, bare("warc-concurrent-to"), bare("warc-target-uri"), headers.get("warc-date"), bare("warc-refers-to"), digest, length, payload, list(fields.items())


def read_records(spark: SparkSession, path: str, rows: int = 256, block_bytes: int = 4 << 20) -> DataFrame:
    """Records of all archives under path, one row each; digest is that of the payload read, or for revisits the stated one.

    Archives are *.gz, with any number of members, and *.warc, which are not
    compressed and below 2 GB. A file is read by one task, which for *.gz holds
    one record and at most `rows` records or block_bytes of output at a time. A file that ends within a
    record or a gzip member raises an error.
    """
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])
    small_batches(spark)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
        lines = ((name, piece) for batch in batches for name, piece in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist(), strict=True))
        for name, group in itertools.groupby(lines, key=lambda x: x[0]):
            yield name, (part for _, piece in group for part in (piece + SEPARATOR,))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
            return out

        for _, pieces in files(batches):
            for headers, block in records_of(pieces):
                held.append(_row(headers, block))
                size += len(block)
                if len(held) == rows or size >= block_bytes:
                    yield flush()
        if held:
            yield flush()

    lines = spark.read.option("lineSep", CRLF + CRLF).option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").text(path)
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").option("recursiveFileLookup", "true").load(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).union(plain.select("path", "content"))
    return pieces.mapInArrow(tidy(parse), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, and structs response, requests and metadata.

    Requests and metadata belong to the response or revisit that they name as
    concurrent, directly or through one record between, or that names them.
    Only ids move to resolve the links; payloads move once, and not at all where
    the caller does not select them. Records without any response make a capture
    with a null response, named by the record they point to or else by
    themselves. Records that repeat an id count once. records should be a
    written table: it is read several times.
    """
    main = F.col("type").isin("response", "revisit")
    answers = records.filter(main)
    small = records.filter(~main & F.col("type").isin("request", "metadata")).select("record_id", "type", "concurrent_to", "target_uri", "date", "fields").dropDuplicates(["record_id"])
    names = answers.select("record_id", "concurrent_to").distinct()
    known = names.select(F.col("record_id").alias("id"), F.col("record_id").alias("capture")).union(names.filter("concurrent_to is not null").select("concurrent_to", "record_id"))
    direct = small.select("record_id", F.explode(F.array("record_id", "concurrent_to")).alias("id")).join(known, "id").groupBy("record_id").agg(F.min("capture").alias("capture"))
    small = small.join(direct, "record_id", "left")
    via = direct.select(F.col("record_id").alias("concurrent_to"), F.col("capture").alias("through"))
    small = small.join(via, "concurrent_to", "left").withColumn("capture", F.coalesce("capture", "through", "concurrent_to", "record_id"))
    part = F.struct("record_id", "target_uri", "date", "fields")
    sides = small.groupBy("capture").agg(F.sort_array(F.collect_list(F.when(F.col("type") == "request", F.struct("record_id", "target_uri", "date")))).alias("requests"), F.array_sort(F.collect_list(F.when(F.col("type") == "metadata", part)), lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)).alias("metadata"))
    answer = ("type", "target_uri", "date", "refers_to", "digest", "payload_bytes", "payload")
    whole = answers.dropDuplicates(["record_id"]).select("record_id", *answer).join(sides, F.col("record_id") == F.col("capture"), "left")
    empty = lambda c: F.coalesce(c, F.from_json(F.lit("[]"), sides.schema[c].dataType))
    # a struct of columns as they are, so that what a caller does not select is never read
    found = whole.select("record_id", F.struct(*answer).alias("response"), empty("requests").alias("requests"), empty("metadata").alias("metadata"))
    alone = sides.join(answers.select("record_id").distinct(), F.col("capture") == F.col("record_id"), "left_anti")
    return found.unionByName(alone.select(F.col("capture").alias("record_id"), F.lit(None).cast(found.schema["response"].dataType).alias("response"), "requests", "metadata"))


def page_of(record_id: Column) -> Column:
    """The page_id in a record id that write_archives gave."""
    return F.regexp_extract(record_id, r"^urn:page:(-?\d+|null):", 1).try_cast("long")


def archive_pages(pages: DataFrame, path: str | None = None, min_payload: int = 100) -> DataFrame:
    """Write pages to archives under path (by default a new shared folder, which goes when they have been read back), and assemble the captures: one per row of pages."""
    spark = pages.sparkSession
    where = path or fresh(spark, "warc")
    try:
        write_archives(pages, where, min_payload)
        return assemble(stage(read_records(spark, where), "records"))
    finally:
        if path is None:
            remove(spark, where)


def decode_url(value: str | None) -> str | None:
    """The url in a metadata record's page-url-base64 field."""
    return None if value is None else base64.b64decode(value).decode()
