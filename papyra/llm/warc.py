"""WARC archives: writing with revisit records, a record index, and coalesced range reads.

Archives are written by Spark's text sink, whose line separator is the CRLF CRLF that ends
a WARC record; so files are committed as Spark commits any output.  The index holds path,
offset, length, url and payload digest of each record.  Selected records are read by their
byte ranges, sorted and merged into runs, through the file system that the path names.
"""

from __future__ import annotations

from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.kernel import lean
from papyra.llm.scratch import Scratch, bytes_in

END = "\r\n\r\n"
READ = 1 << 20
#: Ranges nearer than GAP are read together, in runs of RUN bytes at most unless one record is longer.
GAP, RUN = 1 << 16, 4 << 20
#: Bytes of archives that one task reads, and of the table of repeated payloads that may be broadcast.
TASK_BYTES, BROADCAST_BYTES, SALTS = 16 << 20, 16 << 20, 64
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32(digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits: four groups of 40 bits, 5 bits a letter."""
    letters, out = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), []
    for k in range(4):
        group = F.conv(F.substring(digest, 10 * k + 1, 10), 16, 10).cast("long")
        out += [letters.substr((F.shiftright(group, 35 - 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*out)


def repeated_payloads(pages: DataFrame) -> DataFrame:
    """payload_digest, payload_bytes, first_id: payloads of several records, with the smallest page_id that has each.

    Digests alone are shuffled, and are combined before; a null page_id is none, so
    payloads that only rows without an id have are left out.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    narrow = pages.select("page_id", F.sha1(payload.cast("binary")).alias("hex"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    counted = narrow.groupBy("hex", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    return counted.where("n > 1 AND first_id IS NOT NULL").select("hex", "payload_bytes", "first_id")


def classify(pages: DataFrame, scratch: Scratch, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to of every row of pages.

    The response is the smallest page_id of a payload; its rows, should an id recur, are all
    responses.  A null page_id comes after all others.  The table of repeated payloads goes
    to the pages where its size on disk allows, so html is not shuffled; else pages meet
    it in a join, html compressed, and as one payload may be a third of all pages, each payload's
    row is there once for each of SALTS parts of the pages.
    """
    repeated = scratch.save(repeated_payloads(pages), "repeated")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    # the digest is a column before its letters are taken, so that it is computed once
    rows = rows.select("*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha1(F.col("html").cast("binary")).alias("hex"))
    if bytes_in(pages.sparkSession, repeated.scratch_path) <= broadcast_bytes:
        both = rows.join(F.broadcast(repeated), ["hex", "payload_bytes"], "left")
    else:
        part = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        packed = rows.withColumn("part", part).mapInArrow(_pack, "page_id long, url string, payload_bytes long, hex string, part int, packed binary")
        salted = repeated.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = packed.join(salted, ["hex", "payload_bytes", "part"], "left").drop("part")
        both = both.mapInArrow(_unpack, "page_id long, url string, payload_bytes long, hex string, first_id long, html string")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return both.select(
        "page_id", "url", "html", "payload_bytes", base32(F.col("hex")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Html compressed, as it goes through a shuffle."""
    codec, names = pa.Codec("zstd", 3), ["page_id", "url", "payload_bytes", "hex", "part"]
    for batch in batches:
        packed = [codec.compress(h.encode(), asbytes=True) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(packed, pa.binary())], [*names, "packed"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec, names = pa.Codec("zstd"), ["page_id", "url", "payload_bytes", "hex", "first_id"]
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):
            batch = whole.slice(lo, 512)
            html = [codec.decompress(x, decompressed_size=n, asbytes=True).decode() if n else "" for x, n in zip(batch.column("packed").to_pylist(), batch.column("payload_bytes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(html, pa.string())], [*names, "html"])


def _clean(value: Column) -> Column:
    """A header value: control characters would end the header."""
    return F.regexp_replace(value, r"[\x00-\x1F\x7F]", "%20")


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, scratch: Scratch, *, date: str = "2024-01-01T00:00:00Z", broadcast_bytes: int = BROADCAST_BYTES) -> None:
    """One record for each row of pages (page_id, url, html); null html is an empty payload."""
    rows = classify(pages, scratch, broadcast_bytes)
    body = F.when(F.col("record_type") == "response", F.concat(F.lit(HTTP), F.col("payload_bytes").cast("string"), F.lit(END), F.col("html"))).otherwise("")
    size = F.octet_length("body").cast("string")

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))

    revisit = F.col("record_type") == "revisit"
    record = F.concat(
        F.lit("WARC/1.1"), header("WARC-Type", F.col("record_type")), header("WARC-Record-ID", _name(F.col("page_id"))), header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", _clean(F.col("url"))), header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Payload-Length", F.col("payload_bytes").cast("string")), header("WARC-Refers-To", F.when(revisit, _name(F.col("refers_to")))),
        header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        header("Content-Type", F.lit("application/http; msgtype=response")), header("Content-Length", size), F.lit(END), F.col("body"),
    )
    rows.withColumn("body", body).select(record.alias("value")).write.option("lineSep", END).text(path)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark's listing gives it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _index_file(path: str) -> Iterator[tuple[int, int, str | None, str | None, str]]:
    """(offset, length, url, digest, type) of each record, reading headers and skipping over blocks."""
    system, name = _open(path)
    with system.open_input_file(name) as file:
        end, offset, held, base = file.size(), 0, b"", 0
        while offset < end:
            if not base <= offset < base + len(held):
                base, held = offset, file.read_at(min(READ, end - offset), offset)
            while (stop := held.find(b"\r\n\r\n", offset - base)) < 0:
                more = file.read_at(min(READ, end - base - len(held)), base + len(held))
                if not more:
                    raise ValueError(f"{path}: the record at {offset} has no end of its header")
                base, held = offset, held[offset - base :] + more
            found = _headers(held[offset - base : stop])
            length = stop + 4 - (offset - base) + int(found["content-length"]) + 4
            if offset + length > end:
                raise ValueError(f"{path}: the record at {offset} is cut off")
            yield offset, length, found.get("warc-target-uri"), (found.get("warc-payload-digest") or "").removeprefix("sha1:") or None, found.get("warc-type", "")
            offset += length


def index_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, length, url, digest, record_type of every record of the archives below a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "offset", "length", "url", "digest", "record_type"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows: list[tuple] = []
                for found in _index_file(name):
                    rows.append((name, *found))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # the listing only: the content column is not read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "length")
    return files.repartition(F.col("path")).select("path").mapInArrow(run, "path string, offset long, length long, url string, digest string, record_type string")


def coalesce_ranges(index: DataFrame) -> DataFrame:
    """path, start, stop, ranges: sorted ranges of each archive, merged into runs.

    A run never crosses a multiple of RUN, so cells of RUN bytes are sorted alone, however
    large an archive is.
    """
    rows = index.withColumn("_cell", F.floor(F.col("offset") / RUN))
    order = Window.partitionBy("path", "_cell").orderBy("offset")
    stop = F.lag(F.col("offset") + F.col("length")).over(order)
    rows = rows.withColumn("_jump", ((F.col("offset") - stop > GAP) | stop.isNull()).cast("long"))
    rows = rows.withColumn("_run", F.sum("_jump").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = F.sort_array(F.collect_list(F.struct("offset", "length")))
    return rows.groupBy("path", "_cell", "_run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), ranges.alias("ranges")).select("path", "start", "stop", "ranges")


def read_records(index: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest of the records of an index.

    A response's digest and length are taken from the payload that was read, and must be
    those of its header.  A revisit has no payload; its header has both of the full payload.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            for path, start, stop, ranges in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop", "ranges")), strict=True):
                system, name = _open(path)
                with system.open_input_file(name) as file:
                    raw = memoryview(file.read_at(stop - start, start))
                rows = [_record(bytes(raw[r["offset"] - start : r["offset"] - start + r["length"]])) for r in ranges]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # an index row stands for many bytes: runs are dealt out by the bytes they read, in the order of the archives
    total = index.agg(F.sum("length")).first()[0] or 0
    runs = coalesce_ranges(index).repartitionByRange(max(1, -(-total // TASK_BYTES)), "path", "start").sortWithinPartitions("path", "start")
    return runs.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def _id(value: str | None) -> int | None:
    text = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def _record(raw: bytes) -> tuple[int | None, str | None, str, int | None, bytes | None, int, str]:
    stop = raw.index(b"\r\n\r\n")
    found = _headers(raw[:stop])
    block = raw[stop + 4 : -4]
    digest = found["warc-payload-digest"].removeprefix("sha1:")
    size = int(found["warc-payload-length"])
    payload = None
    if found["warc-type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if len(payload) != size or b32encode(sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {found['warc-record-id']} is not what its header says")
    return _id(found["warc-record-id"]), found.get("warc-target-uri"), found["warc-type"], _id(found.get("warc-refers-to")), payload, size, digest


def archive_round_trip(pages: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Write every row of pages to archives in the shared folder, index them, and read all records back.

    Other columns of pages are ignored; the result is as read_records() gives it.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path("archives")
    write_archives(pages.select("page_id", "url", "html"), path, scratch, broadcast_bytes=broadcast_bytes)
    index = scratch.save(index_archives(pages.sparkSession, path), "index")
    return read_records(index)
