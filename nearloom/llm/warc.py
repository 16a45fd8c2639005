"""WARC archives: a writer that keeps each payload once, and a splittable reader.

Records are gzip members of their own, so a task can start anywhere in a file:
it scans its byte range for gzip magic, takes a place for a record only if
what decompresses there begins like a WARC record, and owns the records that
start inside its range, reading past its end where the last one does.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearloom.llm.runtime import shared_path, ship, slices, stored

VERSION = b"WARC/1.0\r\n"
MAGIC, BEGIN, BLANK = b"\x1f\x8b\x08", b"WARC/", b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Bytes of an archive that one task scans, and bytes read at once.
SPLIT, BLOCK = 32 << 20, 1 << 20
#: Bytes that are decompressed, and read past a range's end, at once.
CHUNK = 16 << 10
MOST_TASKS = 100_000
#: Digests of repeated payloads that are few enough to be broadcast (28 bytes each).
SENT_DIGESTS = 200_000
#: Bytes that are decompressed at once until a record's headers have ended, whatever their length.
LOOK = 1 << 20


def digest32(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in headers)
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = VERSION + lines.encode("utf-8", "surrogatepass") + f"Content-Length: {len(block)}\r\n\r\n".encode()
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write(pages: DataFrame, target: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, level: int = 1) -> None:
    """Write ``pages`` as ``*.warc.gz`` files, one per task, in the folder ``target`` (a URI that all executors share).

    Of records with equal payloads of ``least`` bytes or more, that with the
    largest id is a response and the others revisit it; smaller payloads are
    all responses.  Null payloads are empty.  Rows that repeat the largest id
    are responses too; a null id revisits if any id has its payload.  A task
    writes under a name of its own and renames it when whole, so a task that
    runs twice leaves one file.
    """
    spark = pages.sparkSession
    ship(spark)
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("body")))
    small = F.length("body") < least
    # Only payloads that occur again have a partner, and only their digests and ids are shuffled for it.
    first = stored(rows.where(~small).groupBy(F.col("sha").alias("of")).agg(F.max("id").alias("refers"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    again = F.col("refers").isNotNull() & ~F.col("refers").eqNullSafe(F.col("id"))
    if first.count() <= SENT_DIGESTS:
        known = rows.join(F.broadcast(first), (F.col("sha") == F.col("of")) & ~small, "left")
    else:
        # Too many to send: who revisits whom is found without bodies, and those then meet it by page, not by digest.
        told = rows.where(~small).select("id", "sha").distinct().join(first, F.col("sha") == F.col("of")).where(again)
        told = told.select(F.col("id").alias("_id"), F.col("sha").alias("of"), "refers")
        known = rows.join(told, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("of")) & ~small, "left")
    known = known.select("id", "url", "sha", F.length("body").alias("size"), "refers", again.alias("again"), F.when(~again, F.col("body")).alias("body"))
    _filesystem(target)[0].create_dir(_filesystem(target)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _filesystem(target)
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, own, count, size = f"{folder}/part-{part:06d}.warc.gz", f"{folder}/_{part:06d}-{uuid.uuid4().hex}", 0, 0
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(own) as out:
            for b in slices(batches):
                for page, url, sha, length, refers, again, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    of = lambda x: f"<urn:page:{'' if x is None else x}>"
                    headers = [
                        ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", of(page)), ("WARC-Target-URI", url or ""), ("WARC-Date", "1970-01-01T00:00:00Z"),
                        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(sha).decode()}"), ("X-Payload-Length", str(length)), ("Content-Type", "text/html;charset=utf-8"),
                    ]
                    if again:
                        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", of(refers))]
                    data = _member(headers, payload or b"", level)
                    out.write(data)
                    count, size = count + 1, size + len(data)
        if count:
            if files.get_file_info(name).type != fs.FileType.NotFound:
                files.delete_file(name)  # of a lost run of this task
            files.move(own, name)
        else:
            files.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["records", "bytes"])

    known.mapInArrow(run, "records long, bytes long").agg(F.sum("records"), F.sum("bytes")).collect()


class _Window:
    """The bytes of a file from ``at`` on, read once and forwards; what is behind is forgotten."""

    def __init__(self, f: pa.NativeFile, at: int):
        self.f, self.at, self.held, self.ended = f, at, bytearray(), False
        f.seek(at)

    def more(self, size: int = BLOCK) -> bytes:
        """The next bytes past those held; held too."""
        got = b"" if self.ended else self.f.read(size)
        self.ended = self.ended or not got
        self.held += got
        return got

    def forget(self, to: int) -> None:
        del self.held[: to - self.at]
        self.at = to


def _member_at(window: _Window) -> tuple[dict[str, str], bytes, int] | None:
    """``(headers, block, end)`` of the record whose gzip member starts where ``window`` does; None if there is none.

    What decompresses is looked at as it comes, so a place that does not begin
    like a record is given up at once; one that does is read to its blank line.
    """
    unpack, out, found = zlib.decompressobj(31), bytearray(), None
    done = looked = 0
    while not unpack.eof:
        if done == len(window.held) and not window.more(CHUNK):
            return None
        part = bytes(window.held[done : done + CHUNK])
        done += len(part)
        while not unpack.eof:
            most = 0 if found else LOOK  # no more at once than tells whether this is a record at all
            try:
                got = unpack.decompress(part, most)
            except zlib.error:
                return None
            out += got
            if found is None:
                if not BEGIN.startswith(bytes(out[: len(BEGIN)])):
                    return None
                end = out.find(BLANK, max(0, looked - len(BLANK)))
                looked = len(out)
                if end >= 0 and (found := _headers(out[:end])) is None:
                    return None
            part = unpack.unconsumed_tail
            if not part and (not most or len(got) < most):
                break
    if found is None:
        return None
    headers, body = found
    length = int(headers["content-length"])
    end = window.at + done - len(unpack.unused_data)
    return (headers, bytes(out[body : body + length]), end) if len(out) >= body + length else None


def _number(text: str | None) -> bool:
    return text is not None and text.isascii() and text.isdigit()


def _headers(data: bytes | bytearray) -> tuple[dict[str, str], int] | None:
    """The headers ``data``, up to their blank line, by lower-case name, and where the block starts; None if a record's are not there."""
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    of = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return (of, len(data) + len(BLANK)) if _number(of.get("content-length")) and "warc-type" in of else None


def records(f: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(offset, headers, block)`` of the records that start in ``[start, stop)``, found by scanning for gzip magic.

    The range is read once, and past its end only as far as the last record
    that starts in it.  After a record its end is the next place tried.
    """
    window = _Window(f, start)
    while True:
        hit = window.held.find(MAGIC, 0, max(0, stop - window.at) + len(MAGIC) - 1)
        if hit < 0:
            window.forget(window.at + max(0, len(window.held) - len(MAGIC) + 1))
            if window.at >= stop or not window.more(min(BLOCK, stop - window.at + len(MAGIC) - 1)):
                return
            continue
        window.forget(window.at + hit)
        if window.at >= stop:
            return
        found = _member_at(window)
        if found is None:
            window.forget(window.at + 1)
        else:
            headers, block, end = found
            yield window.at, headers, block
            window.forget(end)


def read(spark: SparkSession, source: str, split: int = SPLIT) -> DataFrame:
    """The records below ``source``: ``(path, offset, record_type, record_id, refers_to, target_uri, payload_digest, payload_bytes, block)``.

    Files are listed by Spark and cut in ranges of ``split`` bytes, one row
    each, dealt to tasks; no file is read whole.  Absent headers are null.
    An empty folder gives no rows.
    """
    schema = "path string, offset long, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, block binary"
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(source).select("path", "length")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    # A task for each range: adaptive execution would put these few small rows into one.
    ranges = ranges.repartition(max(1, min(ranges.count(), MOST_TASKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "offset", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes", "block"]
        types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in slices(batches):
            for path, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                uri = path if "://" in path else re.sub(r"^file:/*", "file:///", path)
                files, name = _filesystem(uri)
                rows, size = [], 0
                with files.open_input_file(name) as f:
                    for at, h, block in records(f, start, min(start + split, f.size())):
                        length = h["x-payload-length"] if _number(h.get("x-payload-length")) else h["content-length"]
                        rows.append((path, at, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), int(length), block))
                        size += len(block)
                        if size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return ranges.mapInArrow(run, schema)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, split: int = SPLIT) -> DataFrame:
    """``pages`` written as an archive in the shared folder and read back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    A response's size and digest are taken from the payload that was read; a
    revisit has its response's, which its headers state.  Urls may be of any
    length.  Null urls and payloads are empty, a null id stays null, repeated
    rows are records each; an empty table gives no rows; only the three named
    columns are read.
    """
    spark = pages.sparkSession
    target = shared_path(spark, "warc")
    write(pages, target, id_col, url_col, payload_col, least)
    number = lambda c: F.regexp_extract(c, r"page:(-?\d*)>", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    rows = read(spark, target, split).select("record_type", "record_id", "refers_to", "payload_digest", "payload_bytes", F.when(F.col("record_type") == "response", F.struct(F.length("block").alias("n"), F.sha1("block").alias("sha"))).alias("own"))
    digest = F.regexp_replace("payload_digest", "^sha1:", "")
    return rows.select(
        as_id("record_id").alias("page_id"), F.coalesce("own.n", "payload_bytes").cast("long").alias("payload_bytes"), F.coalesce(base32(F.col("own.sha")), digest).alias("payload_digest"),
        "record_type", as_id("refers_to").alias("refers_to"),
    )


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: 20 bits, four letters, from each five digits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = [F.conv(F.substring(sha1_hex, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    return F.concat(*[F.substring(F.lit(letters), F.shiftright(b, s).bitwiseAND(31) + 1, F.lit(1)) for b in bits for s in (15, 10, 5, 0)])
