"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole records, and a seek table in a skippable frame at its end. An index
maps each record to its bundle, its frame and its offset within the frame's content, so that one record is read by one ranged read.
"""

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, small_batches, written

#: Bytes of records after which a frame, and bytes of frames after which a bundle, is ended.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 256 << 20
#: Fixed values of the Zstandard seekable format: the magic of its skippable frame, and that of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, page_id long, record_type string, bundle string, frame int, frame_at long, frame_bytes long, at long, bytes long"
READ = "record_id string, page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def filesystem(uri: str):
    """The file system of a URI in pyarrow, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, url: str | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id} copy {copy} of {url!r}')}>"


def record(page_id, copy: int, url: str | None, kind: str, payload: bytes, full_bytes: int, sha1: str, refers_to, refers_url: str | None) -> bytes:
    """One WARC/1.1 record. A revisit has no content; where its payload is, how long it is and its digest are in its header."""
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url, copy)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{sha1}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {full_bytes}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_id(refers_to, refers_url, 0)}", f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record at an offset: its header, its content and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(head["Content-Length"])
    body = data[end + 4 : end + 4 + size]
    if len(body) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError(f"a record is cut short at {at}")
    return head, body, end + 8 + size


class Bundle:
    """Writes one bundle; close() gives the index of its records. The file gets its name only when it is whole."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.uri, self.frame_bytes = uri, frame_bytes
        self.fs, self.path = filesystem(uri)
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.frames, self.at, self.content, self.rows, self.index = [], 0, [], [], []
        self.held = 0

    def add(self, key: tuple, data: bytes) -> None:
        self.rows.append((key, self.held, len(data)))
        self.content.append(data)
        self.held += len(data)
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        packed = self.zstd.compress(b"".join(self.content))
        self.index += [(*key, self.uri, len(self.frames), self.at, len(packed), at, n) for key, at, n in self.rows]
        self.frames.append((len(packed), self.held))
        self.out.write(packed)
        self.at += len(packed)
        self.content, self.rows, self.held = [], [], 0

    def close(self) -> list[tuple]:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.index


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """Of each frame: its offset in the file, its compressed and its content bytes."""
    n, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    raw, at, out = file.read_at(8 * n, size - 9 - 8 * n), 0, []
    for packed, content in struct.iter_unpack("<II", raw):
        out.append((at, packed, content))
        at += packed
    return out


def read_record(uri: str, frame_at: int, frame_bytes: int, at: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: one ranged read, one frame unpacked."""
    import zstandard

    fs, path = filesystem(uri)
    with fs.open_input_file(path) as file:
        return parse(zstandard.ZstdDecompressor().decompress(file.read_at(frame_bytes, frame_at)), at)[:2]


def record_types(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, payload binary, not null). A row for each record to write: page_id, url, copy, sha1 (hex), bytes, kind, refers_to, refers_url, payload.

    Of the records with one payload, one with the largest page_id (null is the least; then by url) is response, the others revisit it.
    Repeated rows are told apart by `copy`. Only distinct payloads are moved, combined before they are; revisits move their headers.
    """
    rows = pages.withColumns({"sha1": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    kept = rows.groupBy("sha1", "bytes").agg(F.max(F.struct("page_id", "url")).alias("top"), F.any_value("payload").alias("payload"))
    response = kept.select("top.page_id", "top.url", F.lit(0).alias("copy"), "sha1", "bytes", F.lit("response").alias("kind"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"), "payload")
    each = rows.groupBy("sha1", "bytes", "page_id", "url").count()
    tops = rows.groupBy("sha1", "bytes").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    tops = written(tops, "warc-tops")  # a table of its own, so that the rows of one payload can be dealt to several tasks in the join
    more = each.join(tops, ["sha1", "bytes"]).withColumn("first", (F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url"))).cast("int"))
    more = more.where("count > first").withColumn("copy", F.explode(F.sequence(F.col("first").cast("int"), F.col("count").cast("int") - 1)))
    revisit = more.select("page_id", "url", "copy", "sha1", "bytes", F.lit("revisit").alias("kind"), F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_url"), F.lit(None).cast("binary").alias("payload"))
    return response.union(revisit)


def write_warc(pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, folder: str | None = None) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, payload) to bundles in a shared folder; returns the index, a written table.

    Bundles have names of their own for every attempt of a task, and only those that the index names count: what a lost or repeated
    task has left is never read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "warc")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def write(batches):
        bundle, names = None, [f.split()[0] for f in INDEX.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

        def done(bundle):
            rows = bundle.close()
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000], strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for page_id, url, copy, sha1, size, kind, refers_to, refers_url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle = bundle or Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame_bytes)
                bundle.add((record_id(page_id, url, copy), page_id, kind), record(page_id, copy, url, kind, payload or b"", size, base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, refers_url))
                if bundle.at >= bundle_bytes:
                    yield from done(bundle)
                    bundle = None
        if bundle:
            yield from done(bundle)

    return written(record_types(pages).mapInArrow(write, INDEX), "warc-index")


def read_warc(index: DataFrame, frames_per_task: int = 64) -> DataFrame:
    """All records of the bundles that an index names, found by the bundles' own seek tables; a response's digest is recomputed and must agree."""
    small_batches(index.sparkSession)
    bundles = index.groupBy("bundle").agg((F.max("frame") + 1).alias("frames"))
    ranges = bundles.select("bundle", F.explode(F.sequence(F.lit(0), F.col("frames") - 1, F.lit(frames_per_task))).alias("first"))

    def read(batches):
        import zstandard

        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            for uri, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as file:
                    for at, packed, _ in seek_table(file, file.size())[first : first + frames_per_task]:
                        data, pos, rows = zstandard.ZstdDecompressor().decompress(file.read_at(packed, at)), 0, []
                        while pos < len(data):
                            head, body, pos = parse(data, pos)
                            said, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                            if kind == "response" and said != digest(body):
                                raise ValueError(f"{head['WARC-Record-ID']} doesn't have the digest in its header")
                            number = lambda x: int(x) if x else None
                            rows.append((head["WARC-Record-ID"], number(head["X-Page-Id"]), kind, number(head.get("X-Refers-To-Page-Id", "")), body if kind == "response" else None, len(body) if kind == "response" else int(head["X-Payload-Length"]), said))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in READ.split(", ")])

    return ranges.repartition(F.col("bundle"), F.col("first")).mapInArrow(read, READ)


def op1_warc(spark, sf_dir):
    """A record for each page, written and read back. A null page_id is kept; a null html is an empty payload."""
    from .shared import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    out = read_warc(write_warc(pages))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
t AS (SELECT *, row_number() OVER w AS nth, first_value(page_id) OVER w AS top, sha1(h) || '00' AS x FROM p
      WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST))
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(x, ((i * 5) // 8 * 2 + 1)::INT, 4))::INT >> (11 - (i * 5) % 8)::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN top END AS refers_to FROM t
"""
