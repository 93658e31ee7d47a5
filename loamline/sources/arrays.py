"""JSON documents that hold one long array, read element by element: a document of any size needs the memory of its largest element."""

import codecs
import hashlib
import json
import re
from json.decoder import JSONDecodeError

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are read at once.
PIECE = 1 << 20
BLANK = re.compile(r"[ \t\n\r]*")


class Scanner:
    """Pulls values out of text that comes in pieces. more: gives the next piece, empty at the end."""

    def __init__(self, more):
        self.more, self.text, self.at, self.over = more, "", 0, False
        self.decode = json.JSONDecoder().raw_decode

    def fill(self) -> bool:
        """Adds a piece, and as much as is held already if that is more, so that an element is tried a few times however long it is."""
        if self.over:
            return False
        got, wanted = [self.text[self.at :]], len(self.text) - self.at
        while not self.over:
            piece = self.more()
            self.over = not piece
            got.append(piece)
            wanted -= len(piece)
            if wanted <= 0:
                break
        self.text, self.at = "".join(got), 0
        return True

    def peek(self) -> str:
        """The next character that isn't blank, or nothing."""
        while True:
            self.at = BLANK.match(self.text, self.at).end()
            if self.at < len(self.text) or not self.fill():
                return self.text[self.at : self.at + 1]

    def take(self, mark: str) -> None:
        if self.peek() != mark:
            raise ValueError(f"{mark} is missing")
        self.at += 1

    def value(self) -> tuple[object, str]:
        """The next value and its text. A number at the end of what is there may go on, so it is told once something follows."""
        self.peek()
        while True:
            try:
                found, end = self.decode(self.text, self.at)
                if end < len(self.text) or self.over:
                    out = self.text[self.at : end]
                    self.at = end
                    return found, out
            except JSONDecodeError:
                if self.over:
                    raise
            self.fill()


def elements(scanner: Scanner, array: str):
    """("field", name, value) of the document's other fields as they come, and ("element", nth, text) of each element of its array. What follows the document is an error."""
    scanner.take("{")
    while scanner.peek() != "}":
        name, _ = scanner.value()
        scanner.take(":")
        if name == array and scanner.peek() == "[":
            scanner.take("[")
            nth = 0
            while scanner.peek() != "]":
                yield "element", nth, scanner.value()[1]
                nth += 1
                if scanner.peek() != "]":
                    scanner.take(",")
            scanner.take("]")
        else:
            yield "field", name, scanner.value()[0]
        if scanner.peek() != "}":
            scanner.take(",")
    scanner.take("}")
    if scanner.peek():
        raise ValueError("something follows the document")


class File(InputPartition):
    def __init__(self, path: str, sha: str):
        self.path, self.sha = path, sha


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[File]:
        """One for each file: a compressed document can be read from its start only."""
        return [File(path, sha) for path, sha in json.loads(self.options["files"])]

    def read(self, partition: File):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.path if "://" in partition.path else f"file://{partition.path.removeprefix('file:')}")
        digest, decoder = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")()
        with store.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as f:

            def more() -> str:
                while True:
                    piece = f.read(int(self.options.get("piecebytes", PIECE)))
                    digest.update(piece)
                    text = decoder.decode(piece, final=not piece)
                    if text or not piece:
                        return text

            fields, n = {}, 0
            for kind, name, value in elements(Scanner(more), self.options["array"]):
                if kind == "element":
                    n += 1
                    yield partition.path, name, value, None
                else:
                    fields[name] = value
        if partition.sha and partition.sha != digest.hexdigest():
            raise ValueError(f"{partition.path} doesn't have the checksum that is told")
        yield partition.path, None, json.dumps(fields), n


class JsonArrays(DataSource):
    """Options: files, a JSON list of (path, SHA-256 of the text or an empty string); array, the name of the field; pieceBytes."""

    @classmethod
    def name(cls) -> str:
        return "json_arrays"

    def schema(self) -> str:
        return "path string, nth long, value string, n long"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader({k.lower(): v for k, v in self.options.items()})


def read_arrays(spark: SparkSession, files: list[tuple[str, str]], array: str, piece_bytes: int = PIECE) -> DataFrame:
    """(path, nth, value, n): each element of each document's array as JSON text, and a last row of a document with its other fields and the number of elements n.

    A document whose text doesn't have the SHA-256 told for it fails the job, after its elements have been read: nothing of it can be kept. files: one entry for each
    document, paths that driver and executors can open with pyarrow.
    """
    spark.dataSource.register(JsonArrays)
    return spark.read.format("json_arrays").option("files", json.dumps(files)).option("array", array).option("pieceBytes", piece_bytes).load()


def stream_feeds(spark: SparkSession, folder: str, record) -> DataFrame:
    """(feed, record): what feeds.read_feeds() reads, with no feed in one row: the yearly feeds' records, checked against the .meta beside a feed, if there is one."""
    from .feeds import NAME

    found = spark.read.format("binaryFile").load(folder).where(F.col("path").rlike(NAME)).select("path").collect()  # a row for each year
    if not found:
        raise ValueError("no yearly feed")
    metas = spark.read.text(folder, wholetext=True).where(F.col("_metadata.file_path").endswith(".meta"))
    said = {r.m: r.sha for r in metas.select(F.regexp_extract(F.element_at(F.split("_metadata.file_path", "/"), -1), r"^(.*)\.meta$", 1).alias("m"), F.lower(F.regexp_extract("value", r"sha256:([0-9A-Fa-f]{64})", 1)).alias("sha")).collect()}
    stem = lambda p: re.sub(r"\.json(\.gz)?$", "", p.rsplit("/", 1)[-1])
    rows = read_arrays(spark, [(r.path, said.get(stem(r.path), "")) for r in found], "vulnerabilities").where("nth IS NOT NULL")
    parsed = F.from_json("value", f"cve {record.simpleString()}")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("feed"), parsed["cve"].alias("record"))
