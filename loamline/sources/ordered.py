"""Lines in one order over all files, in gzip whose bytes depend on nothing but the lines."""

import gzip
import io
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..tables import scratch

#: Lines of one file, which is one gzip member.
FILE_LINES = 100_000


def member(lines: list[str]) -> bytes:
    """Lines as one gzip member without a name or a time."""
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", fileobj=out, mtime=0, compresslevel=6) as f:
        f.write("".join(f"{x}\n" for x in lines).encode())
    return out.getvalue()


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class OrderedWriter(DataSourceArrowWriter):
    """A task writes each of its files under a name of its own attempt; only commit gives them their places, and abort takes them away."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path.removeprefix('file:')}")

    def write(self, iterator):
        import uuid

        store, top = self.store()
        store.create_dir(f"{top}/_staged", recursive=True)
        staged, now, held = [], None, []

        def put():
            if now is None:
                return
            name = f"{top}/_staged/{now}-{uuid.uuid4().hex}"
            with store.open_output_stream(name, compression=None) as f:
                f.write(member(held))
            staged.append((name, f"{top}/part-{now:06d}.jsonl.gz"))

        for batch in iterator:
            for block, line in zip(batch.column("block").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if block != now:
                    put()
                    now, held = block, []
                held.append(line)
        put()
        return Staged(staged)

    def commit(self, messages) -> None:
        store, top = self.store()
        for m in messages:
            for name, place in m.files if m is not None else ():
                store.move(name, place)
        store.create_dir(top, recursive=True)
        self.clear(store, top)

    def abort(self, messages) -> None:
        store, top = self.store()
        self.clear(store, top)

    def clear(self, store, top: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{top}/_staged").type != fs.FileType.NotFound:
            store.delete_dir(f"{top}/_staged")


class OrderedGzip(DataSource):
    """Rows (block, line), each block's rows in one task and in order. Option path: a folder that isn't there yet or is empty."""

    @classmethod
    def name(cls) -> str:
        return "ordered_gzip"

    def schema(self) -> str:
        return "block long, line string"

    def writer(self, schema, overwrite: bool) -> OrderedWriter:
        return OrderedWriter(dict(self.options))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds nth, from 0, in the order of the columns, the last of which is text: a range sort, and of each of its partitions how many rows the ones before it have (a row for each
    partition). Ranges are cut by the first characters of the text, as the driver gets a sample of what they are cut by."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "sorted")
    df.repartitionByRange(*order[:-1], F.substring(order[-1], 1, 64)).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, `_id` long").parquet(path)
    rows = rows.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn("nth", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def write_lines(df: DataFrame, line: str, order: list[str], path: str, file_lines: int = FILE_LINES) -> None:
    """Writes a column of lines in the order of columns, then of the lines themselves: file_lines to a file, files named in order. Null lines are left out; a line with a break is an error.

    Files and their bytes depend on the rows and file_lines alone, not on partitions or attempts. Driver and executors must be able to open the path with pyarrow.
    """
    df.sparkSession.dataSource.register(OrderedGzip)
    whole = F.when(F.contains(line, F.lit("\n")), F.raise_error(F.lit("a line holds a line break")).cast("string")).otherwise(F.col(line))
    rows = numbered(df.where(F.col(line).isNotNull()).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(order)], whole.alias("line")), [*(f"_k{i}" for i in range(len(order))), "line"])
    dealt = rows.select(F.floor(F.col("nth") / file_lines).cast("long").alias("block"), "nth", "line").repartition("block").sortWithinPartitions("block", "nth")
    dealt.select("block", "line").write.format("ordered_gzip").mode("append").save(path)


def file_hashes(spark, path: str) -> DataFrame:
    """(file, sha256, bytes) of a folder's files, by Spark's own reader."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl.gz").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
