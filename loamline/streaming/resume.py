"""Result files that runners append to, read as a stream that a crash can't confuse: a data source whose offset is the byte after each file's last whole line."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that one task reads, and that a search for a line's end reads at once.
RANGE, LOOK = 64 << 20, 1 << 16
SCHEMA = "custom_id string, result_type string, path string, at long, line string"


def opened(path: str):
    """A file system and the path in it, of whatever store pyarrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def whole_lines(store, path: str, begin: int, size: int) -> int:
    """The byte after the last line break in begin .. size, or begin: what follows isn't whole yet."""
    with store.open_input_file(path) as f:
        at = size
        while at > begin:
            lo = max(begin, at - LOOK)
            found = f.read_at(at - lo, lo).rfind(b"\n")
            if found >= 0:
                return lo + found + 1
            at = lo
    return begin


def lines_in(store, path: str, lo: int, hi: int, begin: int, end: int):
    """(at, line) of the lines that start in lo .. hi, of a stretch begin .. end of whole lines. Another task has the line that lo falls into."""
    with store.open_input_file(path) as f:
        at = lo
        if lo > begin:  # the line that holds the byte before lo is another task's
            at = lo - 1
            while at < end:
                found = f.read_at(min(LOOK, end - at), at).find(b"\n")
                if found >= 0:
                    at += found + 1
                    break
                at += LOOK
        held, start = b"", at
        while start < hi and at < end:
            got = f.read_at(min(LOOK, end - at), at)
            at += len(got)
            *whole, held = (held + got).split(b"\n")
            for line in whole:
                if start >= hi:
                    return
                yield start, line
                start += len(line) + 1


class Range(InputPartition):
    def __init__(self, path: str, lo: int, hi: int, begin: int, end: int):
        self.path, self.lo, self.hi, self.begin, self.end = path, lo, hi, begin, end


class AppendedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.sha = options["path"], options["requestssha256"]
        self.range, self.suffix = int(options.get("rangebytes", RANGE)), options.get("suffix", ".jsonl")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Of each file of the folder the byte after its last whole line. No line is looked at twice: the search goes back from a file's end to the first break."""
        from pyarrow import fs

        store, top = opened(self.folder)
        files = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
        return {f.path: n for f in files if f.is_file and f.path.endswith(self.suffix) and (n := whole_lines(store, f.path, 0, f.size))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, hi in sorted(end.items()):
            lo = start.get(path, 0)
            out += [Range(path, a, min(hi, a + self.range), lo, hi) for a in range(lo, hi, self.range)]
        return out

    def read(self, partition: Range):
        """Rows of whole lines; a line that isn't JSON (a crash cut it, and another was appended) is none; a row of another requests file stops the stream."""
        store, _ = opened(self.folder)
        for at, line in lines_in(store, partition.path, partition.lo, partition.hi, partition.begin, partition.end):
            try:
                row = json.loads(line)
            except ValueError:
                continue
            if not isinstance(row, dict):
                continue
            if row.get("requests_sha256") != self.sha:
                raise ValueError(f"{partition.path} came from a different requests file")
            yield row.get("custom_id"), row.get("result_type"), partition.path, at, line.decode()


class AppendedResults(DataSource):
    """Options: path, a folder of files that only grow; requestsSha256, the hash that each row must carry; rangeBytes; suffix, which files are meant (.jsonl)."""

    @classmethod
    def name(cls) -> str:
        return "appended_results"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> AppendedReader:
        return AppendedReader({k.lower(): v for k, v in self.options.items()})


def appended(spark: SparkSession, folder: str, requests_sha: str, range_bytes: int = RANGE, suffix: str = ".jsonl") -> DataFrame:
    """A stream of (custom_id, result_type, path, at, line). Executors and driver must both be able to open the folder."""
    spark.dataSource.register(AppendedResults)
    return spark.readStream.format("appended_results").option("requestsSha256", requests_sha).option("rangeBytes", range_bytes).option("suffix", suffix).load(folder)


def collected(stream: DataFrame, results: str, checkpoint: str) -> None:
    """Takes in what has been appended until now, each batch in a folder of its own: one that is run again writes the same."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{results}/batch={batch_id}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def succeeded(spark: SparkSession, results: str) -> DataFrame:
    """Of each id its last success, by file and place: (custom_id, line)."""
    rows = spark.read.parquet(results).where("result_type = 'succeeded' AND custom_id IS NOT NULL")
    return rows.groupBy("custom_id").agg(F.max_by("line", F.struct("path", "at")).alias("line"))


def remaining(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Requests (custom_id) that have to be sent again: those without a success."""
    return requests.join(done.select("custom_id"), "custom_id", "left_anti")


def finished(spark: SparkSession, requests: DataFrame, results: str, path: str) -> bool:
    """Writes the final file if each request has a success, in the order of ids; else nothing. A request that comes twice or has no id is an error."""
    from ..sources.ordered import write_lines

    if not requests.groupBy("custom_id").count().where("count > 1 OR custom_id IS NULL").isEmpty():
        raise ValueError("a request has no id, or comes twice")
    done = succeeded(spark, results)
    if not remaining(requests, done).isEmpty():
        return False
    write_lines(done.join(requests.select("custom_id"), "custom_id", "left_semi"), "line", ["custom_id"], path)
    return True
