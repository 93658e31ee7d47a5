"""Incremental results with Structured Streaming: resumed partial files, last success wins, and windows over steps."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reconcile import last_success


def arriving(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Result files as they appear; a torn line is read as a row of nulls, which is dropped."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.where(F.col(schema.fieldNames()[0]).isNotNull())


def resumed(arrivals: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each id once, the first time that it comes, within the watermark; the checkpoint holds what has been seen."""
    return arrivals.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def merge_last_success(target: str, key: str, order: str, ok: Column, parts: int = 256):
    """For foreachBatch: keeps a table with, of each id, the latest success, else the latest attempt; current() reads it.

    Ids are dealt by hash to `parts` folders. A batch reads and writes only the folders that its ids are in, each as a version named by the batch, so a
    batch that is run again writes the same, and costs what it touches, not the table. Of a folder the newest version counts, and the one before is kept for such a rerun.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        rows = batch.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        touched = [r["_part"] for r in rows.select("_part").distinct().collect()]  # `parts` at most
        before = {p: [v for v in versions(fs, path, f"{target}/part={p}") if v < batch_id] for p in touched}
        old = [f"{target}/part={p}/v={vs[-1]}" for p, vs in before.items() if vs]
        if old:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")))
        staged = f"{target}/_staged"
        fs.delete(path(staged), True)
        last_success(rows, key, order, ok).drop("succeeded").write.partitionBy("_part").parquet(staged)
        for p in touched:
            place = path(f"{target}/part={p}/v={batch_id}")
            fs.delete(place, True)
            fs.mkdirs(place.getParent())
            fs.rename(path(f"{staged}/_part={p}"), place)
            for v in before[p][:-1]:
                fs.delete(path(f"{target}/part={p}/v={v}"), True)

    return run


def versions(fs, path, folder: str) -> list[int]:
    """The batches that wrote a folder, ascending."""
    there = path(folder)
    return sorted(int(f.getPath().getName().removeprefix("v=")) for f in fs.listStatus(there)) if fs.exists(there) else []


def current(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The table of merge_last_success(): the newest version of each folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path(target))] if fs.exists(path(target)) else []
    newest = [f"{target}/{n}/v={v[-1]}" for n in names if n.startswith("part=") and (v := versions(fs, path, f"{target}/{n}"))]
    return spark.read.schema(schema).parquet(*newest) if newest else spark.createDataFrame([], schema)


def step_windows(rows: DataFrame, step: Column, size: int, by: list[str], reward: str, parsed: str) -> DataFrame:
    """Tumbling windows over steps: count, mean and population variance of rewards, parse rate, all from sums."""
    return rows.groupBy(F.floor((step - 1) / size).cast("int").alias("window"), *by).agg(F.count("*").alias("n"), F.avg(reward).alias("mean"), F.var_pop(reward).alias("variance"), F.avg(F.col(parsed).cast("int")).alias("parse_rate"))


def events(windows: DataFrame, live: str, n: str, rate: str) -> DataFrame:
    """below_floor where less than a tenth lives, collapse where one answer takes over nine tenths; null else."""
    return windows.withColumn("event", F.when(F.col(live) * 10 < F.col(n), "below_floor").when(F.greatest(F.col(rate), 1 - F.col(rate)) > 0.9, "collapse"))


def tumbling(stream: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Event-time windows with a watermark; the same over a batch table."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if stream.isStreaming else rows
    return rows.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
