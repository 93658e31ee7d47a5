"""Folders that the driver and all executors share, and tables written there to cut lineage."""

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that one Arrow batch may hold, so that very long texts keep a Python worker small.
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, with the scheme and host that Spark understands by it; a temporary one where that is unset and Spark runs in one
    process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base.rstrip("/"))
        full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
        return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = f"file://{tempfile.gettempdir()}/loamline-{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loamline/{name}-{uuid.uuid4().hex}"


#: Where written() notes its tables, for who will delete them; None: nobody does. Each thread of work has its own.
_noted: ContextVar[list[DataFrame] | None] = ContextVar("noted", default=None)


@contextmanager
def noting(tables: list[DataFrame]):
    """Notes the tables that written() makes meanwhile."""
    before = _noted.set(tables)
    try:
        yield
    finally:
        _noted.reset(before)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, lineage cut, safe against lost executors. compression: Spark's own where None."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.loamline_path = path
    tables = _noted.get()
    if tables is not None:
        tables.append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by written() that nothing will read any more."""
    spark, path = df.sparkSession, df.loamline_path
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it (in whatever case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fraction(*columns: str, seed: int) -> "F.Column":
    """A number in [0, 1) from the columns' values: the same in each run."""
    return (F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))

