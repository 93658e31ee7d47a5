"""Sessions and the driver's tables."""

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "loamline", master: str | None = None) -> SparkSession:
    """A session with the settings that the operators expect: UTC, ANSI, adaptive plans."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    return (b.master(master) if master else b).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """The rows dealt by hash to as many tasks as a shuffle has, for work that is large for their bytes: a small file is read by few tasks, and adaptive plans join small parts."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the one that spark.checkpoint.dir names; where that is unset and Spark runs in one process, a temporary one."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/loamline-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"
