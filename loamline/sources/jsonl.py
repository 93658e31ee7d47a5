"""JSON Lines with explicit schemas, paired rows, canonical text and manifests."""

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import kept


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line, gzip or not; a line that isn't one is an error, and so is a field of another type."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_pairs(spark: SparkSession, path: str, schema: T.StructType, key: Column) -> DataFrame:
    """Files in which the rows that aren't blank form pairs, the first with the second and so on: (file, pair, first_line, second_line, first, second), structs of
    the schema and the lines' numbers from 1.

    Lines are read in splits like any text; a split's rows are numbered in order of where they stand in the file, by counts of the splits before. An odd count, an
    unknown or missing field, or a pair key (a column over first and second) that comes twice is an error.
    """
    names = set(schema.fieldNames())
    text = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    text = kept(text)  # a row's place within its split is frozen before rows are counted
    blank = F.trim("value") == ""
    counts = text.groupBy("file", "_block").agg(F.count("*").alias("_lines"), F.sum((~blank).cast("long")).alias("_rows"))
    upto = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    before = counts.select("file", "_block", F.coalesce(F.sum("_lines").over(upto), F.lit(0)).alias("_l"), F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_r"))
    inside = Window.partitionBy("file", "_block").orderBy("_at")
    rows = text.withColumns({"_n": F.row_number().over(inside), "_k": F.sum((~blank).cast("long")).over(inside)}).where(~blank).join(before, ["file", "_block"])
    found = kept(rows.select("file", (F.col("_l") + F.col("_n")).alias("line"), (F.col("_r") + F.col("_k") - 1).alias("pos"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"), F.json_object_keys("value").alias("fields")))
    wrong = found.where((F.size(F.array_except("fields", F.array(*[F.lit(x) for x in sorted(names)]))) > 0) | (F.size("fields") != len(names)))
    if not wrong.isEmpty():
        raise ValueError("fields that aren't the schema's")
    side = lambda i, c: F.max(F.when(F.col("pos") % 2 == i, F.col(c)))
    pairs = found.groupBy("file", F.floor(F.col("pos") / 2).alias("pair")).agg(side(0, "line").alias("first_line"), side(1, "line").alias("second_line"), side(0, "row").alias("first"), side(1, "row").alias("second"))
    if not pairs.where("second_line IS NULL").isEmpty():
        raise ValueError("an odd number of rows")
    if not pairs.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("a pair comes twice")
    return pairs


def canonical(df: DataFrame) -> DataFrame:
    """(line): each row as JSON with its fields in alphabetical order, nulls written."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line"))


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows in order over all part files, fields in alphabetical order, gzip."""
    df.select(*order, F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("_line")).orderBy(*order).select(F.col("_line").alias("value")).write.option("compression", "gzip").text(path)


def content_hash(df: DataFrame) -> str:
    """One hash of the rows as a multiset: SHA-256 over sums of row hashes, whatever their order and files."""
    h = F.sha2(F.col("line").cast("binary"), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    r = canonical(df).agg(F.count("*").alias("n"), *[part(i).alias(f"s{i}") for i in range(4)]).first()
    import hashlib

    return hashlib.sha256(json.dumps([str(x) for x in r]).encode()).hexdigest()


def frozen(df: DataFrame, manifest: dict[str, str], name: str) -> dict[str, str]:
    """The manifest with the table's hash; a hash that is there and differs is refused."""
    h = content_hash(df)
    if manifest.get(name, h) != h:
        raise ValueError(f"{name} is frozen and has changed")
    return manifest | {name: h}


def checked_table(df: DataFrame, manifest: dict[str, str], name: str, upstream: dict[str, DataFrame]) -> DataFrame:
    """A table that may be used: its own and its upstream tables' hashes are those of the manifest; a hash that differs or is missing is refused."""
    for n, table in {name: df, **upstream}.items():
        if manifest.get(n) != content_hash(table):
            raise ValueError(f"{n} isn't what the manifest says")
    return df


def manifest_of(tables: dict[str, DataFrame], versions: dict[str, str], now: str | None = None) -> dict:
    """Hashes and sizes of tables and versions of what made them; only `now`, a time, differs between equal runs."""
    return {"tables": {n: {"sha256": content_hash(t), "rows": t.count()} for n, t in sorted(tables.items())}, "versions": dict(sorted(versions.items()))} | ({"time": now} if now else {})


def layout(base: str, dry: bool = False, names: tuple[str, ...] = ("facts", "drops", "census", "split", "partition", "bank", "manifest")) -> dict[str, str]:
    """One folder gives all paths; a dry run's stand beside the real ones, never in their place."""
    top = f"{base.rstrip('/')}/{'dry/' if dry else ''}"
    return {n: f"{top}{n}" for n in names}


def json_document(rows: dict) -> str:
    return json.dumps(rows, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def markdown_table(head: list[str], rows: list[tuple]) -> str:
    """A pipe table of collected rows."""
    return "\n".join("| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in [head, ["---"] * len(head), *rows]) + "\n"


def write_csv(df: DataFrame, path: str, blank: list[str]) -> None:
    """CSV with a header and empty columns to fill in."""
    df.select("*", *[F.lit("").alias(c) for c in blank]).write.option("header", "true").option("lineSep", "\n").csv(path)
