"""Freezes that say where two versions of a table differ: a tree of hashes over ranges of keys, compared from the top."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of a key's hash that name its leaf: 16 ** DEPTH leaves; children of a node.
DEPTH, FANOUT = 5, 16
#: Nodes of one level that a comparison follows one by one; where more differ, all of a level's are joined.
FOLLOWED = 4096


def leaf_of(key: Column, depth: int) -> Column:
    """The leaf of a key, a null one too: the first hex digits of its SHA-256."""
    return F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("\x00")).cast("binary"), 256), 1, depth)


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of a row's JSON, fields in alphabetical order, nulls written."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def folded(hashes: Column) -> list[Column]:
    """A multiset of hashes as sums of their parts, which can be added up further."""
    part = lambda i: F.sum(F.conv(F.substring(hashes, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    return [part(i).alias(f"s{i}") for i in range(4)]


SUMS = [f"s{i}" for i in range(4)]


def hash_tree(df: DataFrame, key: str, depth: int = DEPTH) -> DataFrame:
    """(level, node, n, s0..s3): every node that has rows, from the root (level 0, an empty name) to the leaves. Rows are read once; a level is summed from the one below."""
    level = df.select(leaf_of(F.col(key), depth).alias("node"), row_hash(df).alias("_h")).groupBy("node").agg(F.count("*").alias("n"), *folded(F.col("_h")))
    levels = [level.withColumn("level", F.lit(depth))]
    for i in reversed(range(depth)):
        level = level.groupBy(F.substring("node", 1, i).alias("node")).agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in SUMS])
        levels.append(level.withColumn("level", F.lit(i)))
    return reduce(DataFrame.union, [x.select("level", "node", "n", *SUMS) for x in levels])


def freeze(df: DataFrame, key: str, path: str, depth: int = DEPTH) -> None:
    """Writes a version: its rows in the order of leaves, so that a leaf's rows are in one place that a reader's statistics lead to, and its tree, by level."""
    rows = df.withColumn("_leaf", leaf_of(F.col(key), depth))
    rows.repartitionByRange("_leaf").sortWithinPartitions("_leaf").write.parquet(f"{path}/rows")
    hash_tree(df, key, depth).sortWithinPartitions("node").write.partitionBy("level").parquet(f"{path}/tree")


def differing_nodes(spark: SparkSession, a: str, b: str, depth: int = DEPTH) -> tuple[list[str] | None, list[int]]:
    """Leaves in which two versions differ, followed from the root through differing nodes only, and how many nodes each level read. None: too many to follow."""
    tree = lambda path: spark.read.schema(f"node string, n long, {', '.join(f'{s} decimal(38,0)' for s in SUMS)}, level int").parquet(f"{path}/tree")
    nodes, read = [""], []
    for i in range(depth + 1):
        side = lambda path: tree(path).where((F.col("level") == i) & (F.lit(i == 0) | F.substring("node", 1, max(i - 1, 0)).isin(nodes)))  # noqa: B023, E731
        both = side(a).alias("x").join(side(b).alias("y"), F.col("x.node") == F.col("y.node"), "full_outer")
        same = reduce(lambda p, q: p & q, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("n", *SUMS)])
        got = both.select(F.coalesce("x.node", "y.node").alias("node"), (~same).alias("differs")).where("differs").limit(FOLLOWED + 1).collect()
        nodes = sorted(r.node for r in got)
        read.append(len(nodes))
        if not nodes:
            return [], read
        if len(nodes) > FOLLOWED:
            return None, read
    return nodes, read


def changed_rows(spark: SparkSession, a: str, b: str, key: str, depth: int = DEPTH) -> DataFrame:
    """(key, change): keys that version b has and a lacks (added), that it lacks (removed), and whose rows differ (changed), told from the rows of differing leaves only."""
    leaves, _ = differing_nodes(spark, a, b, depth)
    schema = spark.read.parquet(f"{a}/rows").schema
    rows = lambda path: spark.read.schema(schema).parquet(f"{path}/rows")
    some = lambda path: rows(path) if leaves is None else rows(path).where(F.col("_leaf").isin(leaves)) if leaves else rows(path).where("false")
    sums = lambda path: (t := some(path).drop("_leaf")).select(key, row_hash(t).alias("_h")).groupBy(key).agg(*folded(F.col("_h")))
    x, y = sums(a).alias("x"), sums(b).alias("y")
    same = reduce(lambda p, q: p & q, [F.col(f"x.{s}").eqNullSafe(F.col(f"y.{s}")) for s in SUMS])
    change = F.when(F.col("x.s0").isNull(), "added").when(F.col("y.s0").isNull(), "removed").when(~same, "changed")
    out = x.join(y, F.col(f"x.{key}").eqNullSafe(F.col(f"y.{key}")), "full_outer").select(F.coalesce(f"x.{key}", f"y.{key}").alias(key), change.alias("change"))
    return out.where("change IS NOT NULL")


def same_version(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two versions have equal rows, repeats counted: their roots alone."""
    roots = [spark.read.parquet(f"{p}/tree").where("level = 0").select("n", *SUMS).collect() for p in (a, b)]
    return roots[0] == roots[1]
