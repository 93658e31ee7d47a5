"""Reason-coded filtering: ordered checks, the fate of each row and of each entity, and a ledger that balances."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Checks = list[tuple[str, Column]]


def reasons(checks: Checks) -> Column:
    """Names of all failing checks, in order. A null condition doesn't fail."""
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]), lambda r: r.isNotNull())


def with_fate(rows: DataFrame, checks: Checks) -> DataFrame:
    """Adds failures (all failing checks), reason (the first, or null) and stage (its position from 1, or null)."""
    names = F.array(*[F.lit(n) for n, _ in checks])
    out = rows.withColumn("failures", reasons(checks)).withColumn("reason", F.try_element_at("failures", F.lit(1)))
    return out.withColumn("stage", F.when(F.col("reason").isNotNull(), F.array_position(names, F.col("reason")).cast("int")))


def stage_ledger(fated: DataFrame, entity: str, n_stages: int) -> DataFrame:
    """For each stage from 0 (before all): rows and entities that are left. An entity lives while any of its rows does."""
    spark = fated.sparkSession
    by_row = fated.groupBy(F.coalesce("stage", F.lit(n_stages + 1)).alias("died")).agg(F.count("*").alias("n_rows"))
    by_entity = fated.groupBy(entity).agg(F.max(F.coalesce("stage", F.lit(n_stages + 1))).alias("died")).groupBy("died").agg(F.count("*").alias("n_entities"))
    counts = by_row.join(by_entity, "died", "full_outer")
    stages = spark.range(n_stages + 1).select(F.col("id").cast("int").alias("stage"))
    left = F.broadcast(counts)  # at most a row for each stage
    return stages.join(left, left.died > stages.stage, "left").groupBy("stage").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows_left"), F.coalesce(F.sum("n_entities"), F.lit(0)).alias("entities_left"))


def entity_drops(fated: DataFrame, entity: str) -> DataFrame:
    """Of each entity without a surviving row: the stage where its last row went, the earliest reason among the rows that went there, all failures sorted."""
    last = fated.groupBy(entity).agg(F.max("stage").alias("stage"), F.bool_or(F.col("stage").isNull()).alias("alive"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("failures")))).alias("all_failures"), F.max(F.struct("stage", "reason")).alias("at")).where("NOT alive")
    return last.select(entity, "stage", F.col("at.reason").alias("reason"), "all_failures")


def filter_alone(rows: DataFrame, entity: str, checks: Checks) -> DataFrame:
    """What each check would drop if it alone were applied: rows, and entities all of whose rows fail it."""
    flags = [F.coalesce(cond, F.lit(False)).alias(f"c{i}") for i, (_, cond) in enumerate(checks)]
    flagged = rows.select(entity, *flags)
    per = flagged.groupBy(entity).agg(*[F.sum(F.col(f"c{i}").cast("long")).alias(f"r{i}") for i in range(len(checks))], *[F.bool_and(f"c{i}").cast("long").alias(f"e{i}") for i in range(len(checks))])
    sums = per.agg(*[F.coalesce(F.sum(f"{k}{i}"), F.lit(0)).alias(f"{k}{i}") for i in range(len(checks)) for k in "re"])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"r{i}").alias("rows_dropped"), F.col(f"e{i}").alias("entities_dropped")) for i, (name, _) in enumerate(checks)])))


def exceeds_fraction(count: Column, of: Column, num: int, den: int) -> Column:
    """count / of > num / den, in whole numbers; exactly the fraction doesn't exceed."""
    return count * den > of * num


def cap_sensitivity(rows: DataFrame, size: Column, entity: str, caps: list[int]) -> DataFrame:
    """Rows and entities that each cap would leave."""
    s = rows.select(size.alias("size"), entity).groupBy(entity).agg(*[F.sum((F.col("size") <= c).cast("long")).alias(f"n{c}") for c in caps])
    sums = s.agg(*[F.coalesce(F.sum(f"n{c}"), F.lit(0)).alias(f"n{c}") for c in caps], *[F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"e{c}") for c in caps])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("cap"), F.col(f"n{c}").alias("rows_left"), F.coalesce(F.col(f"e{c}"), F.lit(0)).alias("entities_left")) for c in caps])))


def one_per_entity(rows: DataFrame, entity: str, preferred: Column, rank: Column, tie: str) -> DataFrame:
    """One row of each entity and the rule that chose it: single, preferred (one such), preferred_rank (the lowest of several) or rank."""
    w = Window.partitionBy(entity)
    out = rows.withColumns({"_p": F.coalesce(preferred, F.lit(False)), "_r": rank})
    out = out.withColumns({"n_candidates": F.count("*").over(w), "_n": F.sum(F.col("_p").cast("long")).over(w), "_at": F.row_number().over(w.orderBy(F.desc("_p"), "_r", tie))})
    rule = F.when(F.col("n_candidates") == 1, "single").when(F.col("_n") == 1, "preferred").when(F.col("_n") > 1, "preferred_rank").otherwise("rank")
    return out.where("_at = 1").withColumn("rule", rule).drop("_p", "_r", "_n", "_at")


def latest_wins(rows: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """Of each key the row with the latest time; with equal times the one that is earlier in order."""
    w = Window.partitionBy(key).orderBy(F.desc(time), F.asc(order))
    return rows.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")
