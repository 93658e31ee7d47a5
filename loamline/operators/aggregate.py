"""Aggregations that are exact: nearest ranks, ordered modes, histograms, intervals, live groups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import scratch


def nearest_rank(rows: DataFrame, by: list[str], value: str, qs: list[tuple[int, int]]) -> DataFrame:
    """(by, q_num, q_den, value): the value at position max(1, ceil(q * n)), in whole numbers. By counts of distinct values, not by a sort of rows; without groups, in ranges of values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    counts = counts.withColumns({"_to": F.sum("_n").over(Window.partitionBy(*by).orderBy(value)), "_all": F.sum("_n").over(Window.partitionBy(*by))}) if by else summed_up(counts, value, "_n")
    counts = counts.withColumn("_from", F.col("_to") - F.col("_n"))
    asked = F.explode(F.array(*[F.struct(F.lit(a).alias("q_num"), F.lit(b).alias("q_den")) for a, b in qs]))
    at = F.greatest(F.lit(1), F.floor((F.col("q_num") * F.col("_all") + F.col("q_den") - 1) / F.col("q_den")))
    return counts.withColumn("_q", asked).select(*by, "_q.*", value, "_from", "_to", "_all").where((at > F.col("_from")) & (at <= F.col("_to"))).select(*by, "q_num", "q_den", value)


def summed_up(counts: DataFrame, value: str, n: str) -> DataFrame:
    """counts (value, n). Adds _to, the sum of n up to and with each value, and _all, of all. A range sort is written; each range is summed by its own task, and the sums
    before it come from one row for each range."""
    spark, path = counts.sparkSession, scratch(counts.sparkSession, "ranges")
    counts.select(value, n).orderBy(value).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    ranges = spark.read.parquet(path).withColumn("_part", F.shiftright("_id", 33))
    sums = ranges.groupBy("_part").agg(F.sum(n).alias("_own"))
    every = Window.orderBy("_part")
    before = sums.select("_part", (F.sum("_own").over(every) - F.col("_own")).alias("_before"), F.sum("_own").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    up_to = F.sum(n).over(Window.partitionBy("_part").orderBy("_id"))
    return ranges.join(F.broadcast(before), "_part").withColumn("_to", F.col("_before") + up_to).drop("_part", "_id", "_before")


def edge_histogram(rows: DataFrame, value: Column, edges: list[float], labels: list[str]) -> DataFrame:
    """(label, pos, count) with upper-inclusive edges; above the last edge counts with the last label; zero counts are kept."""
    place = F.lit(len(labels) - 1)
    for i in reversed(range(len(edges))):
        place = F.when(value <= edges[i], min(i, len(labels) - 1)).otherwise(place)
    counts = rows.where(value.isNotNull()).groupBy(place.alias("pos")).agg(F.count("*").alias("count"))
    names = rows.sparkSession.range(len(labels)).select(F.col("id").cast("int").alias("pos"), F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("id") + 1).cast("int")).alias("label"))
    return names.join(counts, "pos", "left").select("label", "pos", F.coalesce("count", F.lit(0)).alias("count"))


def ordered_mode(rows: DataFrame, by: list[str], value: str, domain: str) -> DataFrame:
    """(by, mode, votes): the most common value; ties go to the one that stands first in domain."""
    counts = rows.where(F.instr(F.lit(domain), F.col(value)) > 0).groupBy(*by, value).agg(F.count("*").alias("votes"))
    best = counts.groupBy(*by).agg(F.min(F.struct(-F.col("votes"), F.instr(F.lit(domain), F.col(value)), value)).alias("b"), F.max("votes").alias("votes"))
    return best.select(*by, F.col("b")[value].alias("mode"), "votes")


def number_of(label: Column) -> Column:
    """The number in a label such as CWE-79, for ties; null without one."""
    return F.try_element_at(F.regexp_extract_all(label, F.lit(r"\d+"), F.lit(0)), F.lit(1)).try_cast("bigint")


def most_frequent(rows: DataFrame, label: str, k: int) -> DataFrame:
    """The k most frequent labels by (-count, the label's number if it has one, label)."""
    return rows.groupBy(label).agg(F.count("*").alias("count")).orderBy(F.desc("count"), number_of(F.col(label).cast("string")).asc_nulls_last(), label).limit(k)


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson's interval; null without rows."""
    p = hits / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def two_groups(rows: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """Difference of means and its unpooled standard error."""
    of = lambda g, f: f(F.when(F.col(group) == F.lit(g), F.col(value)))
    a = rows.agg(of(first, F.avg).alias("m1"), of(second, F.avg).alias("m2"), of(first, F.var_samp).alias("v1"), of(second, F.var_samp).alias("v2"), of(first, F.count).alias("n1"), of(second, F.count).alias("n2"))
    return a.select((F.col("m1") - F.col("m2")).alias("difference"), F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")).alias("standard_error"), "n1", "n2")


def live_groups(rows: DataFrame, group: list[str], score: str) -> DataFrame:
    """A group lives if its scores aren't all equal."""
    return rows.groupBy(*group).agg((F.min(score) != F.max(score)).alias("live"), F.count("*").alias("n"))


def band(live: Column, n: Column) -> Column:
    """as_specified from a half on, dynamic_sampling from a tenth on, else floored, in whole numbers."""
    return F.when(live * 2 >= n, "as_specified").when(live * 10 >= n, "dynamic_sampling").otherwise("floored")


def cap_choice(cut: DataFrame, by: list[str], num: int = 1, den: int = 10) -> DataFrame:
    """cut (by, cap, n_cut, n): of each group the smallest cap with n_cut / n <= num / den, else the largest."""
    return cut.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("n_cut") * den <= F.col("n") * num, F.col("cap"))), F.max("cap")).alias("cap"))


def unit_scores(rows: DataFrame, by: list[str], right: str) -> DataFrame:
    """Both-right for units of several items: the least of their scores."""
    return rows.groupBy(*by).agg(F.min(F.col(right).cast("int")).alias("unit"), F.count("*").alias("items"))


def shortcut_share(rows: DataFrame, item: str, options: str, gold: str) -> DataFrame:
    """(ties, n, hits): of items by how many of their options are the most frequent over all items, whether the gold one is among them.

    The guessing score is sum(hits / ties) / sum(n); counts by ties keep it exact.
    """
    each = rows.select(item, gold, F.explode(options).alias("o"))
    freq = each.groupBy("o").agg(F.count("*").alias("f"))
    scored = each.join(freq, "o").groupBy(item, gold).agg(F.max("f").alias("top"), F.collect_list(F.struct("f", "o")).alias("os"))
    scored = scored.withColumn("best", F.transform(F.filter("os", lambda x: x["f"] == F.col("top")), lambda x: x["o"]))
    return scored.groupBy(F.size("best").alias("ties")).agg(F.count("*").alias("n"), F.sum(F.array_contains("best", F.col(gold)).cast("long")).alias("hits"))


def best_constant(labels: DataFrame, relation: DataFrame, credit: Column, k: int = 10) -> DataFrame:
    """labels (gold, n), relation (pred, gold, relation). The k answers with the highest mean credit over all labels: (pred, eighths, total).
    Ties go to the lower number of the answer, if it has one."""
    total = labels.agg(F.sum("n").alias("total"))
    sums = relation.join(labels, "gold").groupBy("pred").agg(F.sum(F.col("n") * credit).alias("eighths"))
    return sums.crossJoin(F.broadcast(total)).orderBy(F.desc("eighths"), number_of(F.col("pred").cast("string")).asc_nulls_last(), "pred").limit(k)


def decided_schedule(eighths: Column, total: Column, num: int = 1, den: int = 5) -> Column:
    """direction_aware if the best constant's mean symmetric credit is above num / den, else symmetric; in whole numbers."""
    return F.when(eighths * den > total * 8 * num, "direction_aware").otherwise("symmetric")


def agreement(rows: DataFrame, parts: str, reference: Column, names: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Of rows' maps against a reference map: (n, mean, var, low, high) of the share of agreeing components, and (component, hits, n, low, high) with
    Wilson's interval. The variance of one row is 0."""
    z = 1.959963984540054
    same = {k: F.coalesce((F.try_element_at(parts, F.lit(k)) == F.try_element_at(reference, F.lit(k))).cast("int"), F.lit(0)) for k in names}
    flat = rows.select(*[c.alias(k) for k, c in same.items()])
    share = sum(F.col(k) for k in names) / len(names)
    one = flat.select(share.alias("x")).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("var"))
    one = one.select("n", "mean", "var", (F.col("mean") - z * F.sqrt(F.col("var") / F.col("n"))).alias("low"), (F.col("mean") + z * F.sqrt(F.col("var") / F.col("n"))).alias("high"))
    hits = flat.agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in names]).select("n", F.inline(F.array(*[F.struct(F.lit(k).alias("component"), F.col(k).alias("hits")) for k in names])))
    low, high = wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    return one, hits.select("component", "hits", "n", low.alias("low"), high.alias("high"))


def snapshots(fated: DataFrame, entity: str, year: Column, stages: list[int]) -> DataFrame:
    """(stage, year, entities): entities that are left after each of some stages, by year. A row has died at stage `stage`, or null."""
    each = fated.select(F.col(entity).alias("_e"), year.alias("year"), F.col("stage").alias("_died"), F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"))
    alive = each.where(F.col("_died").isNull() | (F.col("_died") > F.col("stage")))
    return alive.groupBy("stage", "year").agg(F.count_distinct("_e").alias("entities"))
