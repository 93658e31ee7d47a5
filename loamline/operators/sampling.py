"""Samples, draws, splits and orders by rank. Every choice is the same in each run and for each partitioning."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rank import rank_hex, rank_mod
from .graph import kept


def lowest_ranked(rows: DataFrame, by: list[str], key: str, k: int, *salt) -> DataFrame:
    """The k rows of each group with the lowest rank of (key, *salt); adds rank and nth. Ties by key."""
    out = rows.withColumn("rank", rank_hex(F.col(key), *salt))
    return out.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("rank", key))).where(F.col("nth") <= k)


def numbered(rows: DataFrame, name: str, rank: Column, *ties, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the place, from 0, of every row (of each group `by`) in the order of a rank in hex and the ties.

    Ranks are uniform, so their first three digits deal rows to 4096 even parts: parts are counted, their counts summed up, and rows are
    numbered within their part. No task orders all rows.
    """
    base = rows.withColumns({"_rank": rank, "_part": F.substring(rank, 1, 3)})
    counts = base.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = counts.select(*by, "_part", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")).alias("_before"))  # at most 4096 rows a group
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_rank", *ties))
    return base.join(before if by else F.broadcast(before), [*by, "_part"]).withColumn(name, (F.col("_before") + inside - 1).cast("long")).drop("_rank", "_part", "_before")


def ordered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds the place, from 0, of every row in an order that has no ties. Ranges of the order are dealt to tasks and frozen, counted, and numbered within."""
    base = kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = base.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row for each task
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return base.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + inside - 1).cast("long")).drop("_part", "_before")


def latest(rows: DataFrame, order: list[str], n: int, name: str = "late") -> DataFrame:
    """Adds whether a row is among the n latest by order. Counts by day (or by the first column, if it isn't a time) say where the cut falls; only that day's rows
    are ordered."""
    first = F.to_date(order[0]) if dict(rows.dtypes)[order[0]].startswith("timestamp") else F.col(order[0])
    base = rows.withColumn("_day", first)
    counts = base.groupBy("_day").agg(F.count("*").alias("_n"))
    after = counts.withColumn("_after", F.sum("_n").over(Window.orderBy(F.desc("_day"))) - F.col("_n"))  # one row for each day
    cut = after.where((F.col("_after") < n) & (F.col("_after") + F.col("_n") > n)).select(F.col("_day").alias("_cut"), (F.lit(n) - F.col("_after")).alias("_left"))
    whole = after.select(F.col("_day").alias("_of"), (F.col("_after") + F.col("_n") <= n).alias("_whole"))
    tied = base.join(F.broadcast(cut), base["_day"].eqNullSafe(F.col("_cut")))
    tied = tied.withColumn(name, F.row_number().over(Window.partitionBy("_cut").orderBy(*[F.desc(c) for c in order])) <= F.col("_left"))
    rest = base.join(F.broadcast(cut), base["_day"].eqNullSafe(F.col("_cut")), "left_anti").join(whole, base["_day"].eqNullSafe(F.col("_of"))).withColumn(name, F.col("_whole"))
    return rest.select(*rows.columns, name).union(tied.select(*rows.columns, name))


def seeded_shuffle(rows: DataFrame, key: str, *salt) -> DataFrame:
    """Adds pos from 0 in the order of rank, ties by key."""
    return numbered(rows, "pos", rank_hex(F.col(key), *salt), key)


def stride_shards(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("shard", (F.col("pos") % n).cast("int"))


def weighted_draw(ids: DataFrame, key: str, pool: DataFrame, item: str, weight: str, slots: int, salt: str, banned: DataFrame | None = None, first: int | Column = 0) -> DataFrame:
    """`slots` items for each id, drawn by weight without replacement. pool is a small table with positive whole weights; banned (key, item): what an id may
    not get. Slots are numbered from `first`, which may be a column of ids. An id with fewer items left has fewer drawn.

    Slot s takes rank(id, salt, s) modulo the weight that is left, and walks the pool in the order of items; a slot's draw is moved past the
    items already taken, in ascending order of where they stand. An item's stretch of weights is cut at multiples of the mean weight, so that
    a draw finds it by an equi-join: there are at most twice as many cuts as items.
    """
    order = Window.orderBy(item)  # one row for each item
    walk = pool.select(F.col(item).alias("_item"), F.col(weight).cast("long").alias("_w"), F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long").alias("_end"))
    walk = kept(walk)
    total, n = walk.agg(F.coalesce(F.sum("_w"), F.lit(0)), F.count("*")).first()
    step = max(1, total // max(1, n))
    cell = lambda c: F.floor(c / step).cast("long")
    walk = walk.withColumn("_cell", F.explode(F.sequence(cell(F.col("_end") - F.col("_w")), cell(F.col("_end") - 1))))
    kind = dict(pool.dtypes)[item]
    none = F.array().cast(f"array<struct<start:bigint,w:bigint,item:{kind}>>")
    if banned is None:
        out = ids.withColumns({"_taken": none, "_banned": F.lit(0)})
    else:
        at = walk.select(F.col("_item").alias(item), F.struct((F.col("_end") - F.col("_w")).alias("start"), F.col("_w").alias("w"), F.col("_item").alias("item")).alias("_t"))
        not_ = banned.select(key, item).distinct().join(at.distinct(), item).groupBy(key).agg(F.collect_list("_t").alias("_taken"))
        out = ids.join(not_, key, "left").withColumn("_taken", F.coalesce("_taken", none)).withColumn("_banned", F.size("_taken"))
    for i in range(slots):
        s = first + i
        left = F.greatest(F.lit(1), F.lit(total) - F.aggregate("_taken", F.lit(0).cast("long"), lambda a, t: a + t["w"]))
        at = rank_mod(left.cast("decimal(20,0)"), F.col(key), salt, s)
        place = F.aggregate(F.array_sort("_taken"), at, lambda a, t: F.when(a >= t["start"], a + t["w"]).otherwise(a))
        out = out.withColumn("_place", place).withColumn("_cell", cell(F.col("_place")))
        here = (out["_cell"] == walk["_cell"]) & (F.col("_place") >= F.col("_end") - F.col("_w")) & (F.col("_place") < F.col("_end"))
        out = out.join(walk, here, "left").drop(walk["_cell"])
        won = F.array(F.struct((F.col("_end") - F.col("_w")).alias("start"), F.col("_w").alias("w"), F.col("_item").alias("item")))
        out = out.withColumn("_taken", F.when(F.col("_item").isNull(), F.col("_taken")).otherwise(F.concat("_taken", won))).drop("_item", "_w", "_end", "_place", "_cell")
    drawn = F.slice("_taken", F.col("_banned") + 1, F.lit(slots))
    return out.withColumn("drawn", F.transform(drawn, lambda t: t["item"])).drop("_taken", "_banned")


def stratified_fill(rows: DataFrame, key: str, strata: list[tuple[str, Column]], each: int, total: int, *salt) -> DataFrame:
    """Up to `each` rows of every stratum in turn, none twice, then the lowest ranks until `total`. Adds stratum (null for the fill).

    One pass finds the candidates: of each stratum the lowest ranks, as many as could be reached, and the lowest of all, at most
    len(strata) * len(strata) * each + total rows. The turns are taken on these.
    """
    most = len(strata) * each
    of = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(i)) for i, (_, c) in enumerate(strata)], F.lit(-1)), lambda x: x.isNotNull())
    ranked = rows.withColumn("rank", rank_hex(F.col(key), *salt)).withColumn("_of", F.explode(of))
    near = ranked.withColumn("_at", F.row_number().over(Window.partitionBy("_of").orderBy("rank", key))).where(F.col("_at") <= max(most, total))
    near = kept(near.drop("_at"))
    taken = None
    for i, (name, _) in enumerate(strata):
        pool = near.where(F.col("_of") == i)
        if taken is not None:
            pool = pool.join(taken.select(key), key, "left_anti")
        part = pool.orderBy("rank", key).limit(each).withColumn("stratum", F.lit(name))
        taken = part if taken is None else taken.unionByName(part)
    rest = near.where("_of = -1").join(taken.select(key), key, "left_anti").withColumn("stratum", F.lit(None).cast("string"))
    both = taken.unionByName(rest).withColumn("_fill", F.col("stratum").isNull())
    return both.orderBy("_fill", "rank", key).limit(total).drop("_fill", "_of")


def item_mask(rows: DataFrame, key: str, num: int, den: int, *salt, whole: bool = True) -> DataFrame:
    """Adds masked: the N * num / den lowest ranks. Refuses if that isn't whole, or with whole=False rounds it down."""
    n = rows.count()
    if whole and n * num % den:
        raise ValueError(f"{num}/{den} of {n} rows isn't a whole number")
    return numbered(rows, "_at", rank_hex(F.col(key), *salt), key).withColumn("masked", F.col("_at") < n * num // den).drop("_at")


def upsample(rows: DataFrame, key: str, size: Column, *salt) -> DataFrame:
    """Copies (from 0) so that there are `size` rows: each the same number, the lowest ranks one more."""
    n = rows.agg(F.count("*").alias("_n"))
    out = numbered(rows, "_at", rank_hex(F.col(key), *salt), key).crossJoin(F.broadcast(n)).withColumn("_size", size)
    copies = F.floor(F.col("_size") / F.col("_n")).cast("int") + (F.col("_at") < F.col("_size") % F.col("_n")).cast("int")
    return out.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>")))).drop("_n", "_at", "_size")


def run_order(rows: DataFrame, key: str, passes: int, n: int, *salt) -> DataFrame:
    """Rows in the order of several passes, each shuffled by its own rank, cut to n. Adds pass and pos."""
    every = rows.crossJoin(F.broadcast(rows.sparkSession.range(passes).select(F.col("id").cast("int").alias("pass"))))
    total = rows.agg(F.count("*").alias("_n"))
    parts = [numbered(every.where(F.col("pass") == p), "pos", rank_hex(F.col(key), *salt, F.lit(p)), key) for p in range(passes)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.crossJoin(F.broadcast(total)).withColumn("pos", F.col("pos") + F.col("pass") * F.col("_n")).drop("_n").where(F.col("pos") < n)


def ceil_share(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def temporal_holdout(rows: DataFrame, key: str, day: str, num: int, den: int, cluster: str | None = None) -> DataFrame:
    """Adds pool (test or nontest) and moved. The boundary is the day of the k-th latest row, k = ceil(n * num / den); all from that day
    on is test, so ties of a day stay together. A cluster on both sides goes to nontest as a whole. Refuses a test pool under k.

    The boundary comes from counts by day, never from a sort of all rows.
    """
    days = rows.groupBy(day).agg(F.count("*").alias("n"))
    total = days.agg(F.sum("n")).first()[0] or 0
    k = ceil_share(total, num, den)
    later = Window.orderBy(F.desc(day))  # one row for each day
    cut = days.withColumn("upto", F.sum("n").over(later)).where(F.col("upto") >= k).agg(F.max(day)).first()[0]
    out = rows.withColumn("_late", F.coalesce(F.col(day) >= F.lit(cut), F.lit(False)))
    if cluster:
        sides = out.groupBy(cluster).agg(F.bool_and("_late").alias("_whole"))
        out = out.join(sides, cluster)
    else:
        out = out.withColumn("_whole", F.col("_late"))
    out = out.withColumns({"pool": F.when(F.col("_late") & F.col("_whole"), "test").otherwise("nontest"), "moved": F.col("_late") & ~F.col("_whole")}).drop("_late", "_whole")
    if not cluster and total and out.where("pool = 'test'").count() < k:
        raise ValueError("fewer test rows than asked for")
    return out


def seeded_partition(rows: DataFrame, key: str, cluster: str, order: list[str], seeds: int, num: int, den: int, checkpoint: int) -> DataFrame:
    """For each seed: role dev or train, and whether a row is in the checkpoint sample.

    The late window is the latest w = 2 * ceil(n * num / den) rows; its clusters, by rank for the seed, are dev until dev has ceil(w / 2)
    rows, the cluster that crosses included; all else is train. The checkpoint sample is the lowest-ranked train rows.
    """
    n = rows.count()
    w = 2 * ceil_share(n, num, den)
    if w > n:
        raise ValueError("the window is larger than the pool")
    late = latest(rows, order, w)
    each = late.crossJoin(F.broadcast(rows.sparkSession.range(seeds).select(F.col("id").cast("int").alias("seed"))))
    sizes = each.where("late").groupBy("seed", cluster).agg(F.count("*").alias("_size"))
    before = Window.partitionBy("seed").orderBy(rank_hex(F.col(cluster), F.col("seed"), "dev"), F.col(cluster)).rowsBetween(Window.unboundedPreceding, -1)
    dev = sizes.withColumn("_dev", F.coalesce(F.sum("_size").over(before), F.lit(0)) < (w + 1) // 2).where("_dev").select("seed", cluster, F.lit(True).alias("_dev"))
    out = each.join(dev, ["seed", cluster], "left").withColumn("role", F.when(F.col("_dev"), "dev").otherwise("train"))
    at = F.row_number().over(Window.partitionBy("seed").orderBy(rank_hex(F.col(key), F.col("seed"), "checkpoint"), F.col(key)))
    lowest = out.where("role = 'train'").withColumn("_at", at).where(F.col("_at") <= checkpoint).select("seed", key, F.lit(True).alias("_in"))
    return out.join(lowest, ["seed", key], "left").withColumn("checkpoint", F.coalesce("_in", F.lit(False))).drop("_dev", "_in")


def selection(items: DataFrame, item: str, kind: str, config: str, seed: int, salts: dict[str, str], dropped: str | None = None, share: tuple[int, int] | None = None) -> DataFrame:
    """(item, copy, pos): the rows of one configuration and seed, as many as there are items, in a fixed shuffled order.

    `dropped` takes a kind away, `share` the lowest-ranked part of all items (it must be whole); what is left is brought back to the number of
    items by copies, the lowest ranks one more; rows are ordered by rank of (item, copy). salts: of mask, upsample and order.
    """
    n = items.count()
    kept_ = items
    if dropped is not None:
        kept_ = items.where(~F.col(kind).eqNullSafe(F.lit(dropped)))
    elif share is not None:
        kept_ = item_mask(items, item, *share, salts["mask"], f"{share[0]}/{share[1]}", seed).where("NOT masked").drop("masked")
    rows = upsample(kept_, item, F.lit(n), salts["upsample"], config, seed).select(item, "copy")
    return numbered(rows, "pos", rank_hex(F.col(item), F.col("copy"), salts["order"], config, F.lit(seed)), item, "copy")


def longest_first(rows: DataFrame, size: str, key: str) -> DataFrame:
    return rows.orderBy(F.desc(size), key)


def checkpoint_steps(steps: int, k: int) -> list[int]:
    """j * steps / k for j from 1 to k, halves up; the last is steps."""
    if steps < k:
        raise ValueError(f"{steps} steps can't hold {k} checkpoints")
    return [(2 * j * steps + k) // (2 * k) for j in range(1, k + 1)]


def checkpoint_rows(rows: DataFrame, steps: str, k: int) -> DataFrame:
    """The same of a column: a row for each checkpoint, with j and step."""
    out = rows.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return out.withColumn("step", F.floor((2 * F.col("j") * F.col(steps) + k) / (2 * k)).cast("long"))


def same_sets(members: DataFrame, group: str, key: str) -> DataFrame:
    """(a, b): groups with equal sets of keys. Sets are compared by count and sums of two hashes, so none is gathered."""
    h = lambda s: F.sum(F.xxhash64(F.lit(s), F.col(key)).cast("decimal(38,0)"))
    sets = members.select(group, key).distinct().groupBy(group).agg(F.count("*").alias("n"), h(1).alias("x"), h(2).alias("y"))
    a, b = sets.withColumnRenamed(group, "a"), sets.withColumnRenamed(group, "b")
    return a.join(b, ["n", "x", "y"]).where("a < b").select("a", "b")
