"""Analytics around training runs: label resolution, near misses, usage, divergence, selection of runs."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rank import rank_hex
from ..tables import spread


# Labels that stand for none.
PLACEHOLDERS = ("NVD-CWE-noinfo", "NVD-CWE-Other")


def resolve_labels(rows: DataFrame, key: str, values: str, mapping: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, label, reason, mapped_from): the one label that an array of values resolves to, reason ok, or the first reason against it.

    In order: no_nvd_cwe (a null array), placeholder_only, then of the values in order the first that is malformed_cwe or, mapped to null,
    deprecated_no_replacement; after mapping multi_cwe, category, view, not_in_view_1000. mapped_from: the old labels that were mapped, by number, or the
    one without a replacement. mapping (old, new) and nodes (id, is_category, is_view, in_view) may be of any size.
    """
    each = rows.select(key, F.col(values).isNull().alias("none"), F.explode_outer(F.array_sort(F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: ~v.isin(*PLACEHOLDERS))))).alias("v"))
    mapped = each.join(mapping.select(F.col("old").alias("v"), F.lit(True).alias("_old"), "new"), "v", "left")
    wrong = F.when(~F.col("v").rlike(r"\ACWE-[0-9]+\z"), "malformed_cwe").when(F.col("_old") & F.col("new").isNull(), "deprecated_no_replacement")
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
    mapped = mapped.select(key, "none", "v", wrong.alias("wrong"), F.when(F.col("_old"), F.col("new")).otherwise(F.col("v")).alias("to"), F.when(F.col("_old"), F.struct(number(F.col("v")).alias("k"), F.col("v").alias("v"))).alias("from"))
    one = mapped.groupBy(key).agg(F.max("none").alias("none"), F.count("v").alias("n"), F.min(F.when(F.col("wrong").isNotNull(), F.struct("v", "wrong"))).alias("wrong"), F.array_sort(F.collect_set("to")).alias("to"), F.transform(F.array_sort(F.collect_set("from")), lambda x: x["v"]).alias("from"))
    one = one.withColumn("id", F.when((F.size("to") == 1) & F.col("wrong").isNull(), F.try_element_at("to", F.lit(1))))
    one = one.join(nodes.select("id", "is_category", "is_view", "in_view"), "id", "left")
    why = F.col("wrong.wrong")
    reason = (
        F.when(F.col("none"), "no_nvd_cwe").when(F.col("n") == 0, "placeholder_only").when(why.isNotNull(), why).when(F.size("to") > 1, "multi_cwe")
        .when(F.coalesce("is_category", F.lit(False)), "category").when(F.coalesce("is_view", F.lit(False)), "view").when(~F.coalesce("in_view", F.lit(False)), "not_in_view_1000").otherwise("ok")
    )
    old = F.when(why == "malformed_cwe", F.array().cast("array<string>")).when(why.isNotNull(), F.array("wrong.v")).otherwise(F.col("from"))
    return one.select(key, F.when(reason == "ok", F.col("id")).alias("label"), reason.alias("reason"), old.alias("mapped_from"))


def near_misses(golds: DataFrame, key: str, gold: str, neighbours: DataFrame, salt: str, block: int = 256, at_once: int = 1 << 14) -> DataFrame:
    """(key, miss): of each gold's neighbours (node, other) the one with the lowest rank for the row.

    Every rank must be looked at, so the work grows with rows times neighbours. A node's neighbours are dealt to blocks by hash, and so are its rows; a task takes a block of each and
    gives of each row the least, so about block * at_once pairs are looked at where they stand and none is moved.
    """
    parts = lambda df, of, size: df.groupBy(of).agg(F.ceil(F.count("*") / size).alias("_n")).withColumnRenamed(of, "_g")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    n = parts(neighbours, "node", block).join(parts(golds, gold, at_once).withColumnRenamed("_n", "_m"), "_g")
    at = ["_g", "_b", "_r"]
    rows = golds.select(F.col(gold).alias("_g"), F.col(key).alias("_key"), F.col(key).cast("string").alias("_k")).join(n, "_g").select("_g", every("_n").alias("_b"), F.pmod(F.xxhash64("_k"), "_m").alias("_r"), "_key", "_k")
    dealt = neighbours.select(F.col("node").alias("_g"), "other", F.col("other").cast("string").alias("_o")).join(n, "_g").select("_g", F.pmod(F.xxhash64("_o"), "_n").alias("_b"), every("_m").alias("_r"), "other", "_o")
    end = f"\x1f{salt}".encode()

    def least(left: pa.Table, right: pa.Table) -> pa.Table:
        from hashlib import sha256

        right = right.sort_by([("_o", "ascending")])  # of equal ranks the least
        tails = [(b"" if o is None else b"\x1f" + o.encode()) + end for o in right.column("_o").to_pylist()]
        ranks, places = [], []
        for k in left.column("_k").to_pylist():
            if k is None:
                found = [sha256(t[1:]).digest()[:8] for t in tails]
            else:
                head = k.encode()
                found = [sha256(head + t).digest()[:8] for t in tails]
            ranks.append(min(found, default=None))
            places.append(found.index(ranks[-1]) if found else None)
        return pa.table({"_key": left.column("_key"), "_rank": pa.array(ranks, pa.binary()), "_miss": right.column("other").take(pa.array(places, pa.int64()))})

    kinds = dict(rows.dtypes) | dict(dealt.dtypes)
    found = spread(rows, *at).groupBy(*at).cogroup(spread(dealt, *at).groupBy(*at)).applyInArrow(least, f"_key {kinds['_key']}, _rank binary, _miss {kinds['other']}")
    one = found.where("_rank IS NOT NULL").groupBy("_key").agg(F.min(F.struct("_rank", "_miss"))["_miss"].alias("miss"))
    return one.select(F.col("_key").alias(key), "miss")


def line_near_miss(gold: Column, proposed: Column, code_lines: Column) -> Column:
    """Whether a proposal changes exactly one of the gold lines: into a code line at least 2 away from all gold lines, or drops or adds such a one."""
    gone, come = F.array_except(gold, proposed), F.array_except(proposed, gold)
    far = F.forall(come, lambda c: F.array_contains(code_lines, c) & F.forall(gold, lambda g: F.abs(g - c) >= 2))
    one = (F.size(gone) <= 1) & (F.size(come) <= 1) & (F.size(gone) + F.size(come) >= 1)
    return one & far & (F.size(proposed) > 0)


def usage_totals(rows: DataFrame, usage: str, prices: dict[str, float]) -> DataFrame:
    """(kind, tokens, cost): sums of a map of counts, and their cost by price per million."""
    sums = rows.select(F.explode(usage).alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("tokens"))
    price = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in prices.items() for x in kv]), F.col("kind")), F.lit(0.0))
    return sums.withColumn("cost", F.col("tokens") * price / 1e6)


def divergence(a: Column, b: Column) -> Column:
    """Of two token arrays: equal, and the index of the first difference, in buckets."""
    at = F.array_position(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: ~p["x"].eqNullSafe(p["y"])), True)
    return F.when(at == 0, "equal").when(at <= 1, "first").when(at <= 8, "2-8").when(at <= 64, "9-64").otherwise("later")


def best_run(rows: DataFrame, by: list[str], run: str, order: str, value: str) -> DataFrame:
    """The run with the highest value; of equal ones the first in order."""
    return rows.groupBy(*by).agg(F.max_by(run, F.struct(F.col(value), -F.col(order))).alias(run), F.max(value).alias(value))


def grid_todo(spark, axes: dict[str, list], done: DataFrame) -> DataFrame:
    """The grid of all specifications without those that are done."""
    out = None
    for name, values in axes.items():
        axis = spark.createDataFrame([(v,) for v in values], [name])
        out = axis if out is None else out.crossJoin(axis)
    return out.join(done, list(axes), "left_anti")


def type_scale(rows: DataFrame, kind: str, evaluation: str, unit: str) -> DataFrame:
    """(kind, scale): root of the mean over evaluations of the units' variances."""
    return rows.groupBy(kind, evaluation).agg(F.var_samp(unit).alias("v")).groupBy(kind).agg(F.sqrt(F.avg("v")).alias("scale"))


def paired_differences(rows: DataFrame, key: str, side: str, first, second, value: str) -> DataFrame:
    """(key, difference) of keys that have both sides."""
    of = lambda s: F.max(F.when(F.col(side) == F.lit(s), F.col(value)))
    return rows.groupBy(key).agg(of(first).alias("x"), of(second).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").select(key, (F.col("x") - F.col("y")).alias("difference"))


def recalled(rows: DataFrame, key: str, answer: str, gold: str) -> DataFrame:
    """Rows that are exactly right with an answer that isn't the most common one; a tie goes to the least."""
    modal = rows.where(F.col(answer).isNotNull()).groupBy(answer).agg(F.count("*").alias("n")).agg(F.min_by(answer, F.struct(-F.col("n"), F.col(answer))).alias("modal"))
    return rows.crossJoin(F.broadcast(modal)).where((F.col(answer) == F.col(gold)) & (F.col(answer) != F.col("modal"))).select(key, answer)


def mask_overlap(masks: DataFrame, seed: str, key: str) -> DataFrame:
    """(a, b, shared, total) for each two seeds."""
    sets = masks.groupBy(key).agg(F.collect_set(seed).alias("s"))
    n = masks.groupBy(seed).agg(F.count_distinct(key).alias("n"))
    both = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return both.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").select("a", "b", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("total"))


def group_rewards(rows: DataFrame, item: str, pos: str, n: int, reward: str) -> DataFrame:
    """(grp, item, tied): consecutive groups of n rows by pos; a group with several items is refused; tied if all rewards are equal."""
    out = rows.groupBy(F.floor(F.col(pos) / n).alias("grp")).agg(F.min(item).alias("lo"), F.max(item).alias("hi"), (F.min(reward) == F.max(reward)).alias("tied"))
    return out.select("grp", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(F.lit("a group holds several items")).cast(dict(rows.dtypes)[item])).alias("item"), "tied")


def training_stats(rows: DataFrame, by: list[str], item: str, tokens: str) -> DataFrame:
    """Rows, distinct items, duplicates, and the sum, low median and maximum of tokens."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(item).alias("items"), (F.count("*") - F.count_distinct(item)).alias("duplicates"), F.sum(tokens).alias("tokens"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {tokens})").alias("median"), F.max(tokens).alias("longest"))


def first_k(rows: DataFrame, by: list[str], item: str, order: str, k: int) -> DataFrame:
    """The first k distinct items of each group in order."""
    first = rows.groupBy(*by, item).agg(F.min(order).alias(order))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(order, item))).where(F.col("nth") <= k)


def replacements(requests: DataFrame, kind: str, pos: str, queue: DataFrame, item: str, order: str) -> DataFrame:
    """Each request's replacement: the k-th request of a type gets the k-th distinct item of its queue, which starts again at its end. Adds the item and used, how often it has been given so far."""
    first = queue.groupBy(kind, item).agg(F.min(order).alias("_o"))
    line = first.select(kind, item, (F.row_number().over(Window.partitionBy(kind).orderBy("_o", item)) - 1).alias("_i"), F.count("*").over(Window.partitionBy(kind)).alias("_n"))
    asked = requests.withColumn("_k", F.row_number().over(Window.partitionBy(kind).orderBy(pos)) - 1)
    size = line.select(kind, "_n").distinct()
    asked = asked.join(size, kind).withColumns({"_i": (F.col("_k") % F.col("_n")).cast("int"), "used": F.floor(F.col("_k") / F.col("_n")) + 1})
    return asked.join(line.drop("_n"), [kind, "_i"]).drop("_k", "_n", "_i")


def sync_verdict(gap_current: Column, gap_start: Column, drift: Column, least_drift: float, ratio: float) -> Column:
    """early until the weights have moved by more than least_drift; then ok if replies are nearer the current weights by the ratio, else stale."""
    return F.when(drift <= least_drift, "early").when(gap_current < ratio * gap_start, "ok").otherwise("stale")


def mean_absolute_gap(a: Column, b: Column) -> Column:
    """Of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
