"""Mixing sources to target weights, in DataFrame operations only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free, written

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the key by which a source's sizes are summed: PARTS parts, of which only one is sorted.
DIGITS = 4
PARTS = 16**DIGITS


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def mix_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float, rounds: int = 0) -> DataFrame:
    """sizes: (source, source_size, nth), nth from 0 in the order of sources. Adds target.

    The budget, share of all sizes, is divided by weight; a source stops at `most` times its size and what is over is divided among
    the others by weight, until none is above. The stopped sources are those with the least size for their weight, so the division
    is found in one pass over sources in that order: with the first k stopped, the rest get (budget - their stops) / (their weight)
    for each unit of weight, and the first k for which the next source isn't above that is the answer.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), "nth")  # one row for each source
    s = s.withColumn("stopped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("budget", F.sum("source_size").over(whole) * share)
    s = s.withColumn("unit", (F.col("budget") - F.col("stopped")) / F.col("left"))
    s = s.withColumn("unit", F.min(F.when(F.col("unit") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("nth"), F.col("unit")))).over(whole)["unit"])
    return s.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("unit") * F.col("w")), F.col("cap")).cast("double")).drop("w", "cap", "stopped", "left", "budget", "unit")


def mix_key(identity: Column, seed: str = "mix") -> Column:
    """A row's hash-random key."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(identity, F.lit(""))))


def mix_cuts(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """rows (source, size, key). One row for each source: where its mix ends.

    (source, source_size, target, epochs, cut_key, cut_size, whole, part, ties): every row is taken `epochs` times; rows before (cut_key,
    cut_size) in the order of key and size once more; of the `ties` rows at the cut, `whole` once more and the next one for `part` units.

    Sizes are summed by source and by the first digits of the key, PARTS parts of a source; prefix sums of these say in which part a source's units
    reach its target. Only that part's rows are sorted, by key and size, and summed up; equal ones as one. rows are scanned three times.
    """
    rows = rows.withColumn("at", F.substring("key", 1, DIGITS))
    parts = rows.groupBy("source", "at").agg(F.sum("size").alias("units"))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)  # one row for each source
    goals = mix_targets(sources, weights, share, most).drop("nth")
    goal = F.round("target").cast("long")
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
    goals = written(goals.withColumn("rest", goal - F.col("epochs") * F.col("source_size")), "mix-goals")
    by = goals.select(F.col("source").alias("of"), "rest").where("rest > 0")
    up_to = Window.partitionBy("source").orderBy("at")  # at most PARTS rows each
    parts = parts.withColumn("before", F.sum("units").over(up_to) - F.col("units")).join(by, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    parts = parts.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("units") >= F.col("rest")))
    parts = parts.select(F.col("source").alias("of"), F.col("at").alias("in_part"), "before", "rest")
    near = rows.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("at") == F.col("in_part"))).groupBy("source", "key", "size", "before", "rest").agg(F.count("*").alias("ties"))
    units = F.col("size") * F.col("ties")
    near = near.withColumn("start", F.col("before") + F.sum(units).over(Window.partitionBy("source").orderBy("key", "size")) - units)
    cut = near.where((F.col("start") < F.col("rest")) & (F.col("start") + units >= F.col("rest")))
    left = F.col("rest") - F.col("start")
    cut = cut.select(F.col("source").alias("of"), F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.floor(left / F.col("size")).cast("long").alias("whole"), (left % F.col("size")).alias("part"), "ties")
    out = goals.drop("rest").join(cut, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    return written(out.withColumns({"cut_key": F.coalesce("cut_key", F.lit("")), "cut_size": F.coalesce("cut_size", F.lit(-1)), "whole": F.coalesce("whole", F.lit(0)), "part": F.coalesce("part", F.lit(0)), "ties": F.coalesce("ties", F.lit(0))}), "mix-cuts")


def taken(rows: DataFrame, cuts: DataFrame, source: Column, size: Column, key: Column, name: str = "taken") -> DataFrame:
    """Adds to rows how many units of each row the mix takes, repeats counted, and returns the columns of cuts as well, their names before `name` and a dot
    made free of the rows' own: see names_of(). Rows stay where they are, but for those that are equal at a cut."""
    c, (own_size, own_key, place) = names_of(rows, name), free(rows.columns, "mix_size", "mix_key", "mix_place")
    told = cuts.select(*[F.col(k).alias(v) for k, v in c.items() if k in cuts.columns])
    out = rows.withColumns({own_size: size, own_key: key, c["of"]: source})
    out = out.join(told, F.col(c["of"]).eqNullSafe(F.col(c["source"]))).drop(c["of"], c["source"])
    at = (F.col(own_key) == F.col(c["cut_key"])) & (F.col(own_size) == F.col(c["cut_size"]))
    if not cuts.where("ties > 1").isEmpty():  # equal rows at a cut are told apart by a number
        tie = F.row_number().over(Window.partitionBy(c["cut_key"], own_size).orderBy(F.lit(1)))
        out = out.where(~at).withColumn(place, F.lit(1)).unionByName(out.where(at).withColumn(place, tie))
    else:
        out = out.withColumn(place, F.lit(1))
    before = (F.col(own_key) < F.col(c["cut_key"])) | ((F.col(own_key) == F.col(c["cut_key"])) & (F.col(own_size) < F.col(c["cut_size"])))
    more = F.when(before, F.col(own_size)).when(~at, 0).when(F.col(place) <= F.col(c["whole"]), F.col(own_size)).when(F.col(place) == F.col(c["whole"]) + 1, F.col(c["part"])).otherwise(0)
    return out.withColumn(c["taken"], (F.col(c["epochs"]) * F.col(own_size) + more).cast("long")).withColumnRenamed(own_size, c["size"]).drop(own_key, place, *[c[k] for k in ("cut_key", "cut_size", "whole", "part", "ties")])


def names_of(rows: DataFrame, name: str) -> dict[str, str]:
    """The names that taken() gives to what it adds, none of them a column of rows."""
    kinds = ("of", "source", "source_size", "target", "epochs", "cut_key", "cut_size", "whole", "part", "ties", "size", "taken")
    return dict(zip(kinds, free(rows.columns, *[f"{name}_{k}" for k in kinds]), strict=True))


def mix(rows: DataFrame, source: Column, size: Column, identity: Column, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """Adds size, source_size, target and taken to rows: how many units of each row the mix takes, repeats counted. Columns of these names are an error.

    source: string; null is a source of its own, the last. size: long, not null, at least 0. identity: string whose hash orders rows.
    Rows of a source get hash-random keys and are taken in their order until the source's units reach the target, rounded to whole units:
    whole epochs first, then the rows before the cut in one more; the row that the cut falls in gives what is still missing. So a
    source's taken units equal its rounded target, and no row gives more than `most` times its size, rounded up to whole epochs.
    Rows that are equal in identity and size may stand for one another. No rows: no rows. A source without units takes none.
    """
    clash = {"size", "source_size", "target", "taken"} & {c.lower() for c in rows.columns} - ({"size"} if "size" in rows.columns else set())
    if clash:
        raise ValueError(f"rows already have {sorted(clash)}; see mix_cuts() and taken()")
    key = mix_key(identity, seed)
    slim = written(rows.select(source.alias("source"), size.alias("size"), key.alias("key")), "mix")
    out = taken(rows, mix_cuts(slim, weights, share, most), source, size, key)
    c = names_of(rows, "taken")
    return out.select(*[k for k in rows.columns if k != "size"], *[F.col(c[k]).alias(k) for k in ("size", "source_size", "target", "taken")])


def mixed_rows(rows: DataFrame, columns: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """The mix itself: each row of mix() once for every whole epoch that takes it, and once more for a part of one that is at least half of it.

    Rows stay whole, so a source's units differ from its target by half of the one row at its cut at most. Rows without units come once for every
    whole epoch of their source; a source without units has none. names: of size, source_size, target and taken, where they have others.
    """
    n = {k: F.col((names or {}).get(k, k)) for k in ("size", "source_size", "target", "taken")}
    whole = F.when(n["source_size"] > 0, F.floor(F.round(n["target"]).cast("long") / n["source_size"])).otherwise(0)
    epochs = F.when(n["size"] > 0, F.floor(n["taken"] / n["size"] + 0.5)).otherwise(whole).cast("int")
    (copy,) = free(rows.columns, "copy")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), epochs))).select(*columns)


def op4_mixing(spark, sf_dir):
    """All documents. A null doc_id counts as an empty identity; repeated rows each count."""
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    docs = written(docs, "sizes")
    return mix(docs, F.col("source"), F.col("size"), F.col("doc_id").cast("string")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][(nth % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER () * 1.5)::DOUBLE AS budget FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS stopped,
              sum(w) OVER (ORDER BY cap / w, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS lft FROM s1),
s3 AS (SELECT *, (budget - stopped) / lft AS unit FROM s2),
u AS (SELECT arg_min(unit, cap / w) AS unit FROM s3 WHERE unit * w <= cap),
s AS (SELECT source, source_size, least(cap, coalesce(u.unit * w, cap))::DOUBLE AS target FROM s3 LEFT JOIN u ON true),
p AS (SELECT d.*, s.source_size, s.target, sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS up_to
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
g AS (SELECT *, round(target)::BIGINT AS goal, CASE WHEN source_size > 0 THEN floor(round(target) / source_size) ELSE 0 END::BIGINT AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, goal - epochs * source_size - (up_to - size))))::BIGINT AS taken FROM g
"""
