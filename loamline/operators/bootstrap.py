"""Bootstraps in one pass over rows: each unit has a Poisson weight in each replicate, from a hash, and sums of weighted values are merged."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights that a task holds at once.
CELLS_AT_ONCE = 1 << 20
#: Chances that a Poisson weight of mean 1 is at most 0, 1, 2 ...
AT_MOST = np.cumsum([np.exp(-1.0) / p for p in np.cumprod([1.0, *range(1, 19)])])


def weights(units: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """The weight of each unit (a 64-bit hash) in each replicate: the same wherever they are asked for."""
    x = units.astype(np.uint64)[:, None] ^ ((replicates.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 % (1 << 64)))[None, :]
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.searchsorted(AT_MOST, u, "right").astype(np.float64)


def poisson_means(rows: DataFrame, by: list[str], unit: Column, value: str, resamples: int, seed: int = 0) -> DataFrame:
    """(by..., replicate, mean): of each group and replicate the weighted mean of its rows' values; rows of one unit have one weight, so units are what is drawn.

    Rows are summed to units first. A task tells for each batch and group the replicates' sums, which are added up: what is moved is one row for each group and task, of
    `resamples` numbers, whatever the rows. A replicate in which no unit of a group is drawn has a null mean. Null values are left out.
    """
    names = [f"_by{i}" for i in range(len(by))]
    slim = rows.where(F.col(value).isNotNull()).select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], F.xxhash64(unit).alias("_u"), F.col(value).cast("double").alias("_v"))
    slim = slim.groupBy(*names, "_u").agg(F.sum("_v").alias("_v"), F.count("*").cast("double").alias("_n"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    every = np.arange(resamples)

    def add(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [tuple(batch.column(n)[i].as_py() for n in names) for i in range(batch.num_rows)] if names else [()] * batch.num_rows
            nth = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            of = np.array([nth[k] for k in keys])
            u, v, n = (batch.column(c).to_numpy() for c in ("_u", "_v", "_n"))
            sums, counts = np.zeros((len(nth), resamples)), np.zeros((len(nth), resamples))
            step = max(1, CELLS_AT_ONCE // max(1, resamples))
            for a in range(0, len(u), step):
                w = weights(u[a : a + step], every, seed)
                np.add.at(sums, of[a : a + step], w * v[a : a + step, None])
                np.add.at(counts, of[a : a + step], w * n[a : a + step, None])
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(nth) + 1) * resamples, pa.int32()), pa.array(x.ravel())) for x in (sums, counts)]
            first = [keys.index(k) for k in nth]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(first)) for c in names), *lists], names=[*names, "s", "c"])

    told = slim.mapInArrow(add, "".join(f"{n} {kinds[n]}, " for n in names) + "s array<double>, c array<double>")
    each = told.select(*names, F.posexplode(F.arrays_zip("s", "c")).alias("replicate", "x")).groupBy(*names, "replicate").agg(F.sum("x.s").alias("s"), F.sum("x.c").alias("c"))
    return each.select(*[F.col(n).alias(b) for b, n in zip(by, names, strict=True)], "replicate", F.when(F.col("c") > 0, F.col("s") / F.col("c")).alias("mean"))


def percentiles(means: DataFrame, by: list[str], resamples: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """(by..., low, high): the values at positions int(low * R) and int(high * R) - 1 of each group's sorted replicates, of which there are R."""
    at = means.withColumn("_at", F.row_number().over(Window.partitionBy(*by, F.lit(0)).orderBy("mean")) - 1)
    pick = lambda i, name: F.max(F.when(F.col("_at") == i, F.col("mean"))).alias(name)
    return at.groupBy(*by).agg(pick(resamples * low[0] // low[1], "low"), pick(resamples * high[0] // high[1] - 1, "high"))


def standardised_gap(scores: DataFrame, unit: str, kind: str, run: str, value: str, scale: DataFrame, first, second, resamples: int = 2000, low: tuple[int, int] = (25, 1000), high: tuple[int, int] = (975, 1000), seed: int = 0) -> DataFrame:
    """One row (difference, low, high, units): the second run's standardised score less the first's, and the interval of that over units, which are drawn whole.

    scores: (unit, kind, run, value); scale: (kind, scale). A unit's score is its mean over kinds of value / scale; a unit that lacks a kind in either run is an error.
    """
    from .inference import standardised

    side = lambda r: standardised(scores.where(F.col(run) == F.lit(r)).select(unit, kind, value), unit, kind, value, scale)
    both = side(first).withColumnRenamed("score", "x").join(side(second).withColumnRenamed("score", "y"), unit, "full_outer")
    gap = F.when(F.col("x").isNull() | F.col("y").isNull(), F.raise_error(F.lit("the runs were scored on different units")).cast("double")).otherwise(F.col("y") - F.col("x"))
    each = both.select(unit, gap.alias("difference"))
    ends = percentiles(poisson_means(each, [], F.col(unit), "difference", resamples, seed), [], resamples, low, high)
    return each.agg(F.avg("difference").alias("difference"), F.count("*").alias("units")).crossJoin(F.broadcast(ends))  # one row each


def engine_comparisons(scores: DataFrame, kind: str, unit: str, engine: str, value: str, pairs: list[tuple], resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """A row for each pair of engines and kind: (first, second, kind, n, mean_first, mean_second, gap, second_better, first_better, low, high, material, decides, outcome).

    pairs: the first one decides, the others, such as an engine against a second run of itself, show how much is noise. The gap is second less first; low and high are its 99%
    interval over units; it is material if it is a hundredth at least and its interval has 0 on one side. outcome: material if any kind of the deciding pair is, else
    agree. All pairs and kinds are drawn in one pass. A unit that an engine lacks is an error.
    """
    from .inference import material

    engines = list(dict.fromkeys(e for p in pairs for e in p))
    of = lambda e: F.max(F.when(F.col(engine) == F.lit(e), F.col(value))).alias(f"_e{engines.index(e)}")
    wide = scores.where(F.col(engine).isin(engines)).groupBy(kind, unit).agg(*[of(e) for e in engines])
    col = lambda e: F.col(f"_e{engines.index(e)}")
    one = lambda i, p: F.struct(F.lit(i).alias("nth"), F.lit(p[0]).alias("first"), F.lit(p[1]).alias("second"), col(p[0]).alias("x"), col(p[1]).alias("y"))
    each = wide.select(kind, unit, F.explode(F.array(*[one(i, p) for i, p in enumerate(pairs)])).alias("p")).select(kind, unit, "p.*")
    lacks = F.raise_error(F.lit("the engines were scored on different units")).cast("double")
    each = each.withColumn("d", F.when(F.col("x").isNull() | F.col("y").isNull(), lacks).otherwise(F.col("y") - F.col("x")))
    by = ["nth", "first", "second", kind]
    ends = percentiles(poisson_means(each, by, F.col(unit), "d", resamples, seed), by, resamples, (5, 1000), (995, 1000))
    more = lambda a, b: F.sum((F.col(a) > F.col(b)).cast("long"))
    out = each.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mean_first"), F.avg("y").alias("mean_second"), F.avg("d").alias("gap"), more("y", "x").alias("second_better"), more("x", "y").alias("first_better")).join(ends, by)
    out = out.withColumns({"material": material(F.col("gap"), F.col("low"), F.col("high")), "decides": F.col("nth") == 0})
    worst = F.max((F.col("material") & F.col("decides")).cast("int")).over(Window.partitionBy(F.lit(0)))  # a row for each pair and kind
    return out.withColumn("outcome", F.when(worst == 1, "material").otherwise("agree")).drop("nth")
