"""Resampling inference. Draws come from hashes, so that SQL gives the same; simulations of a small score matrix run on the driver, in numpy."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rank import drawn, rank_hex
from .graph import kept
from .sampling import numbered, ordered


def score_matrix(rows: DataFrame, answer: str, gold: str, score) -> DataFrame:
    """(answer, gold, units) for each two distinct values, where units aren't 0. score: a function of both columns. For few distinct values; where a score
    is a relation of a graph, join that instead."""
    a = rows.where(F.col(answer).isNotNull()).select(answer).distinct()
    g = rows.select(gold).distinct()
    return a.crossJoin(g).withColumn("units", score(F.col(answer), F.col(gold)).cast("long")).where("units <> 0")


def observed_and_control(rows: DataFrame, answer: str, gold: str, matrix: DataFrame | None = None) -> DataFrame:
    """(hits, pairs, n): units that rows' answers earn against their own golds, and against the golds of all other rows.

    matrix (answer, gold, units): what an answer earns, as far as it isn't 0; without it an answer earns 1 for its equal. The control's
    mean is pairs / (n * (n - 1)). Pairs come from the counts of answers and golds, never from rows times rows.
    """
    if matrix is None:
        own = rows.agg(F.coalesce(F.sum((F.col(answer) == F.col(gold)).cast("long")), F.lit(0)).alias("hits"), F.count("*").alias("n"))
    else:
        own = rows.join(matrix, [answer, gold], "left").agg(F.coalesce(F.sum("units"), F.lit(0)).alias("hits"), F.count("*").alias("n"))
    a = rows.where(F.col(answer).isNotNull()).groupBy(F.col(answer).alias("a")).agg(F.count("*").alias("na"))
    g = rows.where(F.col(gold).isNotNull()).groupBy(F.col(gold).alias("g")).agg(F.count("*").alias("ng"))
    if matrix is None:
        both = a.join(g, F.col("a") == F.col("g")).select((F.col("na") * F.col("ng")).alias("u"))
    else:
        both = matrix.toDF("a", "g", "units").join(a, "a").join(g, "g").select((F.col("na") * F.col("ng") * F.col("units")).alias("u"))
    both = both.agg(F.coalesce(F.sum("u"), F.lit(0)).alias("all_pairs"))
    return own.crossJoin(F.broadcast(both)).select("hits", (F.col("all_pairs") - F.col("hits")).alias("pairs"), "n")


#: Distinct (answer, gold) cells, and cells of the score matrix, that a simulation of counts may hold.
CELLS = 4_000_000


def _counts(rows: DataFrame, answer: str, gold: str, matrix: DataFrame | None):
    """Counts of the distinct (answer, gold) cells and the dense matrix of units, on the driver: as large as the numbers of distinct values, not of rows."""
    cells = rows.groupBy(answer, gold).agg(F.count("*").alias("n")).limit(CELLS + 1).collect()
    answers, golds = sorted({r[0] for r in cells if r[0] is not None}, key=str), sorted({r[1] for r in cells}, key=str)
    if len(cells) > CELLS or (len(answers) + 1) * max(1, len(golds)) > CELLS:
        raise ValueError("too many distinct answers and golds to simulate their counts")
    row, column = {a: i for i, a in enumerate(answers)}, {g: i for i, g in enumerate(golds)}
    units = np.zeros((len(answers) + 1, len(golds)), np.int64)  # the last row: no answer
    if matrix is None:
        for a, i in row.items():
            if a in column:
                units[i, column[a]] = 1
    else:
        for a, g, u in matrix.join(rows.select(answer).distinct(), answer, "left_semi").join(rows.select(gold).distinct(), gold, "left_semi").select(answer, gold, matrix.columns[2]).collect():
            units[row[a], column[g]] = u
    at = np.array([[row.get(r[0], len(answers)), column[r[1]]] for r in cells], np.int64).reshape(-1, 2)
    return at, np.array([r["n"] for r in cells], np.int64), units


def _replicated(spark, replicates: int, draw, name: str, tasks: int = 64) -> DataFrame:
    """(replicate, <name>): draw(rng) for each replicate, whose generator is seeded by its own number; spread over tasks."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(draw(i)) for i in ids])], names=["replicate", name])

    return spark.range(0, replicates, 1, min(tasks, replicates)).toDF("replicate").mapInArrow(run, f"replicate long, {name} double")


def permuted_units(rows: DataFrame, answer: str, gold: str, replicates: int, matrix: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(replicate, units): what answers earn when golds are dealt to them at random.

    The units depend only on how many rows of each answer get each gold. Such a table of counts, with the margins fixed, is drawn answer
    by answer from the hypergeometric law, which is the law of a shuffle of the rows, so a replicate costs no more for more rows.
    """
    at, n, units = _counts(rows, answer, gold, matrix)
    of_answer, of_gold = np.bincount(at[:, 0], n, len(units)).astype(np.int64), np.bincount(at[:, 1], n, units.shape[1]).astype(np.int64)

    def draw(i):
        rng, free, total = np.random.default_rng([seed, i]), of_gold.copy(), 0
        for a in np.flatnonzero(of_answer[:-1]):
            got = rng.multivariate_hypergeometric(free, of_answer[a]) if len(free) > 1 else of_answer[a : a + 1]
            free -= got
            total += int(got @ units[a])
        return total

    return _replicated(rows.sparkSession, replicates, draw, "units")


def margin_resamples(rows: DataFrame, answer: str, gold: str, resamples: int, unit: int, matrix: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(replicate, margin): of each resample of the rows, with replacement, the mean score of own golds less the mean over all other rows' golds.

    A resample's counts of the distinct (answer, gold) cells are drawn from the multinomial law. unit: units of a whole score.
    """
    at, n, units = _counts(rows, answer, gold, matrix)
    total = int(n.sum())
    own, share = units[at[:, 0], at[:, 1]], n / max(1, total)

    def draw(i):
        m = np.random.default_rng([seed, 1, i]).multinomial(total, share)
        a, g = np.bincount(at[:, 0], m, len(units)), np.bincount(at[:, 1], m, units.shape[1])
        hits = float(m @ own)
        return hits / (unit * total) - (float(a @ units @ g) - hits) / (unit * total * (total - 1))

    return _replicated(rows.sparkSession, resamples, draw, "margin")


def paired_resamples(differences: DataFrame, difference: str, resamples: int, seed: int = 0) -> DataFrame:
    """(replicate, mean): means of resampled paired differences, from the counts of their distinct values."""
    cells = differences.groupBy(difference).agg(F.count("*").alias("n")).limit(CELLS + 1).collect()
    if len(cells) > CELLS:
        raise ValueError("too many distinct differences to simulate their counts")
    v, n = np.array([float(r[0]) for r in cells]), np.array([r["n"] for r in cells], np.int64)
    total = int(n.sum())
    return _replicated(differences.sparkSession, resamples, lambda i: np.random.default_rng([seed, 2, i]).multinomial(total, n / max(1, total)) @ v / max(1, total), "mean")


def material(gap: Column, low: Column, high: Column, num: int = 1, den: int = 100) -> Column:
    """A gap of at least num / den whose interval has 0 on one side."""
    return (F.abs(gap) * den >= num) & ((low > 0) | (high < 0))


def permutation_hits(rows: DataFrame, key: str, answer: str, gold: str, replicates: int, salt: str = "perm") -> DataFrame:
    """(replicate, hits): each replicate gives row i, in the order of keys, the gold of the row whose rank is i-th. As SQL can do it; permuted_units()
    costs less. No task orders a whole replicate."""
    reps = rows.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    each = ordered(rows.select(key, answer, gold), "i", key).crossJoin(F.broadcast(reps))
    each = numbered(each, "j", rank_hex(F.col(key), salt, F.col("replicate")), key, by=("replicate",))
    golds = each.select("replicate", F.col("j").alias("i"), F.col(gold).alias("other"))
    return each.select("replicate", "i", answer).join(golds, ["replicate", "i"]).groupBy("replicate").agg(F.sum(F.coalesce((F.col(answer) == F.col("other")).cast("long"), F.lit(0))).alias("hits"))


def permutation_p(hits: DataFrame, observed: DataFrame, value: str = "hits") -> DataFrame:
    """(1 + replicates that reach the observed hits) / (1 + replicates), as two whole numbers."""
    return hits.crossJoin(F.broadcast(observed.select(F.col("hits").alias("seen")))).agg((F.sum((F.col(value) >= F.col("seen")).cast("long")) + 1).alias("p_num"), (F.count("*") + 1).alias("p_den"))


def swap_p(ahead: int, behind: int, replicates: int = 10_000, seed: int = 1) -> tuple[int, int]:
    """p of a paired margin of 0/1 values, as permutation_p gives it: each replicate swaps the two values of every row by a coin.

    Only rows whose values differ count, so the swapped rows' sum is that of `ahead + behind` coins, which are drawn at once.
    """
    drawn = np.random.default_rng(seed).binomial(ahead + behind, 0.5, replicates)
    return int((drawn >= ahead).sum()) + 1, replicates + 1


#: Draws that are made at once, and rows whose values one group holds.
DRAWS, VALUES = 1 << 16, 1 << 14


def bootstrap_sums(rows: DataFrame, key: str, value: str, resamples: int, salt: str = "boot") -> DataFrame:
    """(resample, total): sums over n draws with replacement; draw i of a resample is row rank(resample, i) mod n in the order of keys. value is whole; nulls are left out. As
    SQL can do it; paired_resamples() costs less.

    Some draws of a resample are made at once and go, two bytes each, to the blocks of rows that they hit; a block's draws of all resamples meet its values in one group, whose size
    doesn't grow with the rows.
    """
    spark = rows.sparkSession
    line = kept(ordered(rows.select(key, F.col(value).cast("long").alias("v")), "i", key).select("i", "v"))
    n = line.count()
    chunks = -(-n // DRAWS)
    tasks = max(1, min(resamples * chunks, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def draw(batches):
        for batch in batches:
            for x in batch.column("id").to_pylist():
                resample, first = x % resamples, x // resamples * DRAWS
                hit = np.array([drawn(salt, resample, i, n) for i in range(first, min(n, first + DRAWS))], np.int64)
                hit.sort()
                blocks, starts = np.unique(hit // VALUES, return_index=True)
                parts = [p.tobytes() for p in np.split((hit % VALUES).astype(np.uint16), starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([resample] * len(blocks), pa.int32()), pa.array(parts, pa.binary())], names=["block", "resample", "hit"])

    def add(draws: pa.Table, values: pa.Table) -> pa.Table:
        v, there = np.zeros(VALUES, np.int64), np.zeros(VALUES, bool)
        at, known = values.column("i").to_numpy() % VALUES, values.column("v").is_valid().to_numpy()
        v[at], there[at] = values.column("v").fill_null(0).to_numpy(), known
        if int(np.abs(v.astype(np.float64)).max()) > 1 << 40:
            v = v.astype(object)  # sums that 64 bits may not hold
        sums = []
        for hit in draws.column("hit").to_pylist():
            k = np.frombuffer(hit, np.uint16)
            sums.append(int(v[k].sum()) if there[k].any() else None)
        return pa.table({"resample": draws.column("resample"), "total": pa.array(sums, pa.int64())})

    draws = spark.range(0, resamples * chunks, 1, tasks).mapInArrow(draw, "block long, resample int, hit binary")
    values = line.select(F.floor(F.col("i") / VALUES).cast("long").alias("block"), "i", "v")
    return draws.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(add, "resample int, total long").groupBy("resample").agg(F.sum("total").alias("total"))


def percentile_interval(sums: DataFrame, value: str, resamples: int, low: tuple[int, int] = (25, 1000), high: tuple[int, int] = (975, 1000)) -> DataFrame:
    """The values at positions int(low * R) and int(high * R) - 1 of the sorted resamples."""
    at = sums.withColumn("at", F.row_number().over(Window.orderBy(value)) - 1)
    return at.agg(F.max(F.when(F.col("at") == resamples * low[0] // low[1], F.col(value))).alias("low"), F.max(F.when(F.col("at") == resamples * high[0] // high[1] - 1, F.col(value))).alias("high"))


def outcome(margin: Column, p_num: Column, p_den: Column) -> Column:
    """large from 15 points on, material from 5 on, both with p under 0.05."""
    sure = p_num * 20 < p_den
    return F.when(sure & (margin >= 0.15), "large").when(sure & (margin >= 0.05), "material").otherwise("not detected")


def pooled_sd(runs: DataFrame, arm: str, column: str, value: str) -> DataFrame:
    """(column, sd): root of the mean over arms of the variance across seeds."""
    return runs.groupBy(column, arm).agg(F.var_samp(value).alias("v")).groupBy(column).agg(F.sqrt(F.avg("v")).alias("sd"))


def double_centred(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Adds residual: row, column and grand means removed. One row for each cell of a full matrix."""
    mean = lambda *by: F.avg(value).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return cells.withColumn("residual", F.col(value) - mean(row) - mean(column) + mean())


def spreadless(runs: DataFrame, arm: str, column: str, value: str) -> DataFrame:
    """Columns (column) in which no arm's runs differ: decided by equality of values, not by a variance."""
    return runs.groupBy(column, arm).agg((F.min(value) == F.max(value)).alias("same")).groupBy(column).agg(F.bool_and("same").alias("same")).where("same").select(column)


def interaction(runs: DataFrame, arm: str, column: str, value: str) -> DataFrame:
    """Cells (arm, column, m, residual) of seed-averaged values over the pooled SD; T is the sum of squared residuals. A column without spread can't be
    standardised, so it goes; spreadless() names those."""
    sd = pooled_sd(runs, arm, column, value).join(spreadless(runs, arm, column, value), column, "left_anti")
    cells = runs.groupBy(arm, column).agg(F.avg(value).alias("mean")).join(sd, column).withColumn("m", F.col("mean") / F.col("sd"))
    return double_centred(cells, arm, column, "m").select(arm, column, "mean", "sd", "m", "residual")


def collected_scores(rows: DataFrame, arms: list[str], kinds: dict[str, int], units: DataFrame | None = None, seeds: list | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """rows (arm, seed, item_id 'unit:kind:index', num, den). Returns (arm, kind, seed, unit, score): a unit's score, of kinds of several items whether all are 1.

    Other arms and kinds are ignored. An index that the kind doesn't have, a score twice, one outside [0, 1], an item missing within a unit, or
    (given units (unit) and seeds) anything but exactly those units for each arm, kind and seed is an error.
    """
    part = lambda i: F.try_element_at(F.split("item_id", ":"), F.lit(i))
    size = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("kind"))
    each = rows.withColumns({"unit": part(1), "kind": part(2), "index": part(3).try_cast("int")}).where(F.col("arm").isin(arms) & F.col("kind").isin(list(kinds)))
    if excluded is not None:
        each = each.join(excluded.select("unit"), "unit", "left_anti")
    each = kept(each.select("arm", "kind", "seed", "unit", "index", "num", "den", size.alias("size")))
    bad = each.where("index IS NULL OR index < 0 OR index >= size OR num IS NULL OR den IS NULL OR den <= 0 OR num < 0 OR num > den")
    if not bad.isEmpty():
        raise ValueError(f"not a score of an item: {bad.first().asDict()}")
    at = ["arm", "kind", "seed", "unit"]
    if not each.groupBy(*at, "index").count().where("count > 1").isEmpty():
        raise ValueError("a score comes twice")
    out = each.groupBy(*at).agg(F.count("*").alias("items"), F.max("size").alias("size"), F.min((F.col("num") == F.col("den")).cast("int")).alias("all_one"), F.max(F.col("num") / F.col("den")).alias("one"))
    if not out.where("items <> size").isEmpty():
        raise ValueError("a unit lacks an item")
    out = kept(out.select(*at, F.when(F.col("size") > 1, F.col("all_one").cast("double")).otherwise(F.col("one")).alias("score")))
    if units is not None and seeds is not None:
        grid = units.select("unit").distinct()
        for name, values in (("arm", arms), ("kind", list(kinds)), ("seed", seeds)):
            grid = grid.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(v,) for v in values], [name])))
        if excluded is not None:
            grid = grid.join(excluded.select("unit"), "unit", "left_anti")
        if not grid.join(out, at, "left_anti").isEmpty() or not out.join(grid, at, "left_anti").isEmpty():
            raise ValueError("scores don't cover the units, arms, kinds and seeds")
    return out


def standardised(units: DataFrame, unit: str, kind: str, value: str, scale: DataFrame) -> DataFrame:
    """(unit, score): each unit's mean over kinds of its value over the kind's scale (kind, scale). The mean of these is the statistic. A unit that lacks a
    kind is an error."""
    each = units.join(scale, kind)
    n = scale.count()
    out = each.groupBy(unit).agg((F.sum(F.col(value) / F.col("scale")) / n).alias("score"), F.count("*").alias("k"))
    return out.select(unit, F.when(F.col("k") == n, F.col("score")).otherwise(F.raise_error(F.lit("a unit lacks a kind")).cast("double")).alias("score"))


def frozen_choice(chosen: DataFrame, stored: DataFrame, by: list[str], run: str) -> DataFrame:
    """The choice of each group, new ones added to what is stored; a stored choice that would change is an error."""
    both = chosen.join(stored.withColumnRenamed(run, "_was"), by, "full_outer")
    same = F.when(F.col("_was").isNull() | F.col(run).isNull() | (F.col("_was") == F.col(run)), F.coalesce("_was", run))
    return both.select(*by, F.coalesce(same, F.raise_error(F.lit("an earlier choice would change")).cast(dict(chosen.dtypes)[run])).alias(run))


def centred(m: np.ndarray) -> np.ndarray:
    """Over the last two axes."""
    return m - m.mean(-1, keepdims=True) - m.mean(-2, keepdims=True) + m.mean((-1, -2), keepdims=True)


def statistic(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """y: (..., arms, columns, seeds). T and the standardised cells' residuals."""
    sd = np.sqrt(y.var(-1, ddof=1).mean(-2, keepdims=True))
    residual = centred(y.mean(-1) / sd)
    return (residual**2).sum((-1, -2)), residual


def null_statistics(y: np.ndarray, replicates: int, seed: int, batch: int = 1000) -> np.ndarray:
    """T of simulated experiments: the additive fit plus Gaussian run noise at each column's SD, which is estimated anew each time."""
    rng, sd = np.random.default_rng(seed), np.sqrt(y.var(-1, ddof=1).mean(-2))
    m = y.mean(-1) / sd
    expected = (m - centred(m)) * sd
    out = [statistic(expected[..., None] + sd[:, None] * rng.standard_normal((min(batch, replicates - i), *y.shape)))[0] for i in range(0, replicates, batch)]
    return np.sort(np.concatenate(out))


def p_value(t, null: np.ndarray) -> np.ndarray:
    """Ties within 1e-12 count as reaching t."""
    return (1 + len(null) - np.searchsorted(null, np.asarray(t) * (1 - 1e-12))) / (1 + len(null))


def interaction_test(y: np.ndarray, replicates: int = 10_000, seed: int = 0) -> dict:
    t, residual = statistic(y)
    p = float(p_value(t, null_statistics(y, replicates, seed)))
    return {"T": float(t), "p": p, "significant": p < 0.05, "residuals": residual, "contributions": residual**2 / t if t > 0 else residual * 0}


def minimal_effect(y: np.ndarray, simulations: int = 1000, replicates: int = 10_000, seed: int = 0, sim_seed: int = 1, power: float = 0.8) -> dict:
    """For each column the smallest planted effect, in points on a grid of quarters up to 50, from which power stays at 0.8 or above; None if there is none.

    Planting x in cell (i, j) changes T by 2 r[i, j] x + c x**2, so no experiment is simulated twice.
    """
    null = null_statistics(y, replicates, seed)
    rng, points = np.random.default_rng(sim_seed), np.arange(0, 50.25, 0.25)
    n_a, n_t, _ = y.shape
    sd = np.sqrt(y.var(-1, ddof=1).mean(-2))
    m = y.mean(-1) / sd
    draws = ((m - centred(m)) * sd)[..., None] + sd[:, None] * rng.standard_normal((simulations, *y.shape))
    t, residual = statistic(draws)
    own = np.sqrt(draws.var(-1, ddof=1).mean(-2))
    c = (1 - 1 / n_a) * (1 - 1 / n_t)
    out = []
    for j in range(n_t):
        x = points[None, :] / (100 * own[:, j, None])
        hit = np.mean([p_value(t[:, None] + 2 * residual[:, i, j, None] * x + c * x * x, null) < 0.05 for i in range(n_a)], axis=(0, 1))
        low = np.flatnonzero(hit < power)
        out.append(None if len(low) and low[-1] == len(points) - 1 else float(points[low[-1] + 1 if len(low) else 0]))
    return {"points": points, "minimal_effect": out}


def feasible_steps(seconds_per_step: float, overhead: float, budget: float, multiple: int = 4, most: int = 399, least: int = 48) -> int | None:
    """The largest multiple that fits; None if that is under the least."""
    n = int(min(most, (budget - overhead) // seconds_per_step)) // multiple * multiple
    return n if n >= least else None


def list_schedule(sizes: dict[str, float], machines: int) -> list[tuple[str, int, float]]:
    """Longest first, of equally long ones the first given, each to the machine that is free first, ties to the lower one: (job, machine, start)."""
    free, out = [0.0] * machines, []
    for job, size in sorted(sizes.items(), key=lambda kv: -kv[1]):
        at = min(range(machines), key=lambda k: (free[k], k))
        out.append((job, at, free[at]))
        free[at] += size
    return out
