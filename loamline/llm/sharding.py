"""Exact uniform shuffle into shards, planned as a hypergeometric communication matrix."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free, small_batches, written

#: Source partitions are put together to so many groups at most, so that the driver's matrix stays small whatever the input; a task draws its own group's part of it.
GROUPS = 512
#: Rows of one block of a shard; a block is permuted by one task.
BLOCK_ROWS = 100_000
#: Cells (group x block) that the matrix may have; beyond, blocks grow.
CELLS = 8_000_000
#: Places among which numpy draws by itself.
SMALL = 10**9


def stirling_rest(n: float) -> float:
    """ln n! less Stirling's (n + 1/2) ln n - n + ln(2 pi) / 2."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - 1 / 1260 / n**2) / n**2) / n


def deviance(x: float, m: float) -> float:
    """x ln(x / m) + m - x, exact also where x is near m."""
    v = (x - m) / (x + m)
    if abs(v) > 0.1:
        return x * math.log(x / m) + m - x
    out, term, j = (x - m) * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = out + term / (2 * j + 1)
        if more == out:
            return out
        out, j = more, j + 1


def log_binomial(x: float, n: float, p: float) -> float:
    """ln of the chance of x of n, from the deviances of its parts (Loader's form): no large numbers cancel."""
    if x == 0 or x == n:
        return n * (math.log1p(-p) if x == 0 else math.log(p))
    core = stirling_rest(n) - stirling_rest(x) - stirling_rest(n - x) - deviance(x, n * p) - deviance(n - x, n * (1 - p))
    return core - 0.5 * (math.log(2 * math.pi * x) + math.log1p(-x / n))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, small: int = SMALL) -> int:
    """How many of n drawn from good + bad are good. numpy's own draw below `small`, its limit; beyond, the same law by a ratio of uniforms."""
    if good + bad < small:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    total, few, drawn = good + bad, min(good, bad), min(n, good + bad - n)
    if not drawn or not few:
        x = 0
    else:
        p, share = few / total, drawn / total
        scale = 2 * math.sqrt(2 / math.e) * math.sqrt(drawn * p * (1 - p) * (total - drawn) / (total - 1) + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
        chance = lambda k: log_binomial(k, few, share) + log_binomial(drawn - k, total - few, share)
        top = chance((drawn + 1) * (few + 1) // (total + 2))
        while True:
            u, v = 1 - rng.random(), rng.random()
            w = drawn * p + 0.5 + scale * (v - 0.5) / u
            if 0 <= w < min(drawn, few) + 1 and 2 * math.log(u) <= chance(math.floor(w)) - top:
                x = math.floor(w)
                break
    x = drawn - x if good > bad else x  # of the drawn ones, the good
    return x if drawn == n else good - x


def dealt(rng: np.random.Generator, places: np.ndarray, n: int, small: int = SMALL) -> np.ndarray:
    """n draws without replacement from places of several kinds: how many of each. Where places are too many for one draw, halves of the kinds are told apart first."""
    if len(places) == 1:
        return np.array([n], np.int64)
    if int(places.sum()) < small:
        return rng.multivariate_hypergeometric(places, n, method="marginals")
    half = len(places) // 2
    left = hypergeometric(rng, int(places[:half].sum()), int(places[half:].sum()), n, small)
    return np.concatenate([dealt(rng, places[:half], left, small), dealt(rng, places[half:], n - left, small)])


def communication_matrix(counts: np.ndarray, sizes: np.ndarray, seed) -> np.ndarray:
    """How many rows go from each partition to each block: rows sum to counts, columns to sizes, as a uniform shuffle would deal them.

    Row by row, the partition's rows are a draw without replacement from the places still free.
    """
    rng, left, out = np.random.default_rng(seed), sizes.astype(np.int64).copy(), []
    for n in counts:
        out.append(dealt(rng, left, int(n)))
        left -= out[-1]
    return np.array(out, dtype=np.int64).reshape(len(counts), len(sizes))


def hypergeometric_shards(rows: DataFrame, n_shards: int, order: Column, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds shard (0 .. n_shards - 1) and slot (0 .. its shard's size - 1, gapless) to every row. A column that is named so already stays, with underscores before its name.

    Shard sizes are at most one apart. A partition is sorted by a hash of `order` and the seed, which gives its rows random places; the places
    are dealt to blocks of shards by the matrix, rows are exchanged, once, and each block is permuted again by another hash. Places are
    frozen in a written table before rows are counted, so a recomputed task can't change them. What the driver holds is a count for each
    partition and the matrix of at most CELLS entries for at most GROUPS groups of partitions. How a group's row of the matrix is dealt to its partitions is drawn
    by the same law from the seed and the group, by each task that needs it, so all tasks agree. Rows that are equal in `order` may stand for one another.
    Nulls and repeated rows are rows like any other; copies of a text are not kept together. No rows: no rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    part_, one, two, place_, cell_, first_ = free(rows.columns, "part", "one", "two", "place", "cell", "first")
    keyed = rows.withColumns({part_: F.spark_partition_id(), one: F.xxhash64(F.lit(seed), order), two: F.xxhash64(F.lit(seed + 1), order)})
    for name in ("shard", "slot"):
        mine = [c for c in rows.columns if c.lower() == name]
        if mine:
            keyed = keyed.withColumnRenamed(mine[0], free(keyed.columns, name)[0])
    kept = [f for f in keyed.schema.fields if f.name not in (part_, one, two)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def number(batches):
        place = 0
        for batch in batches:
            yield batch.drop_columns([one]).append_column(place_, pa.array(np.arange(place + 1, place + 1 + batch.num_rows)))
            place += batch.num_rows

    base = written(keyed.sortWithinPartitions(one).mapInArrow(number, f"{kinds}, `{part_}` int, `{two}` long, `{place_}` long"), "shard")
    parts = sorted((r[part_], r["count"]) for r in base.groupBy(part_).count().collect())
    members: dict[int, list[tuple[int, int]]] = {}
    for p, n in parts:
        members.setdefault(p % GROUPS, []).append((p, n))
    total = sum(n for _, n in parts)
    blocks = max(1, min(-(-total // (n_shards * block_rows)), CELLS // (n_shards * max(1, len(members)))))
    ends = np.array([total * (i + 1) // n_shards for i in range(n_shards)], dtype=np.int64)
    shard_sizes = np.diff(ends, prepend=0)
    sizes = np.array([s * (j + 1) // blocks - s * j // blocks for s in shard_sizes.tolist() for j in range(blocks)], dtype=np.int64)
    groups = sorted(members)
    matrix = communication_matrix(np.array([sum(n for _, n in members[g]) for g in groups], dtype=np.int64), sizes, seed)
    offsets = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    offsets -= np.repeat(offsets[::blocks], blocks)
    sent = spark.sparkContext.broadcast((dict(zip(groups, matrix, strict=True)), members, offsets))

    def deal(batches):
        rows_of, members, first = sent.value
        found: dict[int, np.ndarray] = {}  # of each partition the last places of its cells
        for batch in batches:
            t = pa.Table.from_batches([batch])
            part, place = t.column(part_).to_numpy(), t.column(place_).to_numpy()
            cell = np.empty(len(part), np.int32)
            for p in np.unique(part).tolist():
                if p not in found:
                    g = p % GROUPS
                    own = communication_matrix(np.array([n for _, n in members[g]]), rows_of[g], [seed, g])
                    found |= {q: np.cumsum(row) for (q, _), row in zip(members[g], own, strict=True)}
                cell[part == p] = np.searchsorted(found[p], place[part == p], "left")
            t = t.append_column(cell_, pa.array(cell)).append_column(first_, pa.array(first[cell]))
            yield from t.drop_columns([part_, place_]).to_batches()

    out = base.mapInArrow(deal, f"{kinds}, `{two}` long, `{cell_}` int, `{first_}` long")
    inside = F.row_number().over(Window.partitionBy(cell_).orderBy(two))
    return out.select(*[F.col(f"`{f.name}`") for f in kept], F.floor(F.col(cell_) / blocks).cast("int").alias("shard"), (F.col(first_) + inside - 1).cast("long").alias("slot"))


def op7_sharding(spark, sf_dir):
    """All documents into 8 shards; the law that holds is `rows`."""
    from .shared import table

    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    out = hypergeometric_shards(docs, 8, F.struct("doc_id", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
