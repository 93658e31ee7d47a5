"""Work that is left, dealt to machines longest first, and when it would be over."""

from bisect import bisect_left
from heapq import heapify, heapreplace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Different durations that a plan may have: they, and the machines, are what the driver holds.
DURATIONS = 10_000


def filled(free: np.ndarray, size: float, n: int) -> np.ndarray:
    """How many of n equal jobs each machine gets if each goes to the one that is free first, ties to the lower one: the n earliest of all possible starts, free + j * size."""
    if size <= 0:
        out = np.zeros(len(free), np.int64)
        out[int(free.argmin())] = n
        return out
    some = lambda level: np.maximum(0, np.floor((level - free) / size).astype(np.int64) + 1)  # noqa: E731  starts up to a level
    low = float(free.min())
    levels = range(n + 1)
    top = bisect_left(levels, n, key=lambda k: int(some(low + k * size).sum()))  # after so many sizes there are enough starts
    out = some(low + (top - 1) * size) if top else np.zeros(len(free), np.int64)
    starts = [(float(f + k * size), i) for i, (f, k) in enumerate(zip(free, out, strict=True))]
    heapify(starts)
    for _ in range(n - int(out.sum())):  # about one for each machine at most
        start, i = starts[0]
        out[i] += 1
        heapreplace(starts, (start + size, i))
    return out


def list_schedule(jobs: DataFrame, job: str, hours: str, order: list[str], machines: int) -> DataFrame:
    """jobs (job, hours, and the columns `order`). Adds machine, from 0, and start: longest first, of equally long ones in order, each goes to the machine that is free first, ties
    to the lower one.

    Equally long jobs are dealt at once, by how many of them each machine gets, so the driver holds the different durations and the machines' times, no jobs. No job is longer or
    shorter for where it goes. Null and negative hours are an error.
    """
    spark = jobs.sparkSession
    kinds = jobs.select(F.col(hours).cast("double").alias("h")).groupBy("h").agg(F.count("*").alias("n")).limit(DURATIONS + 1).collect()
    if len(kinds) > DURATIONS:
        raise ValueError(f"more than {DURATIONS} different durations")
    free, plan = np.zeros(machines), []
    if any(r["h"] is None or r["h"] < 0 for r in kinds):
        raise ValueError("a job has no hours, or fewer than none")
    for r in sorted(kinds, key=lambda r: -r["h"]):
        n = filled(free, r["h"], r["n"])
        plan += [(r["h"], i, float(free[i]), int(k)) for i, k in enumerate(n) if k]
        free = free + n * r["h"]
    slots = spark.createDataFrame(plan, "_h double, machine int, _free double, _n long")
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_j")
    slots = slots.select("_h", "machine", "_free", nth).select("_h", "machine", (F.col("_free") + F.col("_j") * F.col("_h")).alias("start"))
    slots = slots.withColumn("_k", F.row_number().over(Window.partitionBy("_h").orderBy("start", "machine")))
    own = jobs.withColumn("_h", F.col(hours).cast("double")).withColumn("_k", F.row_number().over(Window.partitionBy("_h").orderBy(*order, job)))
    return own.join(slots, ["_h", "_k"]).select(*jobs.columns, "machine", "start")


def remaining_work(grid: DataFrame, done: DataFrame, by: list[str], hours: DataFrame, on: str, order: list[str], machines: int, limit: float) -> DataFrame:
    """What is left of a grid of specifications, with hours, machine, start, finish (when the last is over) and over_budget (whether that is after the limit).

    done: (by) what has been evaluated; hours: (on, hours), the estimate of each kind. order: who goes first of equally long ones. Nothing left: no rows.
    """
    left = grid.join(done.select(*by).distinct(), by, "left_anti").join(hours, on)
    plan = list_schedule(left.withColumn("_job", F.to_json(F.struct(*by))), "_job", "hours", order, machines).drop("_job")
    last = plan.agg(F.max(F.col("start") + F.col("hours")).alias("finish"))
    return plan.crossJoin(F.broadcast(last)).withColumn("over_budget", F.col("finish") > F.lit(limit))
