"""Requests and results of work done elsewhere: coverage, retries, last success, and what is still to do."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(requests: DataFrame, results: DataFrame, key: str, hash_column: str | None = None, outputs: str | None = None, wanted: int = 1) -> DataFrame:
    """(key, status): ok, missing (no result), unexpected (no request), duplicate (several results), hash_differs, or, with an array of outputs, outputs_differ where
    there aren't as many as wanted; by a full outer join."""
    asked = requests.groupBy(key).agg(F.count("*").alias("asked"), *([F.min(hash_column).alias("h")] if hash_column else []))
    got = results.groupBy(key).agg(F.count("*").alias("got"), *([F.min(hash_column).alias("h2")] if hash_column else []), *([F.min(F.size(outputs)).alias("o")] if outputs else []))
    both = asked.join(got, key, "full_outer")
    status = F.when(F.col("got").isNull(), "missing").when(F.col("asked").isNull(), "unexpected").when(F.col("got") > 1, "duplicate")
    status = status.when(~F.col("h").eqNullSafe(F.col("h2")), "hash_differs") if hash_column else status
    status = status.when(~F.col("o").eqNullSafe(F.lit(wanted)), "outputs_differ") if outputs else status
    return both.select(key, status.otherwise("ok").alias("status"))


def full_coverage(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """The inner join; anything but exactly one result for each request stops."""
    bad = reconcile(requests, results, key).where("status <> 'ok'").groupBy("status").count().collect()
    if bad:
        raise ValueError(f"results don't cover requests: { {r['status']: r['count'] for r in bad} }")
    return requests.join(results, key)


def todo(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return requests.join(done.select(key), key, "left_anti")


def last_success(attempts: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """Of each id the latest success, else the latest attempt. Adds succeeded."""
    w = Window.partitionBy(key).orderBy(F.desc("succeeded"), F.desc(order))
    return attempts.withColumn("succeeded", F.coalesce(ok, F.lit(False))).withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def retry_decision(attempts: DataFrame, key: str, attempt: str, text: str, reason: str, fallback: DataFrame, fallback_text: str) -> DataFrame:
    """(key, source, text): the first attempt without a reason against it (attempt_1, attempt_2), else the fallback (gold). A third attempt is refused."""
    if not attempts.where(F.col(attempt) > 2).isEmpty():
        raise ValueError("more than one retry")
    good = attempts.where(F.col(reason).isNull()).groupBy(key).agg(F.min(F.struct(attempt, text)).alias("g"))
    out = fallback.join(good, key, "left")
    return out.select(key, F.coalesce(F.concat(F.lit("attempt_"), F.col("g")[attempt].cast("string")), F.lit("gold")).alias("source"), F.coalesce(F.col("g")[text], F.col(fallback_text)).alias("text"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equality as multisets."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def admitted(candidates: DataFrame, key: str, order: list[str], value: str, banned: DataFrame, k: int) -> DataFrame:
    """The first k candidates of each key that aren't banned (key, value), the first of equal ones. Adds slot from 1."""
    first = candidates.groupBy(key, value).agg(F.min(F.struct(*order)).alias("_o")).join(banned.select(key, value), [key, value], "left_anti")
    return first.withColumn("slot", F.row_number().over(Window.partitionBy(key).orderBy("_o"))).where(F.col("slot") <= k).drop("_o")
