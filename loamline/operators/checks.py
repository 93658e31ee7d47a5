"""Invariants as tables of violations: (check, key, message). An empty table passes."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import strong_components


def row_checks(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """Rows where a condition is false or null, in one pass."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("check")).select("check", "key", F.lit("does not hold").alias("message"))


def unique(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().where("count > 1").select(F.lit(f"unique {key}").alias("check"), F.col(key).cast("string").alias("key"), F.concat(F.col("count").cast("string"), F.lit(" rows")).alias("message"))


def one_value(rows: DataFrame, group: str, column: str) -> DataFrame:
    """Groups with more than one value, such as clusters in two pools."""
    return rows.groupBy(group).agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("lo <> hi").select(F.lit(f"one {column} for each {group}").alias("check"), F.col(group).cast("string").alias("key"), F.concat_ws(" and ", "lo", "hi").alias("message"))


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key)).select(F.lit(f"disjoint {key}").alias("check"), F.col(key).cast("string").alias("key"), F.lit("in both").alias("message"))


def hierarchy(flagged: DataFrame, edges: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """Violations of a hierarchy: a live weakness outside the view, an edge whose end isn't a live weakness, a node that is its own ancestor, and, with mapped
    (id), a deprecated weakness without an entry. flagged: what graph.node_flags() gives."""
    told = lambda df, check, key, message: df.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"), F.lit(message).alias("message"))
    live = flagged.where("kind = 'weakness' AND NOT is_deprecated").select("id")
    ends = edges.select(F.explode(F.array("child", "parent")).alias("id")).distinct()
    parts = [
        told(flagged.where("kind = 'weakness' AND NOT is_deprecated AND NOT in_view"), "in the view", "id", "live, but neither a pillar nor a child"),
        told(ends.join(live, "id", "left_anti"), "live ends", "id", "an edge's end"),
        told(cyclic(edges), "no cycle", "id", "its own ancestor"),
    ]
    if mapped is not None:
        parts.append(told(flagged.where("is_deprecated").join(mapped.select("id"), "id", "left_anti"), "mapped", "id", "deprecated, without an entry"))
    return together(parts)


def cyclic(edges: DataFrame) -> DataFrame:
    """(id): nodes that are their own ancestors, none between two cycles."""
    return strong_components(edges).select("id")


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def require(violations: DataFrame) -> None:
    """Stops with the first ten."""
    bad = violations.limit(10).collect()
    if bad:
        raise AssertionError("\n".join(f"{r['check']}: {r['key']} {r['message']}" for r in bad))


def pair_checks(target_first, target_second, same_commit, same_cve, cve, first, second, shared) -> list[tuple[str, Column]]:
    """The six ordered checks of a pair of functions, as reasons for ledger.with_fate(): a null id or text fails its check."""
    blank = lambda c: F.coalesce(F.regexp_replace(c, r"(?U)\s", "") == "", F.lit(True))
    return [
        ("bad_target_order", ~(target_first.eqNullSafe(F.lit(1)) & target_second.eqNullSafe(F.lit(0)))),
        ("cross_commit_or_cve", ~F.coalesce(same_commit & same_cve, F.lit(False))),
        ("malformed_cve", ~F.coalesce(cve.rlike(r"\ACVE-\d{4}-\d{4,}\z"), F.lit(False))),
        ("empty_function", blank(first) | blank(second)),
        ("identical_text", F.coalesce(first == second, F.lit(False))),
        ("shared_patched_function", shared),
    ]


def patch_checks(change, tokens: Column, cap: int, num: int = 1, den: int = 5) -> list[tuple[str, Column]]:
    """The four filters of a pair's change (what code.line_change() gives), in order: empty_patch, patch_over_20pct, inserted_over_20pct, over_token_cap."""
    over = lambda n: n * den > change["n_code_lines"] * num
    return [("empty_patch", F.size(change["lines"]) == 0), ("patch_over_20pct", over(F.size(change["lines"]))), ("inserted_over_20pct", over(change["n_inserted"])), ("over_token_cap", tokens > cap)]
