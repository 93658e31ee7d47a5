"""Summaries of replies, rationales, preference pairs and engines, and the jobs that are made of them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import verify as V
from . import aggregate as A


def rate(c: Column) -> Column:
    return F.avg(F.coalesce(c, F.lit(False)).cast("double"))


def type_stats(rows: DataFrame, by: list[str], judged: str, finish: str, tokens: str) -> DataFrame:
    """Of each group: items, parse, strict and cut-off rates, and the mean number of output tokens. judged: a verdict."""
    return rows.groupBy(*by).agg(F.count("*").alias("items"), rate(F.col(f"{judged}.parse_ok")).alias("parse_rate"), rate(F.col(f"{judged}.strict_ok")).alias("strict_rate"), rate(F.col(finish) == "length").alias("cut_off_rate"), F.avg(F.size(tokens)).alias("mean_output_tokens"))


def output_stats(rows: DataFrame, finish: str, tokens: str) -> DataFrame:
    """(finish, n, n_outputs, mean, longest): finish reasons with their counts, beside the number of outputs and the mean and largest length of all."""
    size = F.size(tokens).cast("long")
    per = rows.groupBy(finish).agg(F.count("*").alias("n"), F.sum(size).alias("total"), F.max(size).alias("longest"))
    whole = per.agg(F.sum("n").alias("n_outputs"), F.round(F.sum("total") / F.sum("n"), 1).alias("mean"), F.max("longest").alias("longest"))
    return per.select(finish, "n").crossJoin(F.broadcast(whole))


def reason_counts(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, of, reason, n): how often each reason stands in each of some columns, nulls left out."""
    each = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("string").alias("reason")) for c in columns])).alias("x"))
    return each.select(*by, "x.of", "x.reason").where("reason IS NOT NULL").groupBy(*by, "of", "reason").agg(F.count("*").alias("n"))


def attempt_histograms(decisions: DataFrame, attempts: str) -> DataFrame:
    """(of, value, n): statuses by attempt and reasons of rejected proposals. attempts: an array of (attempt, status, rejected: array of (raw, reason))."""
    a = decisions.select(F.explode(attempts).alias("a"))
    status = a.select(F.lit("status").alias("of"), F.concat(F.lit("attempt "), F.col("a.attempt").cast("string"), F.lit(": "), F.col("a.status")).alias("value"))
    reasons = a.select(F.explode("a.rejected").alias("r")).select(F.lit("reason").alias("of"), F.col("r.reason").alias("value"))
    return status.union(reasons).groupBy("of", "value").agg(F.count("*").alias("n"))


def source_histogram(decisions: DataFrame, by: list[str], sources: str) -> DataFrame:
    """(by, source, n, items): how often each source stands in an array, and in how many rows at all."""
    each = decisions.select(*by, sources, F.monotonically_increasing_id().alias("_row")).select(*by, "_row", F.explode(sources).alias("source"))
    return each.groupBy(*by, "source", "_row").agg(F.count("*").alias("k")).groupBy(*by, "source").agg(F.sum("k").alias("n"), F.count("*").alias("items"))


def banded(num: Column, den: Column, middle: str = "report_quality") -> Column:
    """as_specified from a half on, then the middle name from a tenth on, else floored; in whole numbers."""
    return F.when(num * 2 >= den, "as_specified").when(num * 10 >= den, middle).otherwise("floored")


def rationale_summary(rows: DataFrame, kind: str, source: str, leak: str, drop_at: int = 3) -> DataFrame:
    """Of each kind: n, rows by source (self_a1, self_a2, gold_only), leaks at the first attempt, the band of the first pass rate, whether the substitution fires
    (a pass rate below a half, or a fallback above it), and whether so many kinds fire that the arm is dropped."""
    of = lambda s: F.sum((F.col(source) == s).cast("long"))
    per = rows.groupBy(kind).agg(F.count("*").alias("n"), of("self_a1").alias("passed"), of("self_a2").alias("retried"), of("gold_only").alias("fallback"), F.sum(F.col(leak).cast("long")).alias("leaks"))
    per = per.withColumns({"band": banded(F.col("passed"), F.col("n")), "fires": (F.col("passed") * 2 < F.col("n")) | (F.col("fallback") * 2 > F.col("n"))})
    fired = per.agg((F.sum(F.col("fires").cast("int")) >= drop_at).alias("drops_arm"))
    return per.crossJoin(F.broadcast(fired))


def preference_summary(rows: DataFrame, kind: str, source: str, rule_kinds: list[str]) -> DataFrame:
    """Of each kind: n, pairs by source (model_a1, model_a2, rule), the band of those built at the first attempt, null for kinds that are always built by rule."""
    of = lambda s: F.sum((F.col(source) == s).cast("long"))
    per = rows.groupBy(kind).agg(F.count("*").alias("n"), of("model_a1").alias("first"), of("model_a2").alias("second"), of("rule").alias("rule"))
    return per.withColumn("band", F.when(~F.col(kind).isin(rule_kinds), banded(F.col("first"), F.col("n"))))


def score_distribution(rows: DataFrame, by: list[str], num: str, den: str) -> DataFrame:
    """(by, num, den, n): reduced scores with their counts; order by num / den."""
    def gcd(a, b):  # by trial, as scores have small denominators
        return F.aggregate(F.sequence(F.lit(1), F.least(a, b)), F.lit(1).cast("long"), lambda g, d: F.when((a % d == 0) & (b % d == 0), d.cast("long")).otherwise(g))

    a, b = F.col(num).cast("long"), F.col(den).cast("long")
    g = F.when(a > 0, gcd(a, b)).otherwise(b)
    return rows.select(*by, (a / g).cast("long").alias("num"), (b / g).cast("long").alias("den")).groupBy(*by, "num", "den").agg(F.count("*").alias("n"))


def token_capacity(rows: DataFrame, kind: str, tokens: str, answer: int, pinned: int, qs: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """Nearest-rank quantiles of tokens by kind, and (longest, needed, fits): the longest prompt, with room for an answer, against the pinned length."""
    whole = rows.agg(F.max(tokens).alias("longest"))
    return A.nearest_rank(rows, [kind], tokens, qs), whole.select("longest", (F.col("longest") + answer).alias("needed"), (F.col("longest") + answer <= pinned).alias("fits"))


def parser_review(replies: DataFrame, key: list[str], kind: str, text: str, finish: str, judged: str, each: int, rank: Column, tail: int = 600) -> tuple[DataFrame, DataFrame]:
    """Counts by (source, kind, category) of replies that want a look, and the first `each` of them by rank with the end of the text. replies have a source."""
    found = replies.withColumn("category", V.review_category(F.col(kind), F.col(text), F.col(finish), F.col(judged))).where("category IS NOT NULL")
    counts = found.groupBy("source", kind, "category").agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy("source", kind, "category").orderBy(rank, *key))
    return counts, found.withColumn("nth", at).where(F.col("nth") <= each).select("source", kind, "category", "nth", *key, F.expr(f"right({text}, {tail})").alias("excerpt"))


def parser_guard(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Violations (check, key, message) where a frozen artifact's verdict has changed, or one of both is missing."""
    a, b = stored.select(key, F.to_json("v").alias("_a")), fresh.select(key, F.to_json("v").alias("_b"))
    both = a.join(b, key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(F.lit("frozen verdict").alias("check"), F.col(key).cast("string").alias("key"), F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").otherwise("changed").alias("message"))


def audit(rows: DataFrame, item: str, kind: str, outputs: str, caps: list[int], stop: int, score) -> tuple[DataFrame, DataFrame]:
    """Every rollout of every item at every cap: (item, kind, cap, pos, cut, score), and by kind and cap (n, n_cut, groups, live).

    outputs: an array of token-id arrays. A cap keeps the ids that it would have returned; score: a column of those ids and of whether they were cut.
    """
    each = rows.select(item, kind, F.posexplode(outputs).alias("pos", "ids")).withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps])))
    each = each.withColumn("c", T.prefix_cut(F.col("ids"), F.col("cap"), stop)).select(item, kind, "cap", "pos", F.col("c.cut").alias("cut"), score(F.col("c.ids"), F.col("c.cut")).alias("score"))
    groups = each.groupBy(kind, "cap", item).agg(F.count("*").alias("n"), F.sum(F.col("cut").cast("long")).alias("n_cut"), (F.min("score") != F.max("score")).alias("live"))
    return each, groups.groupBy(kind, "cap").agg(F.sum("n").alias("n"), F.sum("n_cut").alias("n_cut"), F.count("*").alias("groups"), F.sum(F.col("live").cast("long")).alias("live"))


def engine_gap(scores: DataFrame, kind: str, unit: str, engine: str, value: str, first, second) -> DataFrame:
    """Of each kind: units, both engines' means, the gap (second less first) and how many units either has better. A unit that one engine lacks is an error."""
    of = lambda e: F.max(F.when(F.col(engine) == F.lit(e), F.col(value)))
    per = scores.where(F.col(engine).isin(first, second)).groupBy(kind, unit).agg(of(first).alias("x"), of(second).alias("y"))
    per = per.withColumn("x", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("x")).otherwise(F.raise_error(F.lit("the engines were scored on different units")).cast("double")))
    return per.groupBy(kind).agg(F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), (F.avg("y") - F.avg("x")).alias("gap"), F.sum((F.col("y") > F.col("x")).cast("long")).alias("y_better"), F.sum((F.col("x") > F.col("y")).cast("long")).alias("x_better"))


def same_requests(engines: DataFrame, engine: str, request: str, first, second) -> DataFrame:
    """Requests that only one of two engines has, or one of them more often: an empty table if one is a permutation of the other. (request, n_first, n_second)"""
    n = lambda e: F.sum((F.col(engine) == F.lit(e)).cast("long"))
    return engines.where(F.col(engine).isin(first, second)).groupBy(request).agg(n(first).alias("n_first"), n(second).alias("n_second")).where("n_first <> n_second")


def worst_outcome(rows: DataFrame, outcome: str) -> DataFrame:
    """One row: the worst of several outcomes, large before material before not detected."""
    order = F.when(F.col(outcome) == "large", 2).when(F.col(outcome) == "material", 1).otherwise(0)
    return rows.agg(F.max_by(outcome, order).alias("outcome"))


def constant_baselines(golds: DataFrame, gold: str, answer: Column, relation: DataFrame | None = None, credit: Column | None = None) -> DataFrame:
    """(n, exact, units, own_best, own_n): of a constant answer how many golds it hits and what it earns by relation, and the sample's own most frequent gold."""
    counts = golds.groupBy(gold).agg(F.count("*").alias("c")).withColumn("_a", answer)
    if relation is not None:
        counts = counts.join(relation.toDF("_a", gold, "relation"), ["_a", gold], "left").withColumn("u", F.coalesce(credit, F.lit(0)))
    else:
        counts = counts.withColumn("u", (F.col("_a") == F.col(gold)).cast("int"))
    best = F.min(F.struct((-F.col("c")).alias("m"), A.number_of(F.col(gold).cast("string")).alias("k"), F.col(gold).alias("g")))
    return counts.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("_a") == F.col(gold), F.col("c")).otherwise(0)).alias("exact"), F.sum(F.col("c") * F.col("u")).alias("units"), best.alias("b")).select("n", "exact", "units", F.col("b.g").alias("own_best"), (-F.col("b.m")).alias("own_n"))
