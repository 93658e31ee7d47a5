"""Ranks, samples, splits and orders."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rank import rank_hex, rank_mod
from ..operators import sampling as S
from ..tables import load


def rank_sql(*parts: str) -> str:
    return f"substr(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 16)"


def mod_sql(n: str, *parts: str) -> str:
    return f"(('0x' || {rank_sql(*parts)})::UBIGINT % ({n})::UBIGINT)::BIGINT"


def q_rank_sample(spark, d):
    """The 100 documents of each language with the lowest ranks, and a letter by the rank modulo 4."""
    out = S.lowest_ranked(load(spark, d, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 100, "sample")
    return out.select("lang", "doc_id", "rank", "nth", F.substring(F.lit("ABCD"), (rank_mod(4, F.col("doc_id"), "letter") + 1).cast("int"), F.lit(1)).alias("letter"))


def q_half_sample(spark, d):
    """Of the labelled documents the 200 with the lowest ranks; the lowest 100 also give a second item."""
    docs = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    out = S.numbered(docs, "place", rank_hex(F.col("doc_id"), "half"), "doc_id").where("place < 200")
    return out.select("doc_id", "place", F.explode(F.when(F.col("place") < 100, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("index"))


def q_seeded_shuffle_shards(spark, d):
    """Events in a seeded order, dealt to 8 shards by stride."""
    return S.stride_shards(S.seeded_shuffle(load(spark, d, "events").select("event_id"), "event_id", "shards"), 8)


def q_weighted_draw(spark, d):
    """Three nations for each supplier, drawn by their numbers of customers without replacement."""
    pool = load(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("w"))
    return S.weighted_draw(load(spark, d, "supplier").select("s_suppkey"), "s_suppkey", pool, "c_nationkey", "w", 3, "draw").select("s_suppkey", F.posexplode("drawn").alias("slot", "nation"))


def weighted_sql(slots: int) -> str:
    out = ["pool AS (SELECT c_nationkey AS n, count(*)::BIGINT AS w FROM customer GROUP BY 1)", "t0 AS (SELECT s_suppkey AS k, []::INT[] AS taken FROM supplier)"]
    for s in range(slots):
        out.append(f"c{s} AS (SELECT k, taken, n, w, sum(w) OVER (PARTITION BY k ORDER BY n) AS e, sum(w) OVER (PARTITION BY k) AS total FROM t{s}, pool WHERE NOT list_contains(taken, n))")
        out.append(f"t{s + 1} AS (SELECT k, list_append(taken, n) AS taken FROM c{s} WHERE {mod_sql('total', 'k::VARCHAR', chr(39) + 'draw' + chr(39), f'{chr(39)}{s}{chr(39)}')} BETWEEN e - w AND e - 1)")
    return f"WITH {', '.join(out)} SELECT k AS s_suppkey, (i - 1)::INT AS slot, taken[i] AS nation FROM t{slots}, range(1, {slots + 1}) AS r(i)"


def q_stratified_fill(spark, d):
    """Up to 5 customers of each market segment in turn, then the lowest ranks until 50."""
    rows = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    strata = [(s, F.col("c_mktsegment") == s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]
    return S.stratified_fill(rows, "c_custkey", strata, 5, 50, "strata").select("c_custkey", "c_mktsegment", "stratum")


def q_temporal_holdout(spark, d):
    """The latest 15% of orders, days whole."""
    return S.temporal_holdout(load(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "o_orderkey", "day", 3, 20).select("o_orderkey", "pool", "moved")


HOLDOUT = "o AS (SELECT *, o_orderdate::DATE AS day FROM orders), k AS (SELECT (count(*) * 3 + 19) // 20 AS k FROM o), c AS (SELECT min(day) AS cut FROM (SELECT day, row_number() OVER (ORDER BY day DESC) AS n FROM o), k WHERE n = k)"


def q_cluster_safe_holdout(spark, d):
    """The same, but a customer's orders of a clerk-like cluster (customer modulo 97 and year) stay on one side."""
    rows = load(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.concat_ws("-", (F.col("o_custkey") % 97).cast("string"), F.date_format("o_orderdate", "yyyy-MM")).alias("cluster"))
    return S.temporal_holdout(rows, "o_orderkey", "day", 3, 20, "cluster").select("o_orderkey", "pool", "moved")


def partitions(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return S.seeded_partition(rows, "o_orderkey", "o_custkey", ["o_orderdate", "o_orderkey"], 3, 3, 20, 150)


def q_seed_partitions(spark, d):
    """Rows and key sums of each seed's roles and checkpoint samples."""
    return partitions(spark, d).groupBy("seed", "role", "checkpoint", "late").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


PARTITIONS = f"""n AS (SELECT 2 * ((count(*) * 3 + 19) // 20) AS w FROM orders),
l AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) <= w AS late FROM orders, n),
z AS (SELECT seed, o_custkey, count(*) AS size FROM l, range(3) AS s(seed) WHERE late GROUP BY 1, 2),
v AS (SELECT seed, o_custkey, coalesce(sum(size) OVER (PARTITION BY seed ORDER BY {rank_sql('o_custkey::VARCHAR', 'seed::VARCHAR', "'dev'")}, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < (w + 1) // 2 AS dev FROM z, n),
r AS (SELECT l.*, s.seed, CASE WHEN v.dev THEN 'dev' ELSE 'train' END AS role FROM l CROSS JOIN range(3) AS s(seed) LEFT JOIN v ON v.seed = s.seed AND v.o_custkey = l.o_custkey),
p AS (SELECT *, role = 'train' AND row_number() OVER (PARTITION BY seed, role ORDER BY {rank_sql('o_orderkey::VARCHAR', 'seed::VARCHAR', "'checkpoint'")}, o_orderkey) <= 150 AS checkpoint FROM r)"""


def q_partition_overlap(spark, d):
    """Of each two seeds, the dev rows in common and in all."""
    dev = partitions(spark, d).where("role = 'dev'").select("seed", "o_orderkey")
    seeds = dev.groupBy("o_orderkey").agg(F.collect_set("seed").alias("s"))
    both = seeds.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    n = dev.groupBy("seed").agg(F.count("*").alias("n"))
    return both.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").select("a", "b", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("total"))


def docs(spark, d):
    return load(spark, d, "documents").select("doc_id")


def q_mask(spark, d):
    """A quarter of the documents, rounded down, is masked."""
    return S.item_mask(docs(spark, d), "doc_id", 1, 4, "mask", 0, whole=False)


def q_upsample(spark, d):
    """Documents upsampled to five thirds of their number, rounded down."""
    return S.upsample(docs(spark, d), "doc_id", F.floor(F.col("_n") * 5 / 3).cast("long"), "upsample", 0)


def q_run_order(spark, d):
    """Three shuffled passes over the documents, cut at two and a half."""
    rows = docs(spark, d)
    return S.run_order(rows, "doc_id", 3, rows.count() * 5 // 2, "order", 0)


def q_late_top(spark, d):
    """The latest fifth of the orders."""
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return S.latest(rows, ["o_orderdate", "o_orderkey"], S.ceil_share(rows.count(), 1, 5)).where("late").select("o_orderkey")


def q_step_median(spark, d):
    """Median seconds between an event and the one before of the same user, for users with three or more."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = load(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)).alias("gap"))
    return rows.where("gap IS NOT NULL").groupBy("user_id").agg(F.round(F.median("gap") / 1e6, 3).alias("median_s"), F.count("*").alias("n")).where("n >= 2")


def q_feasible_steps(spark, d):
    """The largest multiple of 4, up to 399, that fits each event type's budget; null under 48."""
    rows = load(spark, d, "events").groupBy("event_type").agg(F.sum(F.col("event_id") % 7 + 1).alias("cost"), F.count("*").alias("n"))
    best = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(396), F.lit(4)), lambda s: s * F.col("cost") <= F.col("n") * 700))
    return rows.select("event_type", F.when(best >= 48, best).alias("steps"))


def q_two_level_sample(spark, d):
    """Ten events of each type and parity of user by rank."""
    rows = load(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 2).alias("parity"))
    return S.lowest_ranked(rows, ["event_type", "parity"], "event_id", 10, "review").select("event_type", "parity", "event_id", "nth")


QUERIES = {f.__name__: f for f in (q_rank_sample, q_half_sample, q_seeded_shuffle_shards, q_weighted_draw, q_stratified_fill, q_temporal_holdout, q_cluster_safe_holdout, q_seed_partitions, q_partition_overlap, q_mask, q_upsample, q_run_order, q_late_top, q_step_median, q_feasible_steps, q_two_level_sample)}
DOC = "doc_id::VARCHAR"
ORACLES = {
    "q_rank_sample": f"SELECT lang, doc_id, rank, nth::INT AS nth, substr('ABCD', ({mod_sql('4', DOC, chr(39) + 'letter' + chr(39))} + 1)::INT, 1) AS letter FROM (SELECT lang, doc_id, {rank_sql(DOC, chr(39) + 'sample' + chr(39))} AS rank, row_number() OVER (PARTITION BY lang ORDER BY rank, doc_id) AS nth FROM documents) WHERE nth <= 100",
    "q_half_sample": f"SELECT doc_id, place, i::INT AS index FROM (SELECT doc_id, row_number() OVER (ORDER BY {rank_sql(DOC, chr(39) + 'half' + chr(39))}, doc_id) - 1 AS place FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), range(2) AS r(i) WHERE place < 200 AND (i = 0 OR place < 100)",
    "q_seeded_shuffle_shards": f"SELECT event_id, pos, (pos % 8)::INT AS shard FROM (SELECT event_id, row_number() OVER (ORDER BY {rank_sql('event_id::VARCHAR', chr(39) + 'shards' + chr(39))}, event_id) - 1 AS pos FROM events)",
    "q_weighted_draw": weighted_sql(3),
    "q_stratified_fill": f"WITH r AS (SELECT c_custkey, c_mktsegment, {rank_sql('c_custkey::VARCHAR', chr(39) + 'strata' + chr(39))} AS rank FROM customer), s AS (SELECT *, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') AND row_number() OVER (PARTITION BY c_mktsegment ORDER BY rank, c_custkey) <= 5 THEN c_mktsegment END AS stratum FROM r) SELECT c_custkey, c_mktsegment, stratum FROM (SELECT *, row_number() OVER (ORDER BY stratum IS NULL, rank, c_custkey) AS n FROM s) WHERE n <= 50",
    "q_temporal_holdout": f"WITH {HOLDOUT} SELECT o_orderkey, CASE WHEN day >= cut THEN 'test' ELSE 'nontest' END AS pool, false AS moved FROM o, c",
    "q_cluster_safe_holdout": f"WITH {HOLDOUT}, t AS (SELECT o_orderkey, day >= cut AS late, bool_and(day >= cut) OVER (PARTITION BY o_custkey % 97, strftime(o_orderdate, '%Y-%m')) AS whole FROM o, c) SELECT o_orderkey, CASE WHEN late AND whole THEN 'test' ELSE 'nontest' END AS pool, late AND NOT whole AS moved FROM t",
    "q_seed_partitions": f"WITH {PARTITIONS} SELECT seed::INT AS seed, role, checkpoint, late, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM p GROUP BY ALL",
    "q_partition_overlap": f"WITH {PARTITIONS}, x AS (SELECT seed, o_orderkey FROM p WHERE role = 'dev'), m AS (SELECT seed, count(*) AS n FROM x GROUP BY 1) SELECT a.seed::INT AS a, b.seed::INT AS b, count(*) AS shared, (any_value(na.n) + any_value(nb.n) - count(*))::BIGINT AS total FROM x a JOIN x b ON a.o_orderkey = b.o_orderkey AND a.seed < b.seed JOIN m na ON na.seed = a.seed JOIN m nb ON nb.seed = b.seed GROUP BY 1, 2",
    "q_mask": f"SELECT doc_id, row_number() OVER (ORDER BY {rank_sql(DOC, chr(39) + 'mask' + chr(39), chr(39) + '0' + chr(39))}, doc_id) <= count(*) OVER () // 4 AS masked FROM documents",
    "q_upsample": f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {rank_sql(DOC, chr(39) + 'upsample' + chr(39), chr(39) + '0' + chr(39))}, doc_id) AS place, count(*) OVER () AS n FROM documents), c AS (SELECT *, (n * 5 // 3) // n + CASE WHEN place <= (n * 5 // 3) % n THEN 1 ELSE 0 END AS copies FROM r) SELECT doc_id, i::INT AS copy FROM c, range(0, copies) AS g(i)",
    "q_run_order": f"WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, p::INT AS pass, row_number() OVER (ORDER BY p, {rank_sql(DOC, chr(39) + 'order' + chr(39), chr(39) + '0' + chr(39), 'p::VARCHAR')}, doc_id) - 1 AS pos FROM documents, range(3) AS g(p)) SELECT doc_id, pass, pos FROM r, n WHERE pos < n * 5 // 2",
    "q_late_top": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, count(*) OVER () AS n FROM orders) WHERE r <= (n + 4) // 5",
    "q_step_median": "SELECT user_id, round(median(gap) / 1e6, 3) AS median_s, count(*) AS n FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
    "q_feasible_steps": "WITH t AS (SELECT event_type, sum(event_id % 7 + 1) AS cost, count(*) AS n FROM events GROUP BY 1) SELECT event_type, (SELECT CASE WHEN max(s) >= 48 THEN max(s) END FROM range(0, 400, 4) AS g(s) WHERE s * cost <= n * 700)::INT AS steps FROM t",
    "q_two_level_sample": f"SELECT event_type, parity, event_id, nth::INT AS nth FROM (SELECT event_type, user_id % 2 AS parity, event_id, row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY {rank_sql('event_id::VARCHAR', chr(39) + 'review' + chr(39))}, event_id) AS nth FROM events) WHERE nth <= 10",
}
