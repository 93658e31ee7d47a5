"""Aggregates, inference and monitors; and extensions on events that go beyond the library's own operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import inference as I
from ..streaming import incremental as R
from ..tables import load
from .samples import mod_sql, rank_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


QS = [(0, 1), (1, 20), (1, 4), (1, 2), (3, 4), (19, 20), (99, 100), (1, 1)]


@query("WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents), q(a, b) AS (VALUES " + ", ".join(str(q) for q in QS) + ") SELECT lang, a::INT AS q_num, b::INT AS q_den, n_chars FROM r, q WHERE i = greatest(1, (a * n + b - 1) // b)")
def q_quantiles(spark, d):
    """Nearest-rank quantiles of characters by language."""
    return A.nearest_rank(load(spark, d, "documents"), ["lang"], "n_chars", QS)


@query("WITH l(pos, label) AS (VALUES (0, '1-5'), (1, '6-10'), (2, '11-20'), (3, '21-40'), (4, 'over')) SELECT label, pos::INT AS pos, (SELECT count(*) FROM lineitem WHERE CASE WHEN l_quantity <= 5 THEN 0 WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 20 THEN 2 WHEN l_quantity <= 40 THEN 3 ELSE 4 END = pos) AS count FROM l")
def q_histogram_edges(spark, d):
    return A.edge_histogram(load(spark, d, "lineitem"), F.col("l_quantity"), [5, 10, 20, 40], ["1-5", "6-10", "11-20", "21-40", "over"])


@query("WITH c AS (SELECT l_suppkey, l_returnflag AS mode, count(*) AS votes FROM lineitem WHERE l_returnflag IN ('R', 'N', 'A') GROUP BY 1, 2) SELECT l_suppkey, mode, votes FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, instr('RNA', mode)) AS r FROM c) WHERE r = 1")
def q_majority_components(spark, d):
    """Each supplier's most common return flag; ties in the order R, N, A."""
    return A.ordered_mode(load(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", "RNA")


@query("SELECT source, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, try_cast(regexp_extract(source, '[0-9]+') AS BIGINT) NULLS LAST, 1 LIMIT 15")
def q_top_labels(spark, d):
    return A.most_frequent(load(spark, d, "documents"), "source", 15)


@query("WITH t AS (SELECT lang, sum(quality)::DOUBLE AS k, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), z AS (SELECT *, 1.959963984540054 AS z, k / n AS p FROM t) SELECT lang, k::BIGINT AS hits, n::BIGINT AS n, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS high FROM z")
def q_wilson_by_group(spark, d):
    """The share of good documents by language with Wilson's interval."""
    rows = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("hits"), F.count("*").alias("n"))
    low, high = A.wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    return rows.select("lang", "hits", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT round(avg(l_quantity) FILTER (l_linestatus = 'O') - avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS difference, round(sqrt(var_samp(l_quantity) FILTER (l_linestatus = 'O') / count(*) FILTER (l_linestatus = 'O') + var_samp(l_quantity) FILTER (l_linestatus = 'F') / count(*) FILTER (l_linestatus = 'F')), 6) AS standard_error, count(*) FILTER (l_linestatus = 'O') AS n1, count(*) FILTER (l_linestatus = 'F') AS n2 FROM lineitem")
def q_two_groups(spark, d):
    out = A.two_groups(load(spark, d, "lineitem"), "l_linestatus", "l_quantity", "O", "F")
    return out.select(F.round("difference", 6).alias("difference"), F.round("standard_error", 6).alias("standard_error"), "n1", "n2")


@query("WITH y AS (SELECT DISTINCT year(o_orderdate) AS year, o_orderstatus FROM orders), b AS (SELECT year FROM y GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT o_orderstatus) FROM orders)) SELECT o_orderstatus, count(*) AS n, min(o_orderdate::DATE)::VARCHAR AS first, max(o_orderdate::DATE)::VARCHAR AS last, count(DISTINCT o_custkey) AS customers FROM orders WHERE year(o_orderdate) IN (SELECT year FROM b) GROUP BY 1")
def q_pool_statistics(spark, d):
    """Orders by status in the years in which every status occurs."""
    rows = load(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    kinds = rows.select("o_orderstatus").distinct().count()
    both = rows.groupBy("year").agg(F.count_distinct("o_orderstatus").alias("k")).where(F.col("k") == kinds)
    return rows.join(both, "year", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min(F.to_date("o_orderdate")).cast("string").alias("first"), F.max(F.to_date("o_orderdate")).cast("string").alias("last"), F.count_distinct("o_custkey").alias("customers"))


@query("WITH c AS (SELECT max(o_orderdate::DATE) - 120 AS cut FROM orders) SELECT DISTINCT o_custkey FROM orders, c WHERE o_orderdate::DATE >= cut AND o_custkey NOT IN (SELECT o_custkey FROM orders, c WHERE o_orderdate::DATE < cut)")
def q_unseen_labels(spark, d):
    """Customers of the last 120 days without an order before."""
    rows = load(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    cut = rows.agg(F.date_sub(F.max("day"), 120).alias("cut"))
    both = rows.crossJoin(F.broadcast(cut))
    return both.where("day >= cut").select("o_custkey").distinct().join(both.where("day < cut").select("o_custkey"), "o_custkey", "left_anti")


@query("WITH i AS (SELECT p_partkey, p_brand AS gold, [p_brand, p_type, 'size' || (p_size % 7)] AS o FROM part), f AS (SELECT x, count(*) AS f FROM i, unnest(o) AS u(x) GROUP BY 1), s AS (SELECT p_partkey, any_value(gold) AS gold, list(x) FILTER (f.f = m) AS best FROM (SELECT p_partkey, gold, x, f, max(f) OVER (PARTITION BY p_partkey) AS m FROM i, unnest(o) AS u(x) JOIN f USING (x)) AS f GROUP BY 1) SELECT len(best)::INT AS ties, count(*) AS n, sum(list_contains(best, gold)::INT)::BIGINT AS hits FROM s GROUP BY 1")
def q_shortcut_guard(spark, d):
    """Parts with three options: how often the most frequent option is the brand."""
    rows = load(spark, d, "part").select("p_partkey", F.col("p_brand").alias("gold"), F.array("p_brand", "p_type", F.concat(F.lit("size"), (F.col("p_size") % 7).cast("string"))).alias("options"))
    return A.shortcut_share(rows, "p_partkey", "options", "gold")


@query("WITH g AS (SELECT user_id, event_type, min(floor(value / 20)) <> max(floor(value / 20)) AS live FROM events GROUP BY 1, 2) SELECT event_type, sum(live::INT)::BIGINT AS live, count(*) AS n, CASE WHEN sum(live::INT) * 2 >= count(*) THEN 'as_specified' WHEN sum(live::INT) * 10 >= count(*) THEN 'dynamic_sampling' ELSE 'floored' END AS band FROM g GROUP BY 1")
def q_live_groups(spark, d):
    """Users' groups of events of a type that don't all score the same."""
    rows = load(spark, d, "events").select("user_id", "event_type", F.floor(F.col("value") / 20).alias("score"))
    out = A.live_groups(rows, ["user_id", "event_type"], "score").groupBy("event_type").agg(F.sum(F.col("live").cast("long")).alias("live"), F.count("*").alias("n"))
    return out.withColumn("band", A.band(F.col("live"), F.col("n")))


@query("WITH c AS (SELECT event_type, cap, count(*) FILTER (value > cap) AS n_cut, count(*) AS n FROM events, (VALUES (50), (100), (200), (400)) AS v(cap) GROUP BY 1, 2) SELECT event_type, coalesce(min(CASE WHEN n_cut * 10 <= n THEN cap END), max(cap))::INT AS cap FROM c GROUP BY 1")
def q_cap_choice_band(spark, d):
    """The smallest cap that cuts off a tenth of a type's events at most."""
    rows = load(spark, d, "events").select("event_type", "value").withColumn("cap", F.explode(F.array(*[F.lit(c) for c in (50, 100, 200, 400)])))
    cut = rows.groupBy("event_type", "cap").agg(F.sum((F.col("value") > F.col("cap")).cast("long")).alias("n_cut"), F.count("*").alias("n"))
    return A.cap_choice(cut, ["event_type"])


@query("SELECT l_orderkey, min((l_returnflag <> 'R')::INT)::INT AS unit, count(*) AS items FROM lineitem GROUP BY 1")
def q_unit_scores(spark, d):
    """Orders whose lines are all kept."""
    return A.unit_scores(load(spark, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") != "R").alias("right")), ["l_orderkey"], "right")


def answers(spark, d):
    """Each labelled document's quality as the answer and whether it is clean as the gold."""
    return load(spark, d, "labels").select("doc_id", F.col("quality").alias("answer"), (1 - F.col("toxic")).alias("gold"))


@query("SELECT sum((quality = 1 - toxic)::INT)::BIGINT AS hits, (sum(quality) * sum(1 - toxic) + sum(1 - quality) * sum(toxic) - sum((quality = 1 - toxic)::INT))::BIGINT AS pairs, count(*) AS n FROM labels")
def q_observed_control(spark, d):
    return I.observed_and_control(answers(spark, d), "answer", "gold")


@query(f"WITH r AS (SELECT doc_id, quality, 1 - toxic AS gold, p, row_number() OVER (PARTITION BY p ORDER BY doc_id) AS i, row_number() OVER (PARTITION BY p ORDER BY {rank_sql('doc_id::VARCHAR', chr(39) + 'perm' + chr(39), 'p::VARCHAR')}, doc_id) AS j FROM labels, range(100) AS g(p)), h AS (SELECT a.p, sum((a.quality = b.gold)::INT) AS hits FROM r a JOIN r b ON a.p = b.p AND a.i = b.j GROUP BY 1) SELECT sum((hits >= (SELECT sum((quality = 1 - toxic)::INT) FROM labels))::INT)::BIGINT + 1 AS p_num, count(*) + 1 AS p_den FROM h")
def q_permutation_p(spark, d):
    """A hundred permutations of the gold."""
    rows = answers(spark, d)
    return I.permutation_p(I.permutation_hits(rows, "doc_id", "answer", "gold", 100), I.observed_and_control(rows, "answer", "gold"))


@query(f"WITH n AS (SELECT quality AS v, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels), s AS (SELECT r, i, {mod_sql('n', chr(39) + 'boot' + chr(39), 'r::VARCHAR', 'i::VARCHAR')} AS k FROM n, range(200) AS g(r)), t AS (SELECT r, sum(v) AS total FROM s JOIN n ON n.i = s.k GROUP BY 1), o AS (SELECT total, row_number() OVER (ORDER BY total) - 1 AS z FROM t) SELECT max(total) FILTER (z = 5)::BIGINT AS low, max(total) FILTER (z = 194)::BIGINT AS high FROM o")
def q_bootstrap_ci(spark, d):
    """The interval of the number of good documents over 200 resamples."""
    rows = load(spark, d, "labels").select("doc_id", "quality")
    return I.percentile_interval(I.bootstrap_sums(rows, "doc_id", "quality", 200), "total", 200)


INTERACTION = "r AS (SELECT event_type AS arm, user_id % 5 AS col, event_id % 4 AS seed, avg(value) AS v FROM events GROUP BY ALL), sd AS (SELECT col, sqrt(avg(v)) AS sd FROM (SELECT col, arm, var_samp(v) AS v FROM r GROUP BY ALL) GROUP BY 1), c AS (SELECT arm, col, avg(v) / any_value(sd) AS m FROM r JOIN sd USING (col) GROUP BY 1, 2), x AS (SELECT arm, col, m - avg(m) OVER (PARTITION BY arm) - avg(m) OVER (PARTITION BY col) + avg(m) OVER () AS residual FROM c)"


@query(f"WITH {INTERACTION} SELECT arm, col, round(residual, 6) AS residual, round(sum(residual * residual) OVER (), 5) AS t FROM x")
def q_interaction_T(spark, d):
    """Residuals of event types by groups of users, in units of the pooled SD, and the sum of their squares."""
    runs = load(spark, d, "events").groupBy(F.col("event_type").alias("arm"), (F.col("user_id") % 5).alias("col"), (F.col("event_id") % 4).alias("seed")).agg(F.avg("value").alias("v"))
    cells = I.interaction(runs, "arm", "col", "v")
    return cells.select("arm", "col", F.round("residual", 6).alias("residual"), F.round(F.sum(F.col("residual") * F.col("residual")).over(Window.partitionBy(F.lit(0))), 5).alias("t"))


@query("SELECT (floor((event_id // 100) / 10))::INT AS window, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, round(avg((value > 20)::INT), 6) AS parse_rate, CASE WHEN sum((value > 180)::INT) * 10 < count(*) THEN 'below_floor' WHEN greatest(avg((value > 20)::INT), 1 - avg((value > 20)::INT)) > 0.9 THEN 'collapse' END AS event FROM events GROUP BY 1, 2")
def q_monitor_windows(spark, d):
    """Windows of ten steps of a hundred events, and their threshold events."""
    rows = load(spark, d, "events").select((F.floor(F.col("event_id") / 100) + 1).alias("step"), "event_type", "value", (F.col("value") > 20).alias("parsed"), (F.col("value") > 180).alias("alive"))
    w = R.step_windows(rows, F.col("step"), 10, ["event_type"], "value", "parsed")
    live = rows.groupBy(F.floor((F.col("step") - 1) / 10).cast("int").alias("window"), "event_type").agg(F.sum(F.col("alive").cast("long")).alias("live"))
    out = R.events(w.join(live, ["window", "event_type"]), "live", "n", "parse_rate")
    return out.select("window", "event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("parse_rate", 6).alias("parse_rate"), "event")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling(spark, d):
    """Extension: events by hour and type."""
    out = R.tumbling(load(spark, d, "events"), "ts", "1 hour", "10 minutes", ["event_type"])
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("WITH s AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS start FROM events, range(2) AS g(i)) SELECT start::VARCHAR AS start, count(*) AS n FROM s GROUP BY 1")
def ext_sliding(spark, d):
    """Extension: hours that begin every half hour."""
    return load(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("WITH m AS (SELECT user_id, ts, event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 1800000000, true)::INT AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM m) SELECT user_id, s::BIGINT AS session, count(*) AS n FROM s GROUP BY 1, 2")
def ext_session(spark, d):
    """Extension: users' sessions, ended by half an hour without an event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = load(spark, d, "events").withColumn("b", F.coalesce((us - F.lag(us).over(w) >= 1_800_000_000).cast("int"), F.lit(1)))
    return rows.withColumn("session", F.sum("b").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS viewed FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT p.event_id, v.viewed FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts")
def ext_asof(spark, d):
    """Extension: each purchase with the user's latest view up to it, by one pass over both in order of time."""
    rows = load(spark, d, "events").where("event_type IN ('purchase', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))).over(w)["event_id"]
    return rows.select("event_id", "event_type", last.alias("viewed")).where("event_type = 'purchase'").select("event_id", "viewed")
