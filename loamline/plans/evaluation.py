"""Scores, margins and runs on analogues in the driver's tables."""

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregate as A
from ..operators import bootstrap as P
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import inference as I
from ..operators import jobs as W
from ..operators import ledger as L
from ..operators import runs as R
from ..operators import sampling as S
from ..operators import schedule as Q
from ..tables import load
from .bank import nation
from .curation import CHECKS, FATE, checks
from .hierarchies import RELATION, edges
from .samples import mod_sql, rank_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def events(spark, d):
    return load(spark, d, "events")


@query("WITH k AS (SELECT event_type, user_id, event_id % 4 AS k FROM events), c AS (SELECT event_type AS source, 'mcq' AS type, CASE k WHEN 0 THEN 'parse_failure' WHEN 2 THEN 'no_field' WHEN 3 THEN 'lenient_not_strict' END AS category FROM k) SELECT source, type, category, count(*) AS n FROM c WHERE category IS NOT NULL GROUP BY ALL")
def q_parser_review(spark, d):
    """Synthetic replies that want a look, by category."""
    k = F.col("event_id") % 4
    text = F.when(k == 0, "no idea").when(k == 1, "ANSWER: B").when(k == 2, "(B)").otherwise("so: answer: B")
    v = F.struct((k != 0).alias("parse_ok"), (k == 1).alias("strict_ok"), F.when(k != 0, "B").alias("parsed"))
    rows = events(spark, d).select(F.col("event_type").alias("source"), "event_id", F.lit("mcq").alias("type"), text.alias("text"), F.lit("stop").alias("finish"), v.alias("v"))
    return E.parser_review(rows, ["event_id"], "type", "text", "finish", "v", 10, F.col("event_id"))[0]


@query("SELECT 'frozen verdict' AS \"check\", event_id::VARCHAR AS key, CASE event_type WHEN 'view' THEN 'gone' WHEN 'click' THEN 'new' ELSE 'changed' END AS message FROM events WHERE event_type IN ('view', 'click') OR value > 150")
def q_parser_guard(spark, d):
    """Frozen verdicts against fresh ones: those on views have gone, those on clicks come, those on high values changed."""
    v = lambda c: F.struct(c.alias("metric"))
    e = events(spark, d)
    old = e.where("event_type <> 'click'").select("event_id", v(F.lit(1)).alias("v"))
    new = e.where("event_type <> 'view'").select("event_id", v(F.when(F.col("value") > 150, 2).otherwise(1)).alias("v"))
    return E.parser_guard(old, new, "event_id")


@query("""WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS pos, list_transform(range(12), lambda i: (event_id * (i + 3)) % 7) AS ids FROM events),
c AS (SELECT *, cap, ids[1:cap] AS h FROM o, (VALUES (4), (8), (12)) AS v(cap)), s AS (SELECT user_id, event_type, cap, coalesce(list_position(h, 3), 0) = 0 AS cut, CASE WHEN coalesce(list_position(h, 3), 0) > 0 THEN list_position(h, 3) ELSE cap END AS score FROM c),
g AS (SELECT event_type, cap, user_id, count(*) AS n, count(*) FILTER (cut) AS n_cut, min(score) <> max(score) AS live FROM s GROUP BY 1, 2, 3)
SELECT event_type, cap::INT AS cap, sum(n)::BIGINT AS n, sum(n_cut)::BIGINT AS n_cut, count(*) AS groups, count(*) FILTER (live) AS live FROM g GROUP BY 1, 2""")
def q_audit_caps(spark, d):
    """Users' rollouts of each type at three caps: how many are cut, and how many groups don't all score the same."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (F.col("event_id") * (i + 3)) % 7)
    rows = events(spark, d).groupBy("user_id", "event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", ids.alias("ids")))), lambda x: x["ids"]).alias("outputs"))
    return E.audit(rows, "user_id", "event_type", "outputs", [4, 8, 12], 3, lambda i, cut: F.size(i))[1]


@query("WITH u AS (SELECT event_type, user_id, avg(floor(value)) FILTER (event_id % 2 = 0) AS x, avg(floor(value)) FILTER (event_id % 2 = 1) AS y FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(y) - avg(x), 6) AS gap, count(*) FILTER (y > x) AS y_better, count(*) FILTER (x > y) AS x_better FROM u WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1")
def q_engine_gap(spark, d):
    """Even against odd events of users, as two engines, by type."""
    s = events(spark, d).groupBy("event_type", "user_id", (F.col("event_id") % 2).alias("engine")).agg(F.avg(F.floor("value").cast("double")).alias("v"))
    both = s.groupBy("event_type", "user_id").count().where("count = 2").drop("count")
    out = E.engine_gap(s.join(both, ["event_type", "user_id"], "left_semi"), "event_type", "user_id", "engine", "v", 0, 1)
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean_x", "mean_y", "gap")], "y_better", "x_better")


@query("WITH a AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS n_first, count(*) FILTER (event_type = 'click') AS n_second FROM events GROUP BY 1) SELECT * FROM a WHERE n_first <> n_second")
def q_same_requests(spark, d):
    """Users who viewed more or less often than they clicked: where two engines' requests aren't a permutation."""
    return E.same_requests(events(spark, d), "event_type", "user_id", "view", "click")


@query("SELECT CASE max(CASE WHEN n > 3000 THEN 2 WHEN n > 1000 THEN 1 ELSE 0 END) WHEN 2 THEN 'large' WHEN 1 THEN 'material' ELSE 'not detected' END AS outcome FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def q_worst_outcome(spark, d):
    rows = events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    return E.worst_outcome(rows.select(F.when(F.col("n") > 3000, "large").when(F.col("n") > 1000, "material").otherwise("not detected").alias("o")), "o")


@query(f"WITH {RELATION}, l AS (SELECT 'N' || c_nationkey AS gold, count(*) AS c FROM customer GROUP BY 1) SELECT sum(c)::BIGINT AS n, coalesce(sum(c) FILTER (gold = 'N3'), 0)::BIGINT AS exact, sum(c * coalesce((SELECT CASE relation WHEN 'exact' THEN 8 WHEN 'child' THEN 4 WHEN 'ancestor_2' THEN 1 ELSE 2 END FROM rel WHERE pred = 'N3' AND rel.gold = l.gold), 0))::BIGINT AS units, (SELECT gold FROM l ORDER BY c DESC, substr(gold, 2)::INT LIMIT 1) AS own_best, max(c) AS own_n FROM l")
def q_constant_baselines(spark, d):
    """What nation 3 earns as the answer for every customer, directed credit, and the most frequent nation."""
    golds = load(spark, d, "customer").select(nation().alias("gold"))
    return E.constant_baselines(golds, "gold", F.lit("N3"), G.relations(edges(spark, d), golds=golds.select("gold")), G.credit(F.col("relation"), G.DIRECTED))


VOTES = {"flag": "l_returnflag", "status": "l_linestatus", "few": "CASE WHEN l_quantity < 25 THEN 'y' ELSE 'n' END"}
REFERENCE = {"flag": "N", "status": "O", "few": "y"}


def votes(spark, d):
    parts = {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "few": F.when(F.col("l_quantity") < 25, "y").otherwise("n")}
    m = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)])
    return A.agreement(load(spark, d, "lineitem").select(m.alias("m")), "m", F.create_map(*[F.lit(x) for kv in REFERENCE.items() for x in kv]), tuple(REFERENCE))


@query(f"WITH x AS (SELECT ({' + '.join(f'({c} = {chr(39)}{REFERENCE[k]}{chr(39)})::INT' for k, c in VOTES.items())}) / 3 AS x FROM lineitem), a AS (SELECT count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM x) SELECT n, round(m, 8) AS mean, round(v, 8) AS var, round(m - 1.959963984540054 * sqrt(v / n), 8) AS low, round(m + 1.959963984540054 * sqrt(v / n), 8) AS high FROM a")
def q_reference_agreement(spark, d):
    """How far lines agree with a reference vector of three components."""
    return votes(spark, d)[0].select("n", *[F.round(c, 8).alias(c) for c in ("mean", "var", "low", "high")])


@query("WITH h AS (" + " UNION ALL ".join(f"SELECT '{k}' AS component, count(*) FILTER ({c} = '{REFERENCE[k]}') AS hits, count(*) AS n FROM lineitem" for k, c in VOTES.items()) + "), z AS (SELECT *, hits / n AS p, 1.959963984540054 AS z FROM h) SELECT component, hits, n, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS high FROM z")
def q_component_agreement(spark, d):
    return votes(spark, d)[1].select("component", "hits", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"WITH {RELATION}, l AS (SELECT 'N' || c_nationkey AS gold, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT pred, sum(n * CASE relation WHEN 'exact' THEN 8 WHEN 'child' THEN 4 WHEN 'parent' THEN 4 ELSE 2 END)::BIGINT AS eighths FROM rel JOIN l USING (gold) GROUP BY 1) SELECT max(eighths) AS eighths, (SELECT sum(n)::BIGINT FROM l) AS total, CASE WHEN max(eighths) * 5 > (SELECT sum(n) FROM l) * 8 THEN 'direction_aware' ELSE 'symmetric' END AS decision FROM s")
def q_decided_schedule(spark, d):
    """Whether the best constant earns more than a fifth, which decides the schedule of credit."""
    labels = load(spark, d, "customer").groupBy(nation().alias("gold")).agg(F.count("*").alias("n"))
    best = A.best_constant(labels, G.relations(edges(spark, d), golds=labels), G.credit(F.col("relation")), 1)
    return best.select("eighths", "total", A.decided_schedule(F.col("eighths"), F.col("total")).alias("decision"))


ANSWERS = "a AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'N' || c_nationkey WHEN 2 THEN 'R' || (c_nationkey % 5) ELSE 'N' || (c_custkey % 25) END AS answer, 'N' || c_nationkey AS gold FROM customer)"
UNITS = "CASE relation WHEN 'exact' THEN 8 WHEN 'child' THEN 4 WHEN 'ancestor_2' THEN 1 ELSE 2 END"


def answers(spark, d):
    k = F.col("c_custkey") % 5
    said = F.when(k == 1, nation()).when(k == 2, F.concat(F.lit("R"), (F.col("c_nationkey") % 5).cast("string"))).when(k > 2, F.concat(F.lit("N"), (F.col("c_custkey") % 25).cast("string")))
    return load(spark, d, "customer").select("c_custkey", said.alias("answer"), nation().alias("gold"))


def matrix(spark, d):
    """Directed credit of answers that are given for golds that there are."""
    rows = answers(spark, d)
    r = G.relations(edges(spark, d), preds=rows.where("answer IS NOT NULL").select("answer").distinct(), golds=rows.select("gold").distinct()).withColumn("units", G.credit(F.col("relation"), G.DIRECTED).cast("long"))
    return r.select(F.col("pred").alias("answer"), "gold", "units")


@query(f"WITH {RELATION}, {ANSWERS}, u AS MATERIALIZED (SELECT pred, gold, {UNITS} AS u FROM rel), na AS (SELECT answer, count(*) AS na FROM a WHERE answer IS NOT NULL GROUP BY 1), ng AS (SELECT gold, count(*) AS ng FROM a GROUP BY 1), h AS (SELECT coalesce(sum(u), 0)::BIGINT AS hits FROM a JOIN u ON u.pred = answer AND u.gold = a.gold), p AS (SELECT coalesce(sum(na * ng * u), 0)::BIGINT AS p FROM u JOIN na ON pred = answer JOIN ng ON ng.gold = u.gold) SELECT hits, p - hits AS pairs, (SELECT count(*) FROM a) AS n FROM h, p")
def q_credit_control(spark, d):
    """Directed credit of customers' answers against their own nations and against all others'."""
    return I.observed_and_control(answers(spark, d), "answer", "gold", matrix(spark, d))


@query()
def q_credit_permutation(spark, d):
    """The p-value of that credit over 10,000 deals of the golds."""
    rows, m = answers(spark, d), matrix(spark, d)
    return I.permutation_p(I.permuted_units(rows, "answer", "gold", 10_000, m), I.observed_and_control(rows, "answer", "gold", m), "units")


@query()
def q_probe(spark, d):
    """Exact and credited measures of customers' answers, each with its test over 10,000 permutations, and the worst class of both."""
    rows = answers(spark, d)
    return W.probe({"exact": (rows, None, 1), "credit": (rows, matrix(spark, d), 8)}, ["exact", "credit"])


@query()
def q_engine_report(spark, d):
    """Even against odd events of users by type, with intervals over 10,000 resamples."""
    s = events(spark, d).groupBy("event_type", "user_id", (F.col("event_id") % 2).alias("engine")).agg(F.avg(F.floor("value").cast("double")).alias("v"))
    both = s.groupBy("event_type", "user_id").count().where("count = 2").drop("count")
    kinds = [r.event_type for r in events(spark, d).select("event_type").distinct().orderBy("event_type").collect()]
    return W.engine_report(s.join(both, ["event_type", "user_id"], "left_semi"), "event_type", "user_id", "engine", "v", 0, 1, kinds)


@query("SELECT t.event_type, s::BIGINT AS seed, e.top IS NOT NULL AS available, e.top FROM (VALUES ('view'), ('click'), ('purchase'), ('refund')) AS t(event_type) CROSS JOIN range(8) AS g(s) LEFT JOIN (SELECT event_type, user_id % 8 AS seed, max(floor(value))::BIGINT AS top FROM events GROUP BY 1, 2) e ON e.event_type = t.event_type AND e.seed = s")
def q_availability(spark, d):
    """A grid of types and seeds with their highest value, where there is one."""
    grid = spark.createDataFrame([(t, s) for t in ("view", "click", "purchase", "refund") for s in range(8)], "event_type string, seed long")
    got = events(spark, d).groupBy("event_type", (F.col("user_id") % 8).alias("seed")).agg(F.max(F.floor("value")).alias("top"))
    return W.availability(grid, got, ["event_type", "seed"]).select("event_type", "seed", "available", "top")


@query("SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS nth, event_type AS finish FROM events")
def q_flat_outputs(spark, d):
    """Users' events as outputs of one request, flattened again."""
    g = events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("finish")))).alias("o"))
    return W.flat_outputs(g, "user_id", "o").select("user_id", "nth", "finish")


@query()
def q_margin_interval(spark, d):
    """The 95% interval of that margin over 2,000 resamples."""
    return I.percentile_interval(I.margin_resamples(answers(spark, d), "answer", "gold", 2000, 8, matrix(spark, d)), "margin", 2000)


@query()
def q_paired_bootstrap(spark, d):
    """The 99% interval of users' mean difference between even and odd events over 10,000 resamples, and whether the gap is material."""
    s = events(spark, d).groupBy("user_id").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.floor("value"))).alias("x"), F.avg(F.when(F.col("event_id") % 2 == 1, F.floor("value"))).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").select((F.col("y") - F.col("x")).alias("difference"))
    ends = I.percentile_interval(I.paired_resamples(s, "difference", 10_000), "mean", 10_000, (5, 1000), (995, 1000))
    return ends.crossJoin(s.agg(F.avg("difference").alias("gap"))).withColumn("material", I.material(F.col("gap"), F.col("low"), F.col("high")))


@query("SELECT c_custkey, abs(g) * 100 >= 1 AND (lo > 0 OR hi < 0) AS material FROM (SELECT c_custkey, c_acctbal / 1e5 AS g, c_acctbal / 1e5 - 0.02 AS lo, c_acctbal / 1e5 + 0.02 AS hi FROM customer)")
def q_material(spark, d):
    """The material rule on customers' balances with a margin."""
    g = F.col("c_acctbal") / 1e5
    return load(spark, d, "customer").select("c_custkey", I.material(g, g - 0.02, g + 0.02).alias("material"))


SCORES = "s AS (SELECT event_type AS arm, kind, seed, user_id AS unit, i, ((user_id + seed + i + length(event_type)) % 3)::BIGINT AS num FROM (SELECT DISTINCT event_type, user_id FROM events), (VALUES ('pair', 0), ('pair', 1), ('single', 0)) AS k(kind, i), (VALUES (0), (1)) AS z(seed))"


def score_rows(spark, d):
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("i")) for k, i in (("pair", 0), ("pair", 1), ("single", 0))])
    e = events(spark, d).select("event_type", "user_id").distinct().withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("k", F.explode(kinds))
    num = (F.col("user_id") + F.col("seed") + F.col("k.i") + F.length("event_type")) % 3
    return e.select(F.col("event_type").alias("arm"), "seed", F.concat_ws(":", F.col("user_id").cast("string"), "k.kind", F.col("k.i").cast("string")).alias("item_id"), num.cast("long").alias("num"), F.lit(2).cast("long").alias("den"))


@query(f"WITH {SCORES} SELECT arm, kind, seed, unit::VARCHAR AS unit, CASE kind WHEN 'pair' THEN (min((num = 2)::INT))::DOUBLE ELSE max(num / 2) END AS score FROM s WHERE arm IN ('view', 'click') GROUP BY arm, kind, seed, unit")
def q_collected_scores(spark, d):
    """Scores of items as one score for each unit; of pairs whether both are right."""
    return I.collected_scores(score_rows(spark, d), ["view", "click"], {"pair": 2, "single": 1})


@query("WITH r AS (SELECT event_type AS arm, user_id % 5 AS col, event_id % 4 AS seed, CASE WHEN user_id % 5 = 3 THEN 1 ELSE count(*) END AS v FROM events GROUP BY event_type, user_id % 5, event_id % 4) SELECT col FROM (SELECT col, arm, min(v) = max(v) AS same FROM r GROUP BY 1, 2) GROUP BY 1 HAVING bool_and(same)")
def q_spreadless(spark, d):
    """Groups of users in which no type's counts differ between seeds."""
    runs = events(spark, d).groupBy(F.col("event_type").alias("arm"), (F.col("user_id") % 5).alias("col"), (F.col("event_id") % 4).alias("seed")).agg(F.count("*").alias("n"))
    return I.spreadless(runs.withColumn("v", F.when(F.col("col") == 3, F.lit(1)).otherwise(F.col("n"))), "arm", "col", "v")


@query("WITH u AS (SELECT user_id, k.kind, CASE k.kind WHEN 'n' THEN count(*) ELSE max(floor(value)) END AS v FROM events, (VALUES ('n'), ('top')) AS k(kind) GROUP BY 1, 2) SELECT user_id, round((max(v) FILTER (kind = 'n') / 2.5 + max(v) FILTER (kind = 'top') / 40) / 2, 6) AS score FROM u GROUP BY 1")
def q_standardised(spark, d):
    """Users' counts and highest values over scales of their own, averaged."""
    u = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.floor("value")).alias("top"))
    rows = u.select("user_id", F.explode(F.array(F.struct(F.lit("n").alias("kind"), F.col("n").cast("double").alias("v")), F.struct(F.lit("top").alias("kind"), F.col("top").cast("double").alias("v")))).alias("x")).select("user_id", "x.*")
    scale = spark.createDataFrame([("n", 2.5), ("top", 40.0)], "kind string, scale double")
    return I.standardised(rows, "user_id", "kind", "v", scale).select("user_id", F.round("score", 6).alias("score"))


@query("SELECT event_type, CASE WHEN event_type IN ('view', 'click') THEN 1::BIGINT ELSE 2 END AS run FROM (SELECT DISTINCT event_type FROM events)")
def q_frozen_choice(spark, d):
    """Choices of runs, two of which are stored already."""
    chosen = events(spark, d).select("event_type").distinct().select("event_type", F.when(F.col("event_type").isin("view", "click"), 1).otherwise(2).cast("long").alias("run"))
    return I.frozen_choice(chosen, chosen.where("run = 1"), ["event_type"], "run")


def matrix_of(spark, d):
    rows = events(spark, d).groupBy(F.col("event_type").alias("arm"), (F.col("user_id") % 5).alias("col"), (F.col("event_id") % 4).alias("seed")).agg(F.avg("value").alias("v")).orderBy("arm", "col", "seed").collect()
    arms = sorted({r.arm for r in rows})
    return arms, np.array([r.v for r in rows]).reshape(len(arms), 5, -1)


@query()
def q_interaction_test(spark, d):
    """The test of interaction between event types and groups of users: T, p and each cell's share, over 10,000 simulated experiments."""
    arms, y = matrix_of(spark, d)
    out = I.interaction_test(y)
    rows = [(a, j, float(out["T"]), float(out["p"]), float(out["residuals"][i, j]), float(out["contributions"][i, j])) for i, a in enumerate(arms) for j in range(y.shape[1])]
    return spark.createDataFrame(rows, "arm string, col int, t double, p double, residual double, contribution double")


@query()
def q_minimal_effect(spark, d):
    """The least effect on each group of users that the test would find with a power of 0.8, over 1,000 simulations."""
    found = I.minimal_effect(matrix_of(spark, d)[1])["minimal_effect"]
    return spark.createDataFrame([(j, x) for j, x in enumerate(found)], "col int, effect double")


# Jobs in order, each put on the machine that is free first; m: the machine, counted from 1.
DEALT = """o AS (SELECT *, row_number() OVER (ORDER BY hours DESC, job) AS i FROM j), g AS (SELECT list(hours ORDER BY i) AS hs FROM o),
r(i, free, m) AS (SELECT 0, [0.0, 0.0, 0.0]::DOUBLE[], NULL::INT UNION ALL
  SELECT r.i + 1, list_transform(free, lambda f, k: CASE WHEN k = list_position(free, list_min(free)) THEN f + hs[r.i + 1] ELSE f END), list_position(free, list_min(free))::INT FROM r, g WHERE r.i < len(hs)),
p AS (SELECT job, hours, r.m - 1 AS machine, r.free[r.m] - hours AS start FROM o JOIN r ON r.i = o.i)"""


@query(f"WITH RECURSIVE j AS (SELECT c_custkey AS job, (c_nationkey % 7 + 1) * 0.25::DOUBLE AS hours FROM customer WHERE c_custkey % 5 = 0), {DEALT} SELECT job, machine, start FROM p")
def q_list_schedule(spark, d):
    """Customers as jobs of seven durations, longest first, on three machines."""
    jobs = load(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("job"), ((F.col("c_nationkey") % 7 + 1) * 0.25).alias("hours"))
    return Q.list_schedule(jobs, "job", "hours", [], 3).select("job", "machine", "start")


@query(f"WITH RECURSIVE j AS (SELECT lpad(n_nationkey::VARCHAR, 2, '0') || '/' || s AS job, n_nationkey, s AS seed, (n_regionkey + 1) * 1.5::DOUBLE AS hours FROM nation, range(4) AS r(s) WHERE (n_nationkey + s) % 3 <> 0), {DEALT}, f AS (SELECT max(start + hours) AS finish FROM p) SELECT n_nationkey, seed::INT AS seed, j.hours, machine, start, finish, finish > 80 AS over_budget FROM p JOIN j USING (job), f")
def q_remaining_work(spark, d):
    """What is left of a grid of nations and seeds on three machines, and whether it would be over within 80 hours."""
    n = load(spark, d, "nation")
    grid = n.select("n_nationkey", "n_regionkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seed"))
    hours = n.select("n_regionkey").distinct().withColumn("hours", (F.col("n_regionkey") + 1) * 1.5)
    out = Q.remaining_work(grid, grid.where("(n_nationkey + seed) % 3 = 0"), ["n_nationkey", "seed"], hours, "n_regionkey", ["n_nationkey", "seed"], 3, 80.0)
    return out.select("n_nationkey", "seed", "hours", "machine", "start", "finish", "over_budget")


THREE = "s AS (SELECT event_type, user_id, event_id % 3 AS engine, avg(floor(value)) AS v FROM events GROUP BY ALL), f AS (SELECT event_type, user_id FROM s GROUP BY ALL HAVING count(*) = 3), w AS (SELECT event_type, user_id, max(v) FILTER (engine = 0) AS a, max(v) FILTER (engine = 1) AS b, max(v) FILTER (engine = 2) AS c FROM s JOIN f USING (event_type, user_id) GROUP BY ALL), x AS (SELECT event_type, 0 AS first, 2 AS second, a AS x, c AS y FROM w UNION ALL SELECT event_type, 0, 1, a, b FROM w)"


@query(f"WITH {THREE} SELECT first, second, event_type, count(*) AS n, round(avg(x), 6) AS mean_first, round(avg(y), 6) AS mean_second, round(avg(y - x), 6) AS gap, count(*) FILTER (y > x) AS second_better, count(*) FILTER (x > y) AS first_better, true AS inside, second = 2 AS decides FROM x GROUP BY ALL")
def q_three_engines(spark, d):
    """Events by type taken as replies of three engines: the pair that decides and the pair that shows noise; whether each gap is inside its interval of 1,000 resamples."""
    s = events(spark, d).groupBy("event_type", "user_id", (F.col("event_id") % 3).cast("int").alias("engine")).agg(F.avg(F.floor("value").cast("double")).alias("v"))
    full = s.groupBy("event_type", "user_id").count().where("count = 3").drop("count")
    out = P.engine_comparisons(s.join(full, ["event_type", "user_id"], "left_semi"), "event_type", "user_id", "engine", "v", [(0, 2), (0, 1)], 1000)
    rounded = [F.round(c, 6).alias(c) for c in ("mean_first", "mean_second", "gap")]
    return out.select("first", "second", "event_type", "n", *rounded, "second_better", "first_better", ((F.col("low") <= F.col("gap")) & (F.col("gap") <= F.col("high"))).alias("inside"), "decides")


@query("WITH u AS (SELECT user_id, event_id % 2 AS run, count(*) / 2.5 AS a, max(floor(value)) / 40 AS b FROM events GROUP BY 1, 2), f AS (SELECT user_id FROM u GROUP BY 1 HAVING count(*) = 2), x AS (SELECT user_id, (max((a + b) / 2) FILTER (run = 1)) - (max((a + b) / 2) FILTER (run = 0)) AS d FROM u JOIN f USING (user_id) GROUP BY 1) SELECT round(avg(d), 6) AS difference, count(*) AS units, true AS inside FROM x")
def q_standardised_gap(spark, d):
    """Odd against even events of users as two runs: the standardised difference, and whether it is inside its interval over users."""
    u = events(spark, d).groupBy("user_id", (F.col("event_id") % 2).alias("run")).agg(F.count("*").cast("double").alias("n"), F.max(F.floor("value")).cast("double").alias("top"))
    full = u.groupBy("user_id").count().where("count = 2").select("user_id")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in ("n", "top")])
    rows = u.join(full, "user_id", "left_semi").select("user_id", "run", F.explode(kinds).alias("x")).select("user_id", "run", "x.*")
    scale = spark.createDataFrame([("n", 2.5), ("top", 40.0)], "kind string, scale double")
    out = P.standardised_gap(rows, "user_id", "kind", "run", "v", scale, 0, 1)
    return out.select(F.round("difference", 6).alias("difference"), "units", ((F.col("low") <= F.col("difference")) & (F.col("difference") <= F.col("high"))).alias("inside"))


@query("WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders WHERE o_totalprice IS NOT NULL) SELECT a::INT AS q_num, b::INT AS q_den, v AS o_totalprice FROM o, (VALUES (1, 2), (1, 100), (99, 100), (1, 1), (0, 1)) AS q(a, b) WHERE i = greatest(1, (a * n + b - 1) // b)")
def q_exact_quantiles(spark, d):
    """Nearest ranks of all orders' prices, a column of almost as many values as rows, by ranges."""
    return A.nearest_rank(load(spark, d, "orders").select("o_totalprice"), [], "o_totalprice", [(1, 2), (1, 100), (99, 100), (1, 1), (0, 1)])


@query(f"WITH {FATE} SELECT s::INT AS stage, year(l_shipdate)::INT AS year, count(DISTINCT l_orderkey) AS entities FROM f, (VALUES (0), (2), (4)) AS v(s) WHERE coalesce(stage, 5) > s GROUP BY 1, 2")
def q_snapshots(spark, d):
    """Orders left after some stages, by year of shipment."""
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    return A.snapshots(L.with_fate(rows, checks()), "l_orderkey", F.year("l_shipdate"), [0, 2, len(CHECKS)])


# Orders, training rows and runs.


def documents(spark, d):
    return load(spark, d, "documents")


@query(f"""WITH n AS (SELECT count(*) AS n FROM documents), k AS (SELECT doc_id FROM documents WHERE lang IS DISTINCT FROM 'fr'), r AS (SELECT doc_id, row_number() OVER (ORDER BY {rank_sql("doc_id::VARCHAR", "'up'", "'cfg'", "'3'")}, doc_id) - 1 AS at_, count(*) OVER () AS m FROM k),
c AS (SELECT doc_id, unnest(range(0, n // m + CASE WHEN at_ < n % m THEN 1 ELSE 0 END)) AS copy FROM r, n)
SELECT doc_id, copy::INT AS copy, row_number() OVER (ORDER BY {rank_sql("doc_id::VARCHAR", "copy::VARCHAR", "'order'", "'cfg'", "'3'")}, doc_id, copy) - 1 AS pos FROM c""")
def q_selection_order(spark, d):
    """Documents without those of one language, brought back to their number by copies, in a fixed shuffled order."""
    rows = documents(spark, d).select("doc_id", "lang")
    return S.selection(rows, "doc_id", "lang", "cfg", 3, {"mask": "mask", "upsample": "up", "order": "order"}, dropped="fr")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id")
def q_longest_first(spark, d):
    return S.longest_first(documents(spark, d).select("doc_id", "n_chars"), "n_chars", "doc_id")


@query("SELECT doc_id, j::INT AS j, ((2 * j * (doc_id % 90 + 4) + 4) // 8)::BIGINT AS step FROM documents, range(1, 5) AS r(j)")
def q_checkpoint_steps(spark, d):
    """Four checkpoints of runs of 4 to 93 steps, halves up."""
    return S.checkpoint_rows(documents(spark, d).select("doc_id", (F.col("doc_id") % 90 + 4).alias("steps")), "steps", 4).select("doc_id", "j", "step")


@query("WITH m AS (SELECT s, doc_id FROM documents, range(6) AS r(s) WHERE (n_chars * (s % 4 + 1)) % 3 = 0), l AS (SELECT s, list_sort(list(DISTINCT doc_id)) AS l FROM m GROUP BY 1) SELECT x.s::INT AS a, y.s::INT AS b FROM l x JOIN l y ON x.l = y.l AND x.s < y.s")
def q_same_sets(spark, d):
    """Seeds that draw equal sets."""
    m = documents(spark, d).select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("s")).where("(n_chars * (s % 4 + 1)) % 3 = 0")
    return S.same_sets(m, "s", "doc_id")


@query("SELECT 'pinned model' AS \"check\", doc_id::VARCHAR AS key FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT 'pinned cap', doc_id::VARCHAR FROM documents WHERE doc_id % 10 = 0")
def q_pin_violations(spark, d):
    """Requests whose model or cap isn't the pinned one."""
    rows = documents(spark, d).select("doc_id", F.when(F.col("doc_id") % 9 == 0, "other").otherwise("m1").alias("model"), F.when(F.col("doc_id") % 10 != 0, 512).alias("cap"))
    return R.pin_violations(rows, "doc_id", {"model": F.lit("m1"), "cap": F.lit(512)}).select("check", "key")


@query("SELECT 'merge from run' AS \"check\", 'm' || doc_id AS key FROM documents WHERE doc_id % 8 = 0 UNION ALL SELECT 'evaluation from merge', 'e' || doc_id FROM documents WHERE doc_id % 12 = 5")
def q_run_chain(spark, d):
    """Hashes that should lead from an evaluation to its merge and run."""
    h = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string"))
    docs = documents(spark, d)
    run = docs.select(h("r").alias("own"))
    merge = docs.select(h("m").alias("own"), F.when(F.col("doc_id") % 8 == 0, "lost").otherwise(h("r")).alias("parent"))
    evaluation = docs.select(h("e").alias("own"), F.when(F.col("doc_id") % 12 == 5, "lost").otherwise(h("m")).alias("parent"))
    return R.chain_violations([("run", run, "own", ""), ("merge", merge, "own", "parent"), ("evaluation", evaluation, "own", "parent")]).select("check", "key")


@query("SELECT doc_id - 1 AS pos, doc_id, concat_ws(' ', lang, n_chars::VARCHAR) AS text FROM documents")
def q_training_rows(spark, d):
    """The rows of one arm in the order of a selection."""
    sel = documents(spark, d).select((F.col("doc_id") - 1).alias("pos"), "doc_id")
    source = documents(spark, d).select("doc_id", "lang", "n_chars")
    return R.training_rows(sel, "doc_id", "pos", {"sft": (source, {"text": F.concat_ws(" ", "lang", F.col("n_chars").cast("string"))})})["sft"]


@query("SELECT lang AS type, count(*) AS n FROM documents GROUP BY 1")
def q_composition(spark, d):
    return R.composition(documents(spark, d).select(F.concat_ws(":", F.col("doc_id").cast("string"), "lang", F.lit("0")).alias("item_id")), "item_id")


@query("SELECT CASE lang WHEN 'de' THEN 'stored only' ELSE 'missing' END AS message, count(*) AS n FROM documents WHERE lang IN ('de', 'fr') GROUP BY 1")
def q_selection_violations(spark, d):
    """A stored selection without one language against one without another."""
    docs = documents(spark, d).select("doc_id", "lang")
    bad = R.selection_violations(docs.where("lang IS DISTINCT FROM 'fr'"), docs.where("lang IS DISTINCT FROM 'de'"), ["doc_id"])
    return bad.groupBy("message").agg(F.count("*").alias("n"))


@query("SELECT 'one end token' AS \"check\", count(*) AS n FROM documents WHERE doc_id % 5 IN (0, 1) HAVING count(*) > 0 UNION ALL SELECT 'end token last', count(*) FROM documents WHERE doc_id % 5 IN (1, 2) HAVING count(*) > 0 UNION ALL SELECT 'as many tokens', count(*) FROM documents WHERE doc_id % 5 = 3 HAVING count(*) > 0")
def q_encoding_violations(spark, d):
    """Token arrays with two end tokens, none, one in the middle, or of another length than said."""
    k = F.col("doc_id") % 5
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    ids = F.when(k == 0, arr(0, 5, 0)).when(k == 1, arr(5, 6, 7)).when(k == 2, arr(5, 0, 7)).otherwise(arr(5, 6, 0))
    rows = documents(spark, d).select("doc_id", ids.alias("ids"), F.when(k == 3, 4).otherwise(3).alias("n"))
    return R.encoding_violations(rows, "doc_id", "ids", 0, "n").groupBy("check").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN -1 WHEN n_chars % 3 = 1 THEN 1 ELSE 3 END::BIGINT AS at FROM documents WHERE coalesce(lang = 'de', false) OR n_chars % 3 > 0")
def q_id_differences(spark, d):
    """Where prepared token arrays differ from fresh ones, which one language lacks."""
    k = F.col("n_chars") % 3
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    docs = documents(spark, d)
    a = docs.select("doc_id", arr(1, 2, 3).alias("ids"))
    b = docs.where("lang IS DISTINCT FROM 'de'").select("doc_id", F.when(k == 1, arr(1, 9, 3)).when(k == 2, arr(1, 2, 3, 4)).otherwise(arr(1, 2, 3)).alias("ids"))
    return R.id_differences(a, b, "doc_id", "ids")


@query("SELECT lang, sum(n_chars)::BIGINT AS trained, sum(n_chars % 7)::BIGINT AS reference, (sum(n_chars) * 6 + sum(n_chars % 7) * 2)::DOUBLE * 1000 AS flops FROM documents GROUP BY 1")
def q_flops(spark, d):
    rows = documents(spark, d).select("lang", "n_chars", (F.col("n_chars") % 7).alias("r"))
    return R.flop_totals(rows, ["lang"], "n_chars", "r", 1000)


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '[\\s]+'), lambda x: x <> ''))::INT AS tokens FROM documents WHERE text IS NOT NULL")
def q_token_table(spark, d):
    """Token counts by document, each distinct text counted once."""
    return R.token_table(documents(spark, d).where("text IS NOT NULL").select("doc_id", "text"), "doc_id", "text", F.size(T.word_tokens(F.col("text"))))


@query("SELECT doc_id, (CASE lang WHEN 'en' THEN 64 ELSE 128 END)::INT AS cap, 'r' || doc_id AS reply FROM documents WHERE lang IS NOT NULL")
def q_parts_merged(spark, d):
    """Requests dealt to parts by cap, answered part by part, and put together again."""
    docs = documents(spark, d).where("lang IS NOT NULL")
    caps = docs.select("lang").distinct().select("lang", F.when(F.col("lang") == "en", 64).otherwise(128).alias("cap"))
    rows = R.cap_of(docs.select("doc_id", "lang"), "lang", caps)
    answered = R.parts_by_cap(rows, "doc_id", "cap").select("cap", "part_pos", F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("reply"))
    return R.merged_parts(rows, answered, "doc_id", "cap").select("doc_id", "cap", "reply")


@query("SELECT doc_id, array_to_string(CASE WHEN lang = 'en' THEN [7, 7, 7, 7, 0] WHEN doc_id % 2 = 0 THEN [1, 2, 0, 0, 0] ELSE [1, 2, 3, 4, 5] END, ',') AS ids FROM documents")
def q_scattered(spark, d):
    """Rows of a batch replaced and padded to one width."""
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    docs = documents(spark, d)
    batch = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, arr(1, 2)).otherwise(arr(1, 2, 3, 4, 5)).alias("ids"))
    new = docs.where("lang = 'en'").select("doc_id", arr(7, 7, 7, 7).alias("ids"))
    return R.scattered(batch, new, "doc_id", "ids", 0).select("doc_id", F.array_join("ids", ",").alias("ids"))


@query("SELECT doc_id, 2::BIGINT AS at FROM documents WHERE doc_id % 4 = 1")
def q_label_differences(spark, d):
    """Loss labels that differ from the collated ones, the first place exempt."""
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    k = F.col("doc_id") % 4
    rows = documents(spark, d).select("doc_id", T.loss_labels(arr(4, 5, 6), arr(0, 1, 1)).alias("x"), F.when(k == 1, arr(-100, 5, -100)).when(k == 2, arr(9, 5, 6)).otherwise(arr(-100, 5, 6)).alias("y"))
    return R.label_differences(rows, "doc_id", "x", "y")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'en' WHEN doc_id % 3 = 0 THEN 'fr' END AS lang FROM documents")
def q_first_present(spark, d):
    """The first of a row's wanted languages that a pool has."""
    wanted = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("xx"), F.lit("en"), F.lit("fr"))).when(F.col("doc_id") % 3 == 0, F.array(F.lit("fr"), F.lit("en"))).otherwise(F.array(F.lit("xx")))
    have = spark.createDataFrame([("en",), ("fr",), ("de",)], "lang string")
    return R.first_present(documents(spark, d).select("doc_id", wanted.alias("w")), "doc_id", "w", have, "lang")


@query("WITH r AS (SELECT doc_id, s AS seed, CASE WHEN (doc_id + s) % 5 = 0 THEN 'dev' ELSE 'train' END AS role, (doc_id + s) % 7 = 1 AND (doc_id + s) % 5 <> 0 AS c FROM documents, range(2) AS g(s)), x AS (SELECT seed, role AS \"set\", doc_id FROM r UNION ALL SELECT seed, 'checkpoint', doc_id FROM r WHERE c) SELECT seed::INT AS seed, \"set\", count(*) AS n, sum(doc_id)::BIGINT AS keys FROM x GROUP BY ALL")
def q_role_sets(spark, d):
    x = F.col("doc_id") + F.col("seed")
    roles = documents(spark, d).select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("seed")).withColumns({"role": F.when(x % 5 == 0, "dev").otherwise("train"), "c": (x % 7 == 1) & (x % 5 != 0)})
    return R.role_sets(roles, "doc_id", "seed", "role", "c").groupBy("seed", "set").agg(F.count("*").alias("n"), F.sum("doc_id").alias("keys"))


@query("WITH s AS (SELECT lang AS run, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS step, sum(n_chars + 1) OVER (PARTITION BY lang ORDER BY doc_id) AS e FROM documents WHERE lang IS NOT NULL), g AS (SELECT run, step, e - lag(e) OVER (PARTITION BY run ORDER BY step) AS g FROM s), m AS (SELECT run, count(*) AS n, max(e) AS train FROM s GROUP BY 1) SELECT run, median(g)::DOUBLE AS per_step, any_value(5 + train - n * 1.0) - (median(g) - 1.0) * any_value(n) AS overhead FROM g JOIN m USING (run) WHERE step BETWEEN 3 AND 10 GROUP BY 1")
def q_run_costs(spark, d):
    """Each language as a run whose documents are steps: the median duration of steps 3 to 10, and what is over."""
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("doc_id")
    steps = documents(spark, d).where("lang IS NOT NULL").select(F.col("lang").alias("run"), "doc_id", "n_chars").withColumns({"step": F.row_number().over(w), "e": F.sum(F.col("n_chars") + 1).over(w)})
    meta = steps.groupBy("run").agg(F.count("*").alias("steps_done"), F.lit(5).alias("load"), F.max("e").alias("train"))
    return R.run_costs(steps, "run", "step", "e", 3, 10, meta)


@query("SELECT lang AS arm, doc_id || ':q:0' AS item_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 2)::VARCHAR ELSE (doc_id % 5) || '/8' END AS metric FROM documents WHERE lang IS NOT NULL")
def q_score_export(spark, d):
    docs = documents(spark, d).where("lang IS NOT NULL")
    one = F.col("doc_id") % 3 == 0
    rows = docs.select(F.col("lang").alias("arm"), F.concat(F.col("doc_id").cast("string"), F.lit(":q:0")).alias("item_id"), F.when(one, F.col("doc_id") % 2).otherwise(F.col("doc_id") % 5).alias("num"), F.when(one, 1).otherwise(8).alias("den"))
    return R.score_export(rows, docs.select(F.col("lang").alias("arm")), ["arm"], "num", "den")
