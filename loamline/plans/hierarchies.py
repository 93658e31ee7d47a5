"""Closure, relations and credit on the hierarchy region, nation, supplier."""

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import graph as G
from ..tables import load

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def edges(spark, d):
    n = load(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent"))
    s = load(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("child"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("parent"))
    return n.union(s)


EDGES = "e AS MATERIALIZED (SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier)"
RELATION = f"""{EDGES}, ids AS (SELECT child AS n FROM e UNION SELECT parent FROM e),
nb AS (SELECT child AS a, parent AS b FROM e UNION SELECT parent, child FROM e),
cl AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT x.child, y.parent FROM e x JOIN e y ON x.parent = y.child),
two AS (SELECT DISTINCT x.a AS pred, y.b AS gold FROM nb x JOIN nb y ON x.b = y.a WHERE x.a <> y.b),
kin AS (SELECT pred, gold, CASE WHEN EXISTS (SELECT 1 FROM cl WHERE node = gold AND ancestor = pred) THEN 'ancestor_2' WHEN EXISTS (SELECT 1 FROM cl WHERE node = pred AND ancestor = gold) THEN 'descendant_2'
  WHEN EXISTS (SELECT 1 FROM e x JOIN e y ON x.parent = y.parent WHERE x.child = pred AND y.child = gold) THEN 'sibling' ELSE 'coparent' END AS relation FROM two),
r AS (SELECT n AS pred, n AS gold, 0 AS o, 'exact' AS relation FROM ids UNION ALL SELECT child, parent, 1, 'child' FROM e UNION ALL SELECT parent, child, 2, 'parent' FROM e UNION ALL SELECT pred, gold, 3, relation FROM kin),
rel AS MATERIALIZED (SELECT pred, gold, arg_min(relation, o) AS relation FROM r GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {EDGES}, c AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT c.node, e.parent, depth + 1 FROM c JOIN e ON e.child = c.ancestor) SELECT node, ancestor, min(depth)::INT AS depth FROM c GROUP BY 1, 2")
def q_closure(spark, d):
    return G.closure(edges(spark, d))


@query(f"WITH {EDGES} SELECT a.child AS node, b.child AS sibling FROM e a JOIN e b ON a.parent = b.parent AND a.child <> b.child")
def q_siblings(spark, d):
    e = edges(spark, d)
    return G.siblings(e, G.closure(e))


@query(f"WITH {EDGES} SELECT child AS node, parent AS other FROM e UNION SELECT parent, child FROM e")
def q_neighbours(spark, d):
    return G.neighbours(edges(spark, d))


@query(f"WITH {EDGES}, n AS MATERIALIZED (SELECT child AS a, parent AS b FROM e UNION SELECT parent, child FROM e), w AS (SELECT a, b, 1 AS k FROM n UNION ALL SELECT x.a, y.b, 2 FROM n x JOIN n y ON x.b = y.a WHERE x.a <> y.b UNION ALL SELECT x.a, z.b, 3 FROM n x JOIN n y ON x.b = y.a JOIN n z ON y.b = z.a WHERE x.a <> z.b) SELECT a AS node, b AS other, min(k)::INT AS distance FROM w GROUP BY 1, 2")
def q_distance(spark, d):
    """Undirected distances up to 3."""
    return G.distances(edges(spark, d), 3)


@query(f"WITH {RELATION} SELECT pred, gold, relation, CASE relation WHEN 'exact' THEN 8 WHEN 'child' THEN 4 WHEN 'parent' THEN 4 ELSE 2 END::INT AS symmetric, CASE relation WHEN 'exact' THEN 8 WHEN 'child' THEN 4 WHEN 'ancestor_2' THEN 1 ELSE 2 END::INT AS directed FROM rel")
def q_relation_credit(spark, d):
    """Relations within two steps, and both schedules of credit in eighths."""
    e = edges(spark, d)
    r = G.relations(e)
    return r.select("pred", "gold", "relation", G.credit(F.col("relation")).alias("symmetric"), G.credit(F.col("relation"), G.DIRECTED).alias("directed"))


@query(f"WITH {RELATION}, l AS (SELECT 'N' || c_nationkey AS gold, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total FROM l), s AS (SELECT pred, sum(n * CASE relation WHEN 'exact' THEN 8 WHEN 'child' THEN 4 WHEN 'parent' THEN 4 ELSE 2 END)::BIGINT AS eighths FROM rel JOIN l USING (gold) GROUP BY 1) SELECT pred, eighths, total FROM s, t ORDER BY eighths DESC, try_cast(regexp_extract(pred, '[0-9]+') AS BIGINT), pred LIMIT 10")
def q_best_constant(spark, d):
    """The ten nodes that, given for every customer's nation, earn the most credit."""
    labels = load(spark, d, "customer").groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("gold")).agg(F.count("*").alias("n"))
    return A.best_constant(labels, G.relations(edges(spark, d), golds=labels), G.credit(F.col("relation")))
