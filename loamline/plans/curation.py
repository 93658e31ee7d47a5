"""Ledgers, sources, joins and reconciliation."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rank import rank_hex
from ..operators import checks as C
from ..operators import ledger as L
from ..operators import reconcile as R
from ..operators import sampling as S
from ..tables import load

CHECKS = [("small", "l_quantity < 3"), ("discounted", "l_discount > 0.09"), ("returned", "l_returnflag = 'R'"), ("late", "l_shipdate >= '1998-01-01'")]


def lines(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")


def checks():
    return [(n, F.expr(c)) for n, c in CHECKS]


def q_ledger_stages(spark, d):
    """Rows and orders left after each of four checks on lines."""
    return L.stage_ledger(L.with_fate(lines(spark, d), checks()), "l_orderkey", len(CHECKS))


def q_drop_reasons(spark, d):
    """Orders without a surviving line: stage, reason and all failures."""
    return L.entity_drops(L.with_fate(lines(spark, d), checks()), "l_orderkey").select("l_orderkey", "stage", "reason", F.array_join("all_failures", ",").alias("all_failures"))


def q_fates(spark, d):
    """Lines by fate and number of failing checks."""
    fated = L.with_fate(lines(spark, d), checks())
    return fated.groupBy(F.coalesce(F.concat_ws(":", F.col("stage").cast("string"), "reason"), F.lit("selected")).alias("fate"), F.size("failures").alias("failing")).agg(F.count("*").alias("n")).select(F.when(F.col("fate") == "", "selected").otherwise(F.col("fate")).alias("fate"), "failing", "n")


def q_filter_alone(spark, d):
    return L.filter_alone(lines(spark, d), "l_orderkey", checks())


def q_cap_sensitivity(spark, d):
    """Documents and sources left under caps on characters."""
    return L.cap_sensitivity(load(spark, d, "documents").select("source", "n_chars"), F.col("n_chars"), "source", [64, 1024, 2048, 4096, 10000])


def q_first_reason(spark, d):
    """The first reason against each document: empty, without language, a body that others have too, mostly long."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "n_chars", T.body_hash(F.col("text")).alias("h"), F.length("text").alias("len"))
    shared = docs.groupBy("h").agg(F.count("*").alias("same"))
    out = docs.join(shared, "h", "left")
    return L.with_fate(out, [("empty", F.coalesce("len", F.lit(0)) == 0), ("no_lang", F.col("lang").isNull()), ("shared_body", F.col("same") > 1), ("long", L.exceeds_fraction(F.col("n_chars"), F.lit(20_000), 1, 5))]).select("doc_id", "reason", F.array_join("failures", ",").alias("failures"))


def q_latest_wins(spark, d):
    """Each user's latest event; with equal times the earlier id."""
    return L.latest_wins(load(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def q_one_per_entity(spark, d):
    """One line of each order: a returned one if there is one, else by rank."""
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return L.one_per_entity(rows, "l_orderkey", F.col("l_returnflag") == "R", rank_hex(F.col("l_orderkey"), F.col("l_linenumber")), "l_linenumber").select("l_orderkey", "l_linenumber", "n_candidates", "rule")


def q_join_status(spark, d):
    """Documents by whether a label is there, and which: a left join's status."""
    docs = load(spark, d, "documents").select("doc_id")
    return docs.join(load(spark, d, "labels"), "doc_id", "left").groupBy(F.when(F.col("quality").isNull(), "not_labelled").when(F.col("quality") == 0, "rejected").otherwise("ok").alias("status")).agg(F.count("*").alias("n"))


def q_coverage_gaps(spark, d):
    """Ids without a label, and items of the benchmark's ids that are no document's."""
    docs, labels = load(spark, d, "documents").select("doc_id"), load(spark, d, "labels").select("doc_id")
    return R.todo(docs, labels, "doc_id").select(F.lit("missing").alias("kind"), "doc_id").union(R.todo(labels, docs, "doc_id").select(F.lit("unexpected").alias("kind"), "doc_id"))


def q_pair_self(spark, d):
    """Conversations by whether their first two turns are both longer than 100 characters, by conditional aggregation."""
    rows = load(spark, d, "conversations").where("turn in (0, 1)")
    size = lambda i: F.max(F.when(F.col("turn") == i, F.length("text")))
    return rows.groupBy("conv_id").agg(size(0).alias("first"), size(1).alias("second")).withColumn("both_long", F.coalesce((F.col("first") > 100) & (F.col("second") > 100), F.lit(False)))


def results(spark, d):
    """Synthetic results: labels that aren't toxic, those of low quality twice or with another hash, and some of ids that weren't asked for."""
    labels = load(spark, d, "labels")
    got = labels.where("toxic = 0").select("doc_id", (F.col("quality") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).alias("h"))
    return labels.select("doc_id", F.col("quality").alias("h")), got.union(labels.where("toxic = 0 AND quality = 0").select("doc_id", F.col("quality").alias("h"))).union(labels.where("toxic = 1").select((F.col("doc_id") + 10_000_000_000).alias("doc_id"), F.col("quality").alias("h")))


def q_reconcile(spark, d):
    asked, got = results(spark, d)
    return R.reconcile(asked, got, "doc_id", "h")


RESULTS = """asked AS (SELECT doc_id, quality AS h FROM labels),
got AS (SELECT doc_id, quality + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS h FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id, quality FROM labels WHERE toxic = 0 AND quality = 0
        UNION ALL SELECT doc_id + 10000000000, quality FROM labels WHERE toxic = 1)"""


def q_retry_decide(spark, d):
    """The first valid of two attempts, else the gold: attempts are synthetic texts, invalid by remainders of the id."""
    labels = load(spark, d, "labels").select("doc_id", "quality")
    tries = labels.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt")).where("attempt = 1 OR doc_id % 3 = 0")
    tries = tries.withColumn("text", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("attempt").cast("string"))).withColumn("reason", F.when((F.col("attempt") == 1) & (F.col("doc_id") % 3 == 0), "empty").when((F.col("attempt") == 2) & (F.col("doc_id") % 2 == 0), "truncated"))
    return R.retry_decision(tries, "doc_id", "attempt", "text", "reason", labels.select("doc_id", F.concat(F.lit("gold-"), F.col("quality").cast("string")).alias("gold")), "gold")


def q_last_success(spark, d):
    """Of each user the latest event of positive value, else the latest."""
    rows = load(spark, d, "events").select("user_id", "event_id", "value")
    return R.last_success(rows, "user_id", "event_id", F.col("value") > 50).select("user_id", "event_id", "succeeded")


def q_admission(spark, d):
    """For each supplier's nation, the first three customers by name's last digits that aren't in debt: first of equal ones, in order."""
    c = load(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal")
    banned = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_acctbal").alias("low")).where("low < -950").select("c_nationkey", "c_mktsegment")
    return R.admitted(c, "c_nationkey", ["c_custkey"], "c_mktsegment", banned, 3)


def q_violations(spark, d):
    """Invariants of documents, labels and the holdout, as counts of violations."""
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")
    held = S.temporal_holdout(load(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day")), "o_orderkey", "day", 3, 20)
    found = C.together([
        C.row_checks(docs, "doc_id", {"length": F.length("text") == F.col("n_chars"), "short": F.col("n_chars") < 5000, "lang": F.col("lang").isin("en", "fr", "de", "es")}),
        C.unique(docs, "doc_id"), C.one_value(held, "o_custkey", "pool"), C.disjoint(docs.select("doc_id"), labels.select("doc_id"), "doc_id"),
    ])
    return found.groupBy("check").agg(F.count("*").alias("n"))


def q_json_status(spark, d):
    """Events by whether props has a whole number k."""
    return load(spark, d, "events").groupBy(T.json_int_status(F.col("props"), "k").alias("status"), "event_type").agg(F.count("*").alias("n"))


def q_set_operations(spark, d):
    """Ids of documents and labels: union, intersection and differences, as counts."""
    a, b = load(spark, d, "documents").select("doc_id"), load(spark, d, "labels").select("doc_id")
    count = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("set"), "n")
    return count(a.union(b).distinct(), "union").union(count(a.intersect(b), "intersection")).union(count(a.exceptAll(b), "only documents")).union(count(b.exceptAll(a), "only labels"))


QUERIES = {f.__name__: f for f in (q_ledger_stages, q_drop_reasons, q_fates, q_filter_alone, q_cap_sensitivity, q_first_reason, q_latest_wins, q_one_per_entity, q_join_status, q_coverage_gaps, q_pair_self, q_reconcile, q_retry_decide, q_last_success, q_admission, q_violations, q_json_status, q_set_operations)}
FATE = "f AS (SELECT *, CASE " + " ".join(f"WHEN {c} THEN {i}" for i, (_, c) in enumerate(CHECKS, 1)) + " END AS stage, list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in CHECKS) + "], lambda x: x IS NOT NULL) AS failures FROM lineitem)"
NAMES = "['" + "', '".join(n for n, _ in CHECKS) + "']"
KEY = r"regexp_replace(l, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')"
KEYS = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {KEY}), lambda k: k <> '')"
ORACLES = {
    "q_ledger_stages": f"WITH {FATE}, e AS (SELECT l_orderkey, max(coalesce(stage, 5)) AS died FROM f GROUP BY 1) SELECT s::INT AS stage, (SELECT count(*) FROM f WHERE coalesce(stage, 5) > s) AS rows_left, (SELECT count(*) FROM e WHERE died > s) AS entities_left FROM range(5) AS g(s)",
    "q_drop_reasons": f"WITH {FATE} SELECT l_orderkey, max(stage)::INT AS stage, ({NAMES})[max(stage)] AS reason, array_to_string(list_sort(list_distinct(flatten(list(failures)))), ',') AS all_failures FROM f GROUP BY 1 HAVING bool_and(stage IS NOT NULL)",
    "q_fates": f"WITH {FATE} SELECT coalesce(stage || ':' || ({NAMES})[stage], 'selected') AS fate, len(failures)::INT AS failing, count(*) AS n FROM f GROUP BY 1, 2",
    "q_filter_alone": " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) FILTER ({c}) AS rows_dropped, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(coalesce({c}, false)))) AS entities_dropped FROM lineitem" for n, c in CHECKS),
    "q_cap_sensitivity": "SELECT c::INT AS cap, (SELECT count(*) FROM documents WHERE n_chars <= c) AS rows_left, (SELECT count(DISTINCT source) FROM documents WHERE n_chars <= c) AS entities_left FROM (VALUES (64), (1024), (2048), (4096), (10000)) AS t(c)",
    "q_first_reason": f"WITH h AS (SELECT doc_id, lang, n_chars, text, count(*) OVER (PARTITION BY array_to_string({KEYS}, chr(10))) AS same FROM documents), r AS (SELECT doc_id, list_filter([CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' END, CASE WHEN lang IS NULL THEN 'no_lang' END, CASE WHEN same > 1 THEN 'shared_body' END, CASE WHEN n_chars * 5 > 20000 THEN 'long' END], lambda x: x IS NOT NULL) AS f FROM h) SELECT doc_id, f[1] AS reason, array_to_string(f, ',') AS failures FROM r",
    "q_latest_wins": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1",
    "q_one_per_entity": "WITH r AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (l_returnflag = 'R') OVER w AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, substr(sha256(concat_ws(chr(31), l_orderkey, l_linenumber)), 1, 16), l_linenumber) AS r FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey, l_linenumber, n AS n_candidates, CASE WHEN n = 1 THEN 'single' WHEN p = 1 THEN 'preferred' WHEN p > 1 THEN 'preferred_rank' ELSE 'rank' END AS rule FROM r WHERE r = 1",
    "q_join_status": "SELECT CASE WHEN quality IS NULL THEN 'not_labelled' WHEN quality = 0 THEN 'rejected' ELSE 'ok' END AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "q_coverage_gaps": "SELECT 'missing' AS kind, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unexpected', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "q_pair_self": "WITH t AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN length(text) END)::INT AS first, max(CASE WHEN turn = 1 THEN length(text) END)::INT AS second FROM conversations WHERE turn IN (0, 1) GROUP BY 1) SELECT *, coalesce(first > 100 AND second > 100, false) AS both_long FROM t",
    "q_reconcile": f"WITH {RESULTS}, a AS (SELECT doc_id, count(*) AS n, min(h) AS h FROM asked GROUP BY 1), g AS (SELECT doc_id, count(*) AS n, min(h) AS h FROM got GROUP BY 1) SELECT doc_id, CASE WHEN g.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'unexpected' WHEN g.n > 1 THEN 'duplicate' WHEN a.h IS DISTINCT FROM g.h THEN 'hash_differs' ELSE 'ok' END AS status FROM a FULL JOIN g USING (doc_id)",
    "q_retry_decide": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'attempt_1' WHEN doc_id % 2 <> 0 THEN 'attempt_2' ELSE 'gold' END AS source, CASE WHEN doc_id % 3 <> 0 THEN doc_id || '-1' WHEN doc_id % 2 <> 0 THEN doc_id || '-2' ELSE 'gold-' || quality END AS text FROM labels",
    "q_last_success": "SELECT user_id, event_id, succeeded FROM (SELECT user_id, event_id, coalesce(value > 50, false) AS succeeded, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value > 50, false) DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "q_admission": "WITH b AS (SELECT c_nationkey, c_mktsegment FROM customer GROUP BY ALL HAVING min(c_acctbal) < -950), f AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS o FROM customer GROUP BY ALL), s AS (SELECT f.*, row_number() OVER (PARTITION BY f.c_nationkey ORDER BY o) AS slot FROM f ANTI JOIN b USING (c_nationkey, c_mktsegment)) SELECT c_nationkey, c_mktsegment, slot::INT AS slot FROM s WHERE slot <= 3",
    "q_violations": "WITH o AS (SELECT o_custkey, o_orderdate::DATE AS day FROM orders), c AS (SELECT min(day) AS cut FROM (SELECT day, row_number() OVER (ORDER BY day DESC) AS n, count(*) OVER () AS t FROM o) WHERE n = (t * 3 + 19) // 20), v AS (SELECT 'length' AS \"check\", count(*) FILTER (NOT coalesce(length(text) = n_chars, false)) AS n FROM documents UNION ALL SELECT 'short', count(*) FILTER (NOT coalesce(n_chars < 5000, false)) FROM documents UNION ALL SELECT 'lang', count(*) FILTER (NOT coalesce(lang IN ('en', 'fr', 'de', 'es'), false)) FROM documents UNION ALL SELECT 'unique doc_id', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'one pool for each o_custkey', count(*) FROM (SELECT o_custkey FROM o, c GROUP BY 1 HAVING count(DISTINCT day >= cut) > 1) UNION ALL SELECT 'disjoint doc_id', count(DISTINCT doc_id) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT * FROM v WHERE n > 0",
    "q_json_status": "SELECT CASE WHEN props IS NULL OR NOT json_valid(props) THEN 'bad_json' WHEN json_type(props, '$.k') IS NULL THEN 'missing' WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'ok' ELSE 'wrong_type' END AS status, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "q_set_operations": "SELECT 'union' AS \"set\", count(*) AS n FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL SELECT 'intersection', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'only documents', count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT 'only labels', count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)",
}
