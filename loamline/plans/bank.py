"""Question banks on analogues: customers as facts, nations, regions and suppliers as the hierarchy of labels."""

from pyspark.sql import functions as F

from ..functions import diff as D
from ..functions import text as T
from ..functions import verify as V
from ..operators import bank as B
from ..operators import evaluation as E
from ..operators import graph as G
from ..tables import load, spread
from .hierarchies import EDGES, edges
from .samples import mod_sql, rank_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


CLOSURE = "cl AS MATERIALIZED (SELECT child AS node, parent AS ancestor FROM e UNION SELECT x.child, y.parent FROM e x JOIN e y ON x.parent = y.child), ids AS MATERIALIZED (SELECT child AS n FROM e UNION SELECT parent FROM e)"
STEPS = (1, 7, 13)
LAYOUT = f"""c AS (SELECT 'C-' || c_custkey AS key, 'N' || c_nationkey AS gold, [{", ".join(f"'N' || ((c_nationkey + {s}) % 25)" for s in STEPS)}] AS os FROM customer),
a AS (SELECT key, gold, {mod_sql("4", "key", "'letter'")} AS at_, list_transform(list_sort(list_transform(os, lambda c: {rank_sql("key", "'slot'", "c")} || c)), lambda x: substr(x, 17)) AS rest FROM c),
l AS (SELECT key, gold, at_, list_concat(list_concat(rest[1:at_], [gold]), rest[at_ + 1:3]) AS line FROM a)"""


def nation(i: int = 0):
    return F.concat(F.lit("N"), ((F.col("c_nationkey") + i) % 25).cast("string"))


def facts(spark, d):
    c = spread(load(spark, d, "customer"), "c_custkey").select(F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("key"), nation().alias("gold"), F.array(*[nation(s) for s in STEPS]).alias("others"), "c_nationkey", "c_name")
    return B.layout(c, "key", "gold", "others", "letter", "slot")


@query(f"WITH {LAYOUT} SELECT key, array_to_string(list_transform(line, lambda c, i: substr('ABCD', i, 1) || '=' || c), ',') AS options, substr('ABCD', (at_ + 1)::INT, 1) AS gold_letter FROM l")
def q_mcq_layout(spark, d):
    """Each customer's nation among three others, in lettered places by rank."""
    return facts(spark, d).select("key", F.array_join(F.transform("options", lambda o: F.concat(o["letter"], F.lit("="), o["cwe"])), ",").alias("options"), "gold_letter")


@query(f"""WITH {EDGES}, {CLOSURE}, p AS (SELECT c_custkey AS key, 'N' || c_nationkey AS gold, [' n' || ((c_nationkey + 1) % 25) || ' ', 'N' || c_nationkey, 'R' || (c_nationkey % 5), 'S1', 'N' || ((c_nationkey + 1) % 25), 'N99', 'bogus!', 'S2'] AS ps FROM customer),
x AS (SELECT key, gold, i - 1 AS pos, upper(trim(ps[i])) AS v FROM p, range(1, 9) AS r(i)),
w AS (SELECT *, CASE WHEN NOT regexp_matches(v, '^[NRS][0-9]+$') THEN 'malformed' WHEN v = gold THEN 'gold' WHEN v NOT IN (SELECT n FROM ids) THEN 'not_live' WHEN (gold, v) IN (SELECT (node, ancestor) FROM cl) THEN 'ancestor' WHEN (v, gold) IN (SELECT (node, ancestor) FROM cl) THEN 'descendant' END AS why FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY key, v, why IS NULL ORDER BY pos) > 1 AS again FROM w)
SELECT key AS c_custkey, pos::INT AS pos, coalesce(why, CASE WHEN again THEN 'duplicate' END) AS reason FROM z""")
def q_admit_reasons(spark, d):
    """Proposed distractors of each customer's nation with the reasons against them."""
    c = load(spark, d, "customer")
    raw = F.array(F.concat(F.lit(" "), F.lower(nation(1)), F.lit(" ")), nation(), F.concat(F.lit("R"), (F.col("c_nationkey") % 5).cast("string")), F.lit("S1"), nation(1), F.lit("N99"), F.lit("bogus!"), F.lit("S2"))
    rows = c.select("c_custkey", nation().alias("gold"), raw.alias("ps"))
    e = edges(spark, d)
    live = G.neighbours(e).select(F.col("node").alias("id")).distinct()
    return B.judged_proposals(rows, "c_custkey", "gold", "ps", r"\A[NRS][0-9]+\z", lambda v: v, live, G.closure(e)).select("c_custkey", "pos", "reason")


def draw_sql(slots: int) -> str:
    out = ["pool AS (SELECT 'N' || c_nationkey AS n, count(*)::BIGINT AS w FROM customer GROUP BY 1)", "t0 AS (SELECT c_custkey AS k, ['N' || c_nationkey] AS taken FROM customer)"]
    for s in range(slots):
        out.append(f"c{s} AS (SELECT k, taken, n, w, sum(w) OVER (PARTITION BY k ORDER BY n) AS e, sum(w) OVER (PARTITION BY k) AS total FROM t{s}, pool WHERE NOT list_contains(taken, n))")
        out.append(f"t{s + 1} AS (SELECT k, list_append(taken, n) AS taken FROM c{s} WHERE {mod_sql('total', 'k::VARCHAR', chr(39) + 'prior' + chr(39), f'{chr(39)}{s}{chr(39)}')} BETWEEN e - w AND e - 1)")
    return f"WITH {', '.join(out)} SELECT k AS c_custkey, array_to_string(taken[2:], ',') AS drawn FROM t{slots}"


@query(draw_sql(3))
def q_draw_only(spark, d):
    """Three nations for each customer by their numbers of customers, its own and its relatives left out."""
    c = load(spark, d, "customer").select("c_custkey", nation().alias("gold"))
    counts = c.groupBy(F.col("gold").alias("item")).agg(F.count("*").alias("w"))
    return B.drawn_distractors(c, "c_custkey", "gold", counts, G.closure(edges(spark, d)), 3, "prior").select("c_custkey", F.array_join("drawn", ",").alias("drawn"))


def decision_sql() -> str:
    out = ["pool AS (SELECT 'N' || c_nationkey AS n, count(*)::BIGINT AS w FROM customer GROUP BY 1)", "t0 AS (SELECT c_custkey AS k, (CASE WHEN c_acctbal > 5000 THEN 2 WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS have, ['N' || c_nationkey] || CASE WHEN c_acctbal > 5000 THEN ['N' || ((c_nationkey + 1) % 25), 'N' || ((c_nationkey + 7) % 25)] WHEN c_acctbal > 0 THEN ['N' || ((c_nationkey + 1) % 25)] ELSE [] END AS taken FROM customer)"]
    for s in range(3):
        out.append(f"c{s} AS (SELECT k, have, taken, n, w, sum(w) OVER (PARTITION BY k ORDER BY n) AS e, sum(w) OVER (PARTITION BY k) AS total FROM t{s}, pool WHERE have + {s} < 3 AND NOT list_contains(taken, n))")
        slot = f"(have + {s})::VARCHAR"
        out.append(f"t{s + 1} AS (SELECT k, have, list_append(taken, n) AS taken FROM c{s} WHERE {mod_sql('total', 'k::VARCHAR', chr(39) + 'prior' + chr(39), slot)} BETWEEN e - w AND e - 1 UNION ALL SELECT k, have, taken FROM t{s} WHERE have + {s} >= 3)")
    return f"WITH {', '.join(out)} SELECT k AS c_custkey, array_to_string(taken[2:], ',') AS distractors, array_to_string((CASE have WHEN 1 THEN ['model'] WHEN 2 THEN ['model', 'model_retry'] ELSE [] END) || list_transform(range(3 - have), lambda i: 'draw'), ',') AS sources FROM t3"


@query(decision_sql())
def q_mcq_decisions(spark, d):
    """Distractors from a first attempt, a second, and the draw."""
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", nation().alias("gold"))
    counts = c.groupBy(F.col("gold").alias("item")).agg(F.count("*").alias("w"))
    first = c.where("c_acctbal > 0").select("c_custkey", F.lit(0).alias("pos"), nation(1).alias("value"))
    second = c.where("c_acctbal > 5000").select("c_custkey", F.explode(F.array(F.struct(F.lit(0).alias("pos"), nation(1).alias("value")), F.struct(F.lit(1).alias("pos"), nation(7).alias("value")))).alias("x")).select("c_custkey", "x.*")
    out = B.decided_distractors(c, "c_custkey", "gold", [("model", first), ("model_retry", second)], counts, G.closure(edges(spark, d)), 3, "prior")
    return out.select("c_custkey", F.array_join("distractors", ",").alias("distractors"), F.array_join("sources", ",").alias("sources"))


PROMPTS = {"mcq": "Read: {description}\n{options}\nWhich?", "exact_id": "Name it: {description}", "cvss": "Rate it: {description}", "find_error": "Is it vulnerable?\n{function}", "line_loc": "{description}\nWhere?\n{numbered}"}
SYSTEM = "Be brief."
VECTOR = "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
DESC = "'About CVE-[redacted] and CWE-[redacted] of ' || c_name"
def code_sql(x: str) -> str:
    return f"'int f()' || chr(10) || '{{' || chr(10) || '  return ' || {x} || ';' || chr(10) || '}}'"




def items(spark, d):
    code = lambda x: F.concat(F.lit("int f()\n{\n  return "), x, F.lit(";\n}"))
    rows = facts(spark, d).select("key", F.col("gold").alias("cwe"), F.lit(VECTOR).alias("vector"), F.concat(F.lit("About "), F.lower("key"), F.lit(" and cwe-12 of "), "c_name").alias("description"), code(F.col("c_nationkey").cast("string")).alias("vuln"), code(F.lit("0")).alias("patched"), F.array(F.lit(3)).alias("lines"), F.lit(4).alias("n_lines"), "options", "gold_letter")
    return B.six_items(rows, "key", PROMPTS, SYSTEM)


@query(f"""WITH {LAYOUT}, f AS (SELECT l.*, c_nationkey, c_name, {DESC} AS description FROM l JOIN customer ON key = 'C-' || c_custkey),
i AS (SELECT key || ':mcq:0' AS item_id, 'ANSWER: ' || substr('ABCD', (at_ + 1)::INT, 1) AS target, 'Read: ' || description || chr(10) || array_to_string(list_transform(line, lambda c, i: substr('ABCD', i, 1) || '. ' || c), chr(10)) || chr(10) || 'Which?' AS u FROM f
UNION ALL SELECT key || ':exact_id:0', gold, 'Name it: ' || description FROM f UNION ALL SELECT key || ':cvss:0', '{VECTOR}', 'Rate it: ' || description FROM f
UNION ALL SELECT key || ':find_error:0', 'VULNERABLE: yes, ' || gold, 'Is it vulnerable?' || chr(10) || {code_sql("c_nationkey")} FROM f UNION ALL SELECT key || ':find_error:1', 'VULNERABLE: no', 'Is it vulnerable?' || chr(10) || {code_sql("'0'")} FROM f
UNION ALL SELECT key || ':line_loc:0', 'LINES: 3', description || chr(10) || 'Where?' || chr(10) || '1: int f()' || chr(10) || '2: {{' || chr(10) || '3:   return ' || c_nationkey || ';' || chr(10) || '4: }}' FROM f)
SELECT item_id, target, sha256(u) AS user_hash FROM i""")
def q_six_items(spark, d):
    """The six items of each customer, with their targets and the hash of what they ask."""
    return items(spark, d).select("item_id", "target", T.text_hash(F.col("user")).alias("user_hash"))


@query("""SELECT 'prompt rendered' AS "check", count(*) AS n FROM customer WHERE c_custkey % 50 = 0 HAVING count(*) > 0 UNION ALL SELECT 'six items', count(*) FROM customer WHERE c_custkey % 70 = 0 HAVING count(*) > 0
UNION ALL SELECT 'no own id', count(*) FROM customer WHERE c_custkey % 90 = 0 HAVING count(*) > 0""")
def q_bank_violations(spark, d):
    """Violations of a bank in which some prompts, items and texts have been spoilt; all own targets score 1."""
    n = F.substring("key", 3, 20).cast("long")
    rows = items(spark, d)
    rows = rows.withColumn("prompt", F.when((n % 50 == 0) & (F.col("type") == "cvss"), "spoilt").otherwise(F.col("prompt")))
    again = rows.where("type = 'line_loc'").withColumn("item_id", F.when(n % 70 == 0, F.concat("key", F.lit(":line_loc:1")))).withColumn("index", F.lit(1)).where("item_id IS NOT NULL")
    rows = rows.unionByName(again)
    own = (n % 90 == 0) & (F.col("type") == "exact_id")
    rows = rows.withColumn("user", F.when(own, F.concat("user", F.lit(" "), "key")).otherwise(F.col("user"))).withColumn("prompt", F.when(own, T.chat(SYSTEM, F.col("user"))).otherwise(F.col("prompt")))
    rows = G.stored(rows)  # the checks read it five times
    g = F.col("gold")
    full = F.struct(g["letter"].alias("letter"), F.transform(g["options"], lambda o: F.struct(o["letter"].alias("letter"), o["cwe"].alias("cwe"), F.lit("").alias("name"))).alias("options"), F.regexp_replace(g["cwe"], "^N", "CWE-").alias("cwe"), T.parse_vector(g["vector"], T.VECTOR).alias("vector"), g["vulnerable"].alias("vulnerable"), g["lines"].alias("lines"), g["n_lines"].alias("n_lines"))
    reply = F.regexp_replace("target", r"\bN(\d+)$", "CWE-$1")
    known = rows.where(~F.regexp_replace(g["cwe"], "^N", "").isin("0") | g["cwe"].isNull())
    judged = B.own_verdicts(known, reply, full, F.create_map(F.coalesce(full["cwe"], F.lit("")), F.lit(8)))
    bad = B.item_violations(rows, "key", SYSTEM).union(B.target_violations(judged))
    return bad.groupBy("check").agg(F.count("*").alias("n"))


PARTS = [f"{k}:{v}" for k, vs in T.VECTOR.items() for v in vs]
BASE = {"AV": "substr('NALP', (doc_id % 4 + 1)::INT, 1)", "AC": "'L'", "PR": "substr('NLH', (doc_id % 3 + 1)::INT, 1)", "UI": "'N'", "S": "'U'", "C": "'H'", "I": "'H'", "A": "'N'"}
JOINED = " || '/' || ".join(f"'{k}:' || CASE WHEN starts_with(part, '{k}:') THEN substr(part, {len(k) + 2}) ELSE {k}_ END" for k in BASE)


def vector(spark, d):
    pick = lambda s, n: F.substring(F.lit(s), (F.col("doc_id") % n + 1).cast("int"), F.lit(1))
    parts = {"AV": pick("NALP", 4), "AC": F.lit("L"), "PR": pick("NLH", 3), "UI": F.lit("N"), "S": F.lit("U"), "C": F.lit("H"), "I": F.lit("H"), "A": F.lit("N")}
    return load(spark, d, "documents").select("doc_id", F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]).alias("v"))


@query(f"""WITH t AS (SELECT doc_id, {", ".join(f"{x} AS {k}_" for k, x in BASE.items())} FROM documents), p AS (SELECT t.*, part FROM t, (VALUES {", ".join(f"('{p}')" for p in PARTS)}) AS x(part) WHERE part NOT IN ({", ".join(f"'{k}:' || {k}_" for k in BASE)})),
m AS (SELECT doc_id, arg_min(part, {rank_sql("doc_id::VARCHAR", "'miss'", "part")} || part) AS part FROM p GROUP BY 1) SELECT doc_id, {JOINED} AS miss FROM m JOIN t USING (doc_id)""")
def q_vector_near_miss(spark, d):
    """Each document's vector with one component changed by rank."""
    return vector(spark, d).select("doc_id", B.vector_near_miss(F.col("doc_id").cast("string"), F.col("v"), "miss").alias("miss"))


@query(f"""WITH g AS (SELECT doc_id, doc_id::VARCHAR AS k, CASE doc_id % 3 WHEN 0 THEN [3, 5, 9] WHEN 1 THEN [4] ELSE [7] END AS g FROM documents), c AS (SELECT x FROM range(1, 13) AS r(x) WHERE x % 4 <> 0),
less AS (SELECT doc_id, list_filter(g, lambda x: x <> (list_sort(list_transform(g, lambda y: {rank_sql("k", "'miss'", "y")} || y))[1])[17:]::INT) AS m FROM g WHERE len(g) > 1),
far AS (SELECT doc_id, x, abs(x - g[1]) AS dist, {rank_sql("k", "'miss'", "x")} AS r FROM g, c WHERE len(g) = 1 AND abs(x - g[1]) >= 2),
one AS (SELECT doc_id, x FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dist, r, x) AS n FROM far) WHERE n = 1)
SELECT doc_id, array_to_string(m, ',') AS miss FROM less UNION ALL SELECT doc_id, x::VARCHAR FROM one""")
def q_line_near_miss(spark, d):
    """Line numbers near the gold ones: one dropped by rank, or the nearest far code line."""
    k = F.col("doc_id") % 3
    gold = F.when(k == 0, F.array(F.lit(3), F.lit(5), F.lit(9))).when(k == 1, F.array(F.lit(4))).otherwise(F.array(F.lit(7)))
    code = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda x: x % 4 != 0)
    rows = load(spark, d, "documents").select("doc_id", gold.alias("g"), code.alias("c"))
    return rows.select("doc_id", F.array_join(B.line_near_miss(F.col("doc_id").cast("string"), F.col("g"), F.col("c"), "miss"), ",").alias("miss"))


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'gold' WHEN 1 THEN 'out_of_range' WHEN 2 THEN 'not_one_change' WHEN 4 THEN 'too_close' WHEN 5 THEN 'not_code_line' END AS line_reason, CASE doc_id % 4 WHEN 0 THEN 'malformed' WHEN 1 THEN 'gold' WHEN 2 THEN 'not_one_component' END AS vector_reason FROM documents")
def q_miss_reasons(spark, d):
    """Why proposed near misses, synthetic ones of each sort, are not admitted."""
    k = F.col("doc_id") % 7
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    proposed = F.when(k == 0, arr(9, 5)).when(k == 1, arr(5, 25)).when(k == 2, arr(5, 9, 11)).when(k == 3, arr(5)).when(k == 4, arr(5, 10)).when(k == 5, arr(5, 12)).otherwise(arr(5, 15))
    code = F.filter(F.sequence(F.lit(1), F.lit(20)), lambda x: x != 12)
    gold = T.parse_vector(F.lit(VECTOR), T.VECTOR)
    j = F.col("doc_id") % 4
    vec = F.when(j == 0, VECTOR + "/E:P").when(j == 1, VECTOR.lower()).when(j == 2, VECTOR.replace("AV:N", "AV:L").replace("S:U", "S:C")).otherwise("CVSS:3.1/" + VECTOR.replace("A:H", "A:L"))
    rows = load(spark, d, "documents").select("doc_id", proposed.alias("p"), T.parse_vector(vec, T.VECTOR).alias("v"))
    return rows.select("doc_id", B.line_miss_reason(F.col("p"), arr(5, 9), F.lit(20), code).alias("line_reason"), B.vector_miss_reason(F.col("v"), gold).alias("vector_reason"))


@query(f"WITH {EDGES}, n AS (SELECT child AS a, parent AS b FROM e UNION SELECT parent, child FROM e), p AS (SELECT c_custkey, 'N' || c_nationkey AS gold, CASE c_custkey % 3 WHEN 0 THEN 'N' || c_nationkey ELSE 'R' || (c_custkey % 5) END AS p FROM customer) SELECT c_custkey, CASE WHEN p = gold THEN 'gold' WHEN (gold, p) NOT IN (SELECT (a, b) FROM n) THEN 'not_one_hop' END AS reason FROM p")
def q_id_miss_reasons(spark, d):
    """Whether a proposed label is one step from each customer's nation."""
    rows = load(spark, d, "customer").select("c_custkey", nation().alias("gold"), F.when(F.col("c_custkey") % 3 == 0, nation()).otherwise(F.concat(F.lit("R"), (F.col("c_custkey") % 5).cast("string"))).alias("p"))
    return B.id_miss_reason(rows, "c_custkey", "p", "gold", G.neighbours(edges(spark, d)))


@query("WITH o AS (SELECT c_custkey, c_nationkey AS g, (c_nationkey + s) % 25 AS o, p FROM customer, (VALUES (1, 0), (7, 1), (13, 2)) AS v(s, p)), r AS (SELECT o.*, CASE WHEN x.n_regionkey = y.n_regionkey THEN 2 ELSE 9 END AS dist FROM o JOIN nation x ON x.n_nationkey = g JOIN nation y ON y.n_nationkey = o) SELECT c_custkey, 'N' || o AS option FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY dist, p) AS i FROM r) WHERE i = 1")
def q_nearest_option(spark, d):
    """Of three other nations the one nearest to the customer's own; the first of equally near ones."""
    rows = load(spark, d, "customer").select("c_custkey", nation().alias("gold"), F.posexplode(F.array(*[nation(s) for s in STEPS])).alias("pos", "option"))
    return B.nearest_option(rows, "c_custkey", "option", "gold", "pos", G.distances(edges(spark, d), 3, rows.select("gold")))


def bank_items(spark, d):
    k = F.col("doc_id") % 3
    null = lambda t: F.lit(None).cast(t)
    gold = F.struct(F.substring(F.lit("ABCD"), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1)).alias("letter"), null("array<struct<letter:string,cwe:string,name:string>>").alias("options"), F.lit("CWE-5").alias("cwe"), null("map<string,string>").alias("vector"), (F.col("doc_id") % 2 == 0).alias("vulnerable"), F.array((F.col("doc_id") % 7 + 1).cast("int")).alias("lines"), F.lit(9).alias("n_lines"))
    return load(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 6).alias("unit"), F.when(k == 0, "mcq").when(k == 1, "find_error").otherwise("line_loc").alias("type"), gold.alias("gold"))


@query("""WITH i AS (SELECT doc_id // 6 AS unit, doc_id % 3 AS k, CASE doc_id % 3 WHEN 0 THEN (doc_id % 4 = 0)::INT::DOUBLE WHEN 1 THEN (doc_id % 2 = 0)::INT::DOUBLE ELSE 0.5 END AS m, CASE doc_id % 3 WHEN 0 THEN (doc_id % 4 = 0)::INT::DOUBLE WHEN 1 THEN (doc_id % 2 = 0)::INT * 0.5 ELSE 0.5 END AS ds FROM documents),
u AS (SELECT k, unit, count(*) AS n, sum(m) AS m, sum(ds) AS ds, min(m) AS least FROM i GROUP BY 1, 2)
SELECT CASE k WHEN 0 THEN 'always A' WHEN 1 THEN 'always yes' ELSE 'every third' END AS baseline, CASE k WHEN 0 THEN 'mcq' WHEN 1 THEN 'find_error' ELSE 'line_loc' END AS type, sum(n)::BIGINT AS n, round(sum(m) / sum(n), 6) AS metric, round(sum(ds) / sum(n), 6) AS dense, round(avg((least = 1)::INT::DOUBLE), 6) AS paired FROM u GROUP BY k""")
def q_trivial_baselines(spark, d):
    """Constant replies through the verifiers."""
    replies = {"always A": ("mcq", F.lit("ANSWER: A")), "always yes": ("find_error", F.lit("VULNERABLE: yes")), "every third": ("line_loc", B.every_kth(F.col("gold.n_lines"), 3))}
    out = B.baselines(bank_items(spark, d), replies, "unit", F.create_map(F.lit("CWE-5"), F.lit(8)))
    return out.select("baseline", "type", "n", *[F.round(c, 6).alias(c) for c in ("metric", "dense", "paired")])


@query("SELECT doc_id, 'LINES: ' || coalesce(nullif(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN contains(l, 'the') OR contains(l, 'de') THEN i END), lambda x: x IS NOT NULL), ', '), ''), 'none') AS reply FROM documents WHERE text IS NOT NULL")
def q_keyword_lines(spark, d):
    """The lines of each document that hold one of two words, as a reply."""
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", B.keyword_lines(F.col("text"), ("the", "de")).alias("reply"))


# A document's lines as code: each line's number and its text's hash, so that all differ.
CODED = "SELECT doc_id, len(string_split(text, chr(10))) AS n, len(string_split(text, chr(10))) // 2 + 1 AS t FROM documents WHERE text IS NOT NULL"


@query(f"""WITH d AS ({CODED}) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN t::VARCHAR WHEN 1 THEN t::VARCHAR ELSE (t + 1)::VARCHAR END AS theirs, CASE doc_id % 3 WHEN 0 THEN t::VARCHAR WHEN 1 THEN '' ELSE t::VARCHAR END AS ours,
CASE doc_id % 3 WHEN 0 THEN 'agree' WHEN 1 THEN 'comment_lines_only' ELSE 'insertion_anchor_only' END AS class, CASE WHEN doc_id % 3 = 0 THEN 1.0 WHEN doc_id % 3 = 1 THEN 0.0 ELSE 0.0 END::DOUBLE AS f1 FROM d""")
def q_line_agreement(spark, d):
    """How the lines of two independent diffs differ for changes of documents as code: the middle line replaced; a comment that stood there gone; a line put in behind a comment
    that follows it. f1: of the second diff's code lines against the first's."""
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.lit("L"), i.cast("string"), F.lit(" = x"), F.md5(line.cast("binary")), F.lit(";")))
    k, at = F.col("doc_id") % 3, F.floor(F.size(lines) / 2).cast("int")
    put = lambda *new: F.concat(F.slice(lines, F.lit(1), at), F.array(*new), F.slice(lines, at + F.lit(1), F.size(lines) - at))
    note, come = F.lit("// a note"), F.lit("come();")
    own = F.element_at(lines, at + 1)
    after_own = lambda *new: F.concat(F.slice(lines, F.lit(1), at + 1), F.array(*new), F.slice(lines, at + F.lit(2), F.greatest(F.size(lines) - at - 1, F.lit(0))))
    before = F.when(k == 0, lines).when(k == 1, put(note)).otherwise(after_own(note))
    after = F.when(k == 0, F.transform(lines, lambda x: F.when(x == own, come).otherwise(x))).when(k == 1, lines).otherwise(after_own(note, come))
    rows = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(before, "\n").alias("b"), F.array_join(after, "\n").alias("a"))
    out = B.line_agreement(rows, "doc_id", "b", "a")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("doc_id", text("theirs").alias("theirs"), text("ours").alias("ours"), "class", "f1")


@query(r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d)
SELECT doc_id, sum((i % 5 = 3 AND doc_id % 2 = 0 AND NOT regexp_full_match(line, '[\s]*'))::INT)::INT AS n_deleted, sum((i % 4 = 2 AND doc_id % 2 = 1)::INT)::INT AS n_inserted FROM e GROUP BY doc_id""")
def q_second_diff(spark, d):
    """The shortest script between each document and itself with every fifth line taken out, or a line of its own put in before every fourth."""
    lines = F.split("text", "\n")
    out = F.filter(lines, lambda _, i: i % 5 != 3)
    more = F.flatten(F.transform(lines, lambda x, i: F.when(i % 4 == 2, F.array(F.concat(F.lit("\u00a7"), i.cast("string")), x)).otherwise(F.array(x))))
    rows = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", F.array_join(F.when(F.col("doc_id") % 2 == 0, out).otherwise(more), "\n").alias("a"))
    return rows.select("doc_id", D.second_change(F.col("text"), F.col("a")).alias("c")).select("doc_id", "c.n_deleted", "c.n_inserted")


# Summaries.


@query("SELECT event_type, count(*) AS items, round(avg((value > 20)::INT), 6) AS parse_rate, round(avg((value > 100)::INT), 6) AS strict_rate, round(avg((event_id % 9 = 0)::INT), 6) AS cut_off_rate, round(avg(event_id % 5), 6) AS mean_output_tokens FROM events GROUP BY 1")
def q_type_stats(spark, d):
    """Parse, strict and cut-off rates of events taken as replies."""
    v = F.struct((F.col("value") > 20).alias("parse_ok"), (F.col("value") > 100).alias("strict_ok"))
    rows = load(spark, d, "events").select("event_type", v.alias("v"), F.when(F.col("event_id") % 9 == 0, "length").otherwise("stop").alias("finish"), F.array_repeat(F.lit(1), (F.col("event_id") % 5).cast("int")).alias("ids"))
    return E.type_stats(rows, ["event_type"], "v", "finish", "ids").select("event_type", "items", *[F.round(c, 6).alias(c) for c in ("parse_rate", "strict_rate", "cut_off_rate", "mean_output_tokens")])


@query("WITH w AS (SELECT count(*) AS n_outputs, round(avg(event_id % 5), 1) AS mean, max(event_id % 5) AS longest FROM events) SELECT event_type AS finish, count(*) AS n, any_value(n_outputs) AS n_outputs, any_value(mean) AS mean, any_value(longest) AS longest FROM events, w GROUP BY 1")
def q_output_stats(spark, d):
    rows = load(spark, d, "events").select(F.col("event_type").alias("finish"), F.array_repeat(F.lit(1), (F.col("event_id") % 5).cast("int")).alias("ids"))
    return E.output_stats(rows, "finish", "ids")


@query("WITH a AS (SELECT user_id % 3 + 1 AS attempt, event_type AS status, CASE WHEN event_id % 4 = 0 THEN ['gold'] WHEN event_id % 4 = 1 THEN ['gold', 'duplicate'] ELSE [] END AS r FROM events), x AS (SELECT 'status' AS \"of\", 'attempt ' || attempt || ': ' || status AS value FROM a UNION ALL SELECT 'reason', u FROM a, unnest(r) AS t(u)) SELECT \"of\", value, count(*) AS n FROM x GROUP BY ALL")
def q_attempt_histograms(spark, d):
    """Statuses and reasons of attempts in nested arrays."""
    k = F.col("event_id") % 4
    said = lambda *x: F.array(*[F.struct(F.lit("raw").alias("raw"), F.lit(v).alias("reason")) for v in x])
    rejected = F.when(k == 0, said("gold")).when(k == 1, said("gold", "duplicate")).otherwise(F.array().cast("array<struct<raw:string,reason:string>>"))
    rows = load(spark, d, "events").select(F.array(F.struct((F.col("user_id") % 3 + 1).alias("attempt"), F.col("event_type").alias("status"), rejected.alias("rejected"))).alias("a"))
    return E.attempt_histograms(rows, "a")


@query("WITH s AS (SELECT event_type, event_id, ['model', CASE WHEN event_id % 3 = 0 THEN 'draw' ELSE 'model' END] AS s FROM events), u AS (SELECT event_type, event_id, x AS source, count(*) AS k FROM s, unnest(s) AS t(x) GROUP BY ALL) SELECT event_type, source, sum(k)::BIGINT AS n, count(*) AS items FROM u GROUP BY 1, 2")
def q_source_histogram(spark, d):
    rows = load(spark, d, "events").select("event_type", F.array(F.lit("model"), F.when(F.col("event_id") % 3 == 0, "draw").otherwise("model")).alias("s"))
    return E.source_histogram(rows, ["event_type"], "s")


@query("WITH p AS (SELECT event_type AS type, count(*) AS n, count(*) FILTER (user_id % 5 < 2) AS passed, count(*) FILTER (user_id % 5 = 2) AS retried, count(*) FILTER (user_id % 5 > 2) AS fallback, count(*) FILTER (event_id % 10 = 0) AS leaks FROM events GROUP BY 1), q AS (SELECT *, CASE WHEN passed * 2 >= n THEN 'as_specified' WHEN passed * 10 >= n THEN 'report_quality' ELSE 'floored' END AS band, passed * 2 < n OR fallback * 2 > n AS fires FROM p) SELECT *, (SELECT count(*) FILTER (fires) >= 3 FROM q) AS drops_arm FROM q")
def q_rationale_summary(spark, d):
    """Where rationales of each type came from, and whether the substitution fires."""
    k = F.col("user_id") % 5
    rows = load(spark, d, "events").select(F.col("event_type").alias("type"), F.when(k < 2, "self_a1").when(k == 2, "self_a2").otherwise("gold_only").alias("source"), (F.col("event_id") % 10 == 0).alias("leak"))
    return E.rationale_summary(rows, "type", "source", "leak")


@query("SELECT event_type AS type, count(*) AS n, count(*) FILTER (user_id % 3 = 0) AS first, count(*) FILTER (user_id % 3 = 1) AS second, count(*) FILTER (user_id % 3 = 2) AS rule, CASE WHEN event_type <> 'view' THEN CASE WHEN count(*) FILTER (user_id % 3 = 0) * 2 >= count(*) THEN 'as_specified' WHEN count(*) FILTER (user_id % 3 = 0) * 10 >= count(*) THEN 'report_quality' ELSE 'floored' END END AS band FROM events GROUP BY 1")
def q_preference_summary(spark, d):
    k = F.col("user_id") % 3
    rows = load(spark, d, "events").select(F.col("event_type").alias("type"), F.when(k == 0, "model_a1").when(k == 1, "model_a2").otherwise("rule").alias("source"))
    return E.preference_summary(rows, "type", "source", ["view"])


@query("WITH s AS (SELECT event_type, event_id % 5 AS a, 4 + event_id % 3 AS b FROM events), r AS (SELECT event_type, a // gcd(a, b) AS num, b // gcd(a, b) AS den FROM s) SELECT event_type, num, den, count(*) AS n FROM r GROUP BY ALL")
def q_score_distribution(spark, d):
    """Scores in lowest terms with their counts."""
    rows = load(spark, d, "events").select("event_type", (F.col("event_id") % 5).alias("a"), (F.col("event_id") % 3 + 4).alias("b"))
    return E.score_distribution(rows, ["event_type"], "a", "b")


@query("SELECT max(n_chars) AS longest, max(n_chars) + 512 AS needed, max(n_chars) + 512 <= 17059 AS fits FROM documents")
def q_token_capacity(spark, d):
    """The longest document with room for an answer, against a pinned length."""
    return E.token_capacity(load(spark, d, "documents"), "lang", "n_chars", 512, 17059, [(1, 2)])[1]
