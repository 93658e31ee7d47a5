"""Sources, sinks and scanners of code: queries that write a small fixture made of the driver's tables and read it back, and verdicts on synthetic replies."""

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import code as C
from ..functions import text as T
from ..functions import verify as V
from ..operators import checks as K
from ..operators import graph as G
from ..operators import jobs as W
from ..operators import ledger as L
from ..operators import reconcile as R
from ..operators import similarity as N
from ..operators import training as M
from ..sources import arrays as Y
from ..sources import feeds as X
from ..sources import jsonl as J
from ..tables import load, scratch
from .hierarchies import edges
from .samples import mod_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def documents(spark, d):
    return load(spark, d, "documents")


DOC = T_.StructType([T_.StructField("doc_id", T_.LongType()), T_.StructField("lang", T_.StringType()), T_.StructField("text", T_.StringType())])


@query("SELECT doc_id, lang, sha256(text) AS h FROM documents")
def q_jsonl(spark, d):
    """Documents written as sorted JSON Lines in gzip, and read with their schema."""
    path = scratch(spark, "jsonl")
    J.write_jsonl(documents(spark, d).select("doc_id", "lang", "text"), path, ["doc_id"])
    return J.read_jsonl(spark, path, DOC).select("doc_id", "lang", T.text_hash(F.col("text")).alias("h"))


@query("SELECT count(DISTINCT doc_id) = count(*) AS frozen, count(*) AS rows FROM documents")
def q_freeze(spark, d):
    """A table's hash is the same after a round trip, and another table's is refused."""
    docs = documents(spark, d).select("doc_id", "lang")
    manifest = J.frozen(docs, {}, "docs")
    path = scratch(spark, "frozen")
    docs.repartition(3).write.parquet(path)
    again = J.checked_table(spark.read.parquet(path), manifest, "docs", {})
    try:
        J.frozen(docs.withColumn("doc_id", F.col("doc_id") + 1), manifest, "docs")
        same = False
    except ValueError:
        same = True
    return again.agg(F.lit(same).alias("frozen"), F.count("*").alias("rows"))


PAIR = T_.StructType([T_.StructField("cve", T_.StringType()), T_.StructField("commit", T_.StringType()), T_.StructField("func", T_.StringType()), T_.StructField("target", T_.IntegerType())])


def pairs(spark, d):
    """Two lines for each customer, some of them broken in one of six ways; every fifth pair of lines has a blank line before it."""
    path = scratch(spark, "pairs")
    k, key = F.col("c_custkey") % 10, F.col("c_custkey").cast("string")
    cve = F.when(k == 3, F.concat(F.lit("CVE-"), key)).otherwise(F.concat(F.lit("CVE-2016-"), F.lpad(key, 5, "0"), F.substring(key, 6, 20)))
    row = lambda commit, func, target: F.to_json(F.struct(cve.alias("cve"), commit.alias("commit"), func.alias("func"), target.alias("target")))
    body = F.concat(F.lit("int f"), key, F.lit("() { return 1; }"))
    fixed = F.when(k == 5, body).when(k == 6, F.lit("shared")).otherwise(F.concat(F.lit("int f"), key, F.lit("() { return 2; }")))
    first = row(F.concat(F.lit("c"), key), F.when(k == 4, " ").otherwise(body), F.when(k == 1, 0).otherwise(1))
    second = row(F.concat(F.lit("c"), F.when(k == 2, "x").otherwise(key)), fixed, F.lit(0))
    blank = F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    lines = load(spark, d, "customer").select("c_custkey", F.posexplode(F.concat(blank, F.array(first, second))).alias("i", "value"))
    lines.coalesce(1).sortWithinPartitions("c_custkey", "i").select("value").write.text(path)
    return J.read_pairs(spark, path, PAIR, F.struct("first.cve", "second.func"))


@query("SELECT (2 * row_number() OVER (ORDER BY c_custkey) - 1 + sum((c_custkey % 5 = 0)::INT) OVER (ORDER BY c_custkey))::BIGINT AS first_line, CASE c_custkey % 10 WHEN 1 THEN 'bad_target_order' WHEN 2 THEN 'cross_commit_or_cve' WHEN 3 THEN 'malformed_cve' WHEN 4 THEN 'empty_function' WHEN 5 THEN 'identical_text' WHEN 6 THEN CASE WHEN (SELECT count(*) FROM customer WHERE c_custkey % 10 = 6) > 1 THEN 'shared_patched_function' END END AS reason FROM customer")
def q_pairs_scan(spark, d):
    """Pairs of lines with their first line's number and the first reason against them."""
    p = pairs(spark, d)
    uses = p.groupBy(T.text_hash(F.col("second.func")).alias("h")).agg(F.count("*").alias("uses"))
    p = p.withColumn("h", T.text_hash(F.col("second.func"))).join(uses, "h")
    f, s = F.col("first"), F.col("second")
    reasons = K.pair_checks(f["target"], s["target"], f["commit"] == s["commit"], f["cve"] == s["cve"], f["cve"], f["func"], s["func"], F.col("uses") > 1)
    return L.with_fate(p, reasons).select("first_line", "reason")


RECORD = T_.StructType([
    T_.StructField("id", T_.StringType()), T_.StructField("lastModified", T_.StringType()),
    T_.StructField("descriptions", T_.ArrayType(T_.StructType([T_.StructField("lang", T_.StringType()), T_.StructField("value", T_.StringType())]))),
    T_.StructField("weaknesses", T_.ArrayType(T_.StructType([T_.StructField("source", T_.StringType()), T_.StructField("description", T_.ArrayType(T_.StructType([T_.StructField("lang", T_.StringType()), T_.StructField("value", T_.StringType())])))]))),
])


def feeds(spark, d):
    """Two yearly feeds of customers, and a third file that isn't one: those of one market segment are in both, with a later change in the second, or, with
    a debt, one at the same time."""
    path = scratch(spark, "feeds")
    key = F.col("c_custkey").cast("string")
    text = lambda *p: F.array(*[F.struct(F.lit(a).alias("lang"), b.alias("value")) for a, b in p])

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def feed(rows, year, when, name, compression="none"):
        """A feed's file, a line for each record, written by one task as they come."""
        own = F.array(F.struct(F.lit("nvd").alias("source"), text(("en", F.concat(F.lit(" CWE-"), (F.col("c_custkey") % 7 + 1).cast("string"))), ("en", F.lit("CWE-1")), ("fr", F.lit("CWE-9")), ("en", F.lit(" "))).alias("description")), F.struct(F.lit("cna").alias("source"), text(("en", F.lit("CWE-99"))).alias("description")))
        record = F.struct(F.concat(F.lit("CVE-"), key).alias("id"), when.alias("lastModified"), text(("fr", F.lit("non")), ("en", F.lit(" ")), ("en", F.concat(F.lit(" from "), F.lit(str(year)), F.lit(" ")))).alias("descriptions"), own.alias("weaknesses"))
        first = F.broadcast(rows.agg(F.min("c_custkey").alias("_first")))  # one row
        comma = F.when(F.col("c_custkey") == F.col("_first"), "").otherwise(",")
        lines = rows.crossJoin(first).select(F.lit(1).alias("o"), "c_custkey", F.concat(comma, F.to_json(F.struct(record.alias("cve")))).alias("value"))
        ends = spark.createDataFrame([(0, 0, f'{{"timestamp": "{year}-12-31", "vulnerabilities": ['), (2, 0, "]}")], "o int, c_custkey long, value string")
        out = f"{path}-{year}"
        lines.union(ends).coalesce(1).sortWithinPartitions("o", "c_custkey").select("value").write.option("compression", compression).text(out)
        (made,) = [f.getPath() for f in fs.listStatus(hadoop.Path(out)) if f.getPath().getName().startswith("part-")]
        fs.mkdirs(hadoop.Path(path))
        fs.rename(made, hadoop.Path(f"{path}/{name}"))

    def put(name, data):
        out = fs.create(hadoop.Path(f"{path}/{name}"))
        out.write(bytearray(data.encode()))
        out.close()

    c = load(spark, d, "customer")
    feed(c, 2020, F.lit("2020-05-05"), "nvdcve-2.0-2020.json.gz", "gzip")
    feed(c.where("c_mktsegment = 'BUILDING'"), 2021, F.when(F.col("c_acctbal") < 0, "2020-05-05").otherwise("2021-01-01"), "nvdcve-2.0-2021.json")
    sha = spark.read.format("binaryFile").load(f"{path}/nvdcve-2.0-2021.json").select(F.sha2("content", 256)).first()[0]
    put("nvdcve-2.0-2021.meta", f"lastModifiedDate:x\nsha256:{sha.upper()}\n")
    put("nvdcve-2.0-recent.json", "{}")
    return Y.stream_feeds(spark, path, RECORD)


@query("SELECT 'CVE-' || c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal >= 0 THEN 'nvdcve-2.0-2021.json' ELSE 'nvdcve-2.0-2020.json.gz' END AS feed, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal >= 0 THEN 'from 2021' ELSE 'from 2020' END AS description, array_to_string(list_sort(list_distinct(['CWE-' || (c_custkey % 7 + 1), 'CWE-1'])), ',') AS labels FROM customer WHERE c_acctbal < 5000")
def q_feed_extract(spark, d):
    """Records that are needed from checked yearly feeds, the latest of each id, with the English text and a source's labels."""
    needed = load(spark, d, "customer").where("c_acctbal < 5000").select(F.concat(F.lit("CVE-"), F.col("c_custkey").cast("string")).alias("id"))
    got = X.extract(feeds(spark, d), needed)
    return got.select("id", "feed", X.english(F.col("descriptions")).alias("description"), F.array_join(X.label_values(F.col("weaknesses"), "nvd"), ",").alias("labels"))


@query("SELECT count(*) + (SELECT count(*) FROM supplier) AS needed, count(*) AS found, (SELECT count(*) FROM supplier) AS missing, count(*) FILTER (c_mktsegment = 'BUILDING') AS duplicates FROM customer WHERE c_acctbal < 5000")
def q_feed_statistics(spark, d):
    """How many of the needed ids the feeds have; suppliers are in none."""
    needed = load(spark, d, "customer").where("c_acctbal < 5000").select(F.concat(F.lit("CVE-"), F.col("c_custkey").cast("string")).alias("id"))
    needed = needed.union(load(spark, d, "supplier").select(F.concat(F.lit("none-"), F.col("s_suppkey").cast("string"))))
    return X.extract_statistics(feeds(spark, d), needed)


def taxonomy(spark, d):
    """Regions as pillars, nations as their children, one deprecated weakness, one outside the view, a category and a view."""
    path = scratch(spark, "taxonomy")
    nations = load(spark, d, "nation").orderBy("n_nationkey").collect()
    weakness = lambda i, name, kind, status, up="", note="": f'<Weakness ID="{i}" Name="{name}" Abstraction="{kind}" Status="{status}"><Description>{note}</Description>{up}</Weakness>'
    up = lambda p, view=1000: f'<Related_Weaknesses><Related_Weakness Nature="ChildOf" CWE_ID="{p}" View_ID="{view}"/><Related_Weakness Nature="PeerOf" CWE_ID="1" View_ID="1000"/></Related_Weaknesses>'
    rows = [weakness(900 + r, f"region {r}", "Pillar", "Stable") for r in sorted({n.n_regionkey for n in nations})]
    rows += [weakness(n.n_nationkey + 1, n.n_name, "Base", "Draft", up(900 + n.n_regionkey)) for n in nations]
    rows += [weakness(800, "old", "Base", "Deprecated", "", "See\n   CWE-1."), weakness(801, "lost", "Base", "Draft", up(1, 699))]
    text = f'<?xml version="1.0"?>\n<Weakness_Catalog Version="4.20">\n<Weaknesses>{"".join(rows)}</Weaknesses>\n<Categories><Category ID="700" Name="c" Status="Draft"/></Categories>\n<Views><View ID="1000" Name="v" Status="Draft"/></Views>\n</Weakness_Catalog>'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return X.read_taxonomy(spark, path, release="4.20")


@query("SELECT (n_nationkey + 1)::VARCHAR AS id, n_name AS name, 'weakness' AS kind, false AS is_deprecated, true AS in_view, NULL AS description FROM nation UNION ALL SELECT DISTINCT (900 + n_regionkey)::VARCHAR, 'region ' || n_regionkey, 'weakness', false, true, NULL FROM nation UNION ALL VALUES ('800', 'old', 'weakness', true, false, 'See CWE-1.'), ('801', 'lost', 'weakness', false, false, NULL), ('700', 'c', 'category', false, false, NULL), ('1000', 'v', 'view', false, false, NULL)")
def q_taxonomy(spark, d):
    """Nodes of an XML taxonomy with their flags."""
    nodes, e = taxonomy(spark, d)
    return G.node_flags(nodes, e).select("id", "name", "kind", "is_deprecated", "in_view", "description")


@query("SELECT 'in the view' AS \"check\", '801' AS key UNION ALL SELECT 'mapped', '800' UNION ALL SELECT DISTINCT 'live ends', '999' FROM nation WHERE n_nationkey = 1 UNION ALL SELECT 'no cycle', unnest([(n_nationkey + 1)::VARCHAR, (900 + n_regionkey)::VARCHAR]) FROM nation WHERE n_nationkey = 0")
def q_hierarchy_violations(spark, d):
    """Invariants of that taxonomy, with an edge from a nation to an unknown node, and one from another nation's region back to it."""
    nodes, e = taxonomy(spark, d)
    nation = load(spark, d, "nation")
    text = lambda c: c.cast("string")
    back = nation.where("n_nationkey = 0").select(text(F.col("n_regionkey") + 900).alias("child"), text(F.col("n_nationkey") + 1).alias("parent"))
    lost = nation.where("n_nationkey = 1").select(text(F.col("n_nationkey") + 1).alias("child"), F.lit("999").alias("parent"))
    mapped = nation.select(text(F.col("n_nationkey")).alias("id"))
    return K.hierarchy(G.node_flags(nodes, e), e.union(lost).union(back), mapped).select("check", "key")


@query("WITH RECURSIVE m AS (SELECT max(o_custkey) + 1 AS m FROM orders), e AS (SELECT DISTINCT o_custkey AS a, o_orderkey * 7919 % m AS b FROM orders, m), r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a), s AS (SELECT p.x AS id, p.y AS other FROM r p JOIN r q ON p.x = q.y AND p.y = q.x) SELECT id, least(id, min(other)) AS component FROM s GROUP BY id")
def q_strong_components(spark, d):
    """Customers as a directed graph, each order an edge, loops too: which are on a cycle, and with which."""
    o = load(spark, d, "orders")
    m = F.broadcast(o.agg((F.max("o_custkey") + 1).alias("m")))  # one row
    e = o.crossJoin(m).select(F.col("o_custkey").alias("child"), (F.col("o_orderkey") * 7919 % F.col("m")).alias("parent"))
    return G.strong_components(e)


METRIC = "array<struct<source:string,cvssData:struct<version:string,vectorString:string,attackVector:string,attackComplexity:string,privilegesRequired:string,userInteraction:string,scope:string,confidentialityImpact:string,integrityImpact:string,availabilityImpact:string>>>"


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'no_cvss' WHEN 1 THEN 'ok' WHEN 2 THEN 'cna_only_v3' WHEN 3 THEN 'invalid_vector' WHEN 4 THEN 'version_mismatch' WHEN 5 THEN 'decomposed_mismatch' ELSE 'conflicting_nvd_vectors' END AS reason, CASE WHEN doc_id % 7 = 1 THEN 'AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H' END AS vector FROM documents")
def q_vector_selection(spark, d):
    """The vector of synthetic metrics, or the reason why there is none."""
    k = F.col("doc_id") % 7
    good, other = "CVSS:3.1/A:H/I:H/C:H/S:U/UI:N/PR:N/AC:L/AV:N", "CVSS:3.1/A:L/I:H/C:H/S:U/UI:N/PR:N/AC:L/AV:N"
    words = lambda av: [F.lit(av).alias("attackVector")] + [F.lit(None).cast("string").alias(x) for x in ("attackComplexity", "privilegesRequired", "userInteraction", "scope", "confidentialityImpact", "integrityImpact", "availabilityImpact")]
    one = lambda source, vec, av="NETWORK": F.struct(F.lit(source).alias("source"), F.struct(F.lit("3.1").alias("version"), F.lit(vec).alias("vectorString"), *words(av)).alias("cvssData"))
    v31 = F.when(k == 1, F.array(one("nvd", good))).when(k == 2, F.array(one("cna", good))).when(k == 3, F.array(one("nvd", good + "/E:P"))).when(k == 4, F.array(one("nvd", good.replace("3.1", "3.0")))).when(k == 5, F.array(one("nvd", good, "LOCAL"))).when(k == 6, F.array(one("nvd", good), one("nvd", other)))
    m = F.struct(v31.cast(METRIC).alias("cvssMetricV31"), *[F.lit(None).cast(METRIC).alias(c) for c in ("cvssMetricV30", "cvssMetricV2", "cvssMetricV40")])
    return documents(spark, d).select("doc_id", X.select_vector(m, "nvd").alias("s")).select("doc_id", "s.reason", "s.vector")


# Code.


def source(k):
    """A function with comments, or with an open literal, by a number."""
    n = k.cast("string")
    return F.when(k % 3 == 0, F.concat(F.lit("int f"), n, F.lit("(int a) // first\n{\n  /* two\n lines */ return a + "), n, F.lit(";\n}"))).when(k % 3 == 1, F.concat(F.lit("s = \"// not a comment\"; // "), n)).otherwise(F.concat(F.lit("char *s = \"open\nx"), n, F.lit("; // kept")))


@query("SELECT doc_id, doc_id % 3 <> 2 AS ok, CASE doc_id % 3 WHEN 0 THEN 'int f' || doc_id || '(int a)         ' || chr(10) || '{' || chr(10) || '        ' || chr(10) || '          return a + ' || doc_id || ';' || chr(10) || '}' WHEN 1 THEN 's = \"// not a comment\"; ' || repeat(' ', 3 + length(doc_id::VARCHAR)) ELSE 'char *s = \"open' || chr(10) || 'x' || doc_id || '; // kept' END AS masked FROM documents")
def q_mask_comments(spark, d):
    """Synthetic sources with their comments blanked, or left alone where a literal isn't closed."""
    rows = documents(spark, d).select("doc_id", C.masked(source(F.col("doc_id"))).alias("m"))
    return rows.select("doc_id", "m.ok", F.col("m.text").alias("masked"))


@query("SELECT min(doc_id) AS first, count(*) AS n FROM documents GROUP BY doc_id % 10")
def q_code_bodies(spark, d):
    """Groups of sources that are equal but for white space and comments."""
    k = F.col("doc_id")
    text = F.concat(F.lit("int f() { /* "), k.cast("string"), F.lit(" */\n  return "), (k % 10).cast("string"), F.lit(";"), F.repeat(F.lit(" "), (k % 4).cast("int")), F.lit("\n}\n// tail "), k.cast("string"))
    return documents(spark, d).groupBy(T.body_hash(C.masked_text(text)).alias("h")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).select("first", "n")


@query("WITH c AS (SELECT c_custkey AS k, c_custkey // 4 AS g FROM customer) SELECT x.g AS a, y.g AS b, 'exact' AS kind, 1.0::DOUBLE AS jaccard FROM (SELECT DISTINCT g FROM c) x JOIN (SELECT DISTINCT g FROM c) y ON x.g < y.g AND x.g % 40 = y.g % 40")
def q_code_links(spark, d):
    """One link for each two groups of customers with near-duplicate sources, the strongest."""
    g, k = F.floor(F.col("c_custkey") / 4), F.col("c_custkey")
    text = F.concat(F.lit("// "), k.cast("string"), F.lit("\nint a"), (g % 40).cast("string"), F.lit(";\nint b"), (g % 40).cast("string"), F.lit(";\nint c"), (g % 40).cast("string"), F.lit(";\nint d;"))
    rows = load(spark, d, "customer").select(g.alias("g"), (k % 4).alias("side"), text.alias("t"))
    return N.entity_links(rows, "g", "side", "t").select("a", "b", "kind", "jaccard")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '3' WHEN 1 THEN '2' WHEN 2 THEN '' ELSE '1,2,3' END AS lines, (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 3 END)::INT AS n_inserted, (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 0 END)::INT AS n_deleted, CASE doc_id % 4 WHEN 2 THEN 'empty_patch' WHEN 0 THEN 'patch_over_20pct' WHEN 1 THEN 'patch_over_20pct' ELSE 'patch_over_20pct' END AS reason FROM documents")
def q_line_change(spark, d):
    """Gold lines of synthetic changes: one replaced, one inserted, a comment only, all new; and the first filter that drops the pair."""
    k = F.col("doc_id") % 4
    old = "int f()\n{\n  return 1;\n}"
    new = F.when(k == 0, old.replace("1;", "2;")).when(k == 1, old.replace("{\n", "{\n  g();\n")).when(k == 2, old.replace("1;", "1; /* c */")).otherwise("void g()\n[\n  stop();\n}")
    rows = documents(spark, d).select("doc_id", C.line_change(F.lit(old), new).alias("c"))
    return L.with_fate(rows, K.patch_checks(F.col("c"), F.lit(10), 10_000)).select("doc_id", F.array_join("c.lines", ",").alias("lines"), "c.n_inserted", "c.n_deleted", "reason")


@query("WITH d AS (SELECT doc_id, doc_id % 8 AS k FROM documents), v AS (SELECT doc_id, CASE k WHEN 1 THEN 'as many lines' WHEN 2 THEN 'under the token cap' WHEN 3 THEN 'no own sibling' WHEN 4 THEN 'canonical vector' WHEN 5 THEN 'known version' WHEN 6 THEN 'lines come again' WHEN 7 THEN 'live label' END AS c FROM d) SELECT c AS \"check\", doc_id::VARCHAR AS key FROM v WHERE c IS NOT NULL")
def q_fact_violations(spark, d):
    """Invariants of synthetic facts, each of seven sorts breaking one."""
    k = F.col("doc_id") % 8
    old = "\n".join(f"line {i};" for i in range(1, 11))
    rows = documents(spark, d).select("doc_id", F.lit(old).alias("vuln"), F.when(k == 6, old).otherwise(old.replace("line 3;", "new 3;")).alias("patched"), F.array(F.lit(3)).alias("lines"), F.when(k == 1, 11).otherwise(10).alias("n_lines"), F.lit(10).alias("n_code_lines"), F.lit(1).alias("n_inserted"), F.when(k == 2, 200).otherwise(50).alias("tokens_vuln"), F.lit(50).alias("tokens_patched"), F.lit("CWE-79").alias("cwe"), F.when(k == 3, F.array(F.lit("CWE-79"))).otherwise(F.array(F.lit("CWE-80"))).alias("cwe_siblings"), (k != 7).alias("in_view"), F.when(k == 4, "av:n/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H").otherwise("AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H").alias("vector"), F.when(k == 5, "4.0").otherwise("3.1").alias("version"))
    rows = rows.withColumn("c", C.line_change("vuln", "patched"))
    return K.row_checks(rows, "doc_id", W.fact_checks(F.col("c"), 100)).select("check", "key")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'f' || doc_id WHEN 1 THEN 'A::~B,B' WHEN 2 THEN 'PHP_FUNCTION,g' || doc_id ELSE '' END AS names, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS named FROM documents")
def q_function_names(spark, d):
    """Names in synthetic headers, and whether a description holds one as a whole word."""
    k, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit("/* h(x) */ static int f"), n, F.lit("(int a)\n{ g(); }"))).when(k == 1, "A::~B()\n{").when(k == 2, F.concat(F.lit("PHP_FUNCTION(g"), n, F.lit(")\n{"))).otherwise("  while (1) { x++; }")
    desc = F.when(k == 0, F.concat(F.lit("In f"), n, F.lit(", a flaw."))).when(k == 1, "B is wrong").otherwise(F.concat(F.lit("fine g"), n, F.lit("x")))
    rows = documents(spark, d).select("doc_id", C.names(text).alias("names"), desc.alias("d"))
    return rows.select("doc_id", F.array_join("names", ",").alias("names"), T.holds_word(F.col("d"), F.col("names")).alias("named"))


# Replies.


def gold(spark, d):
    """Items of each type with replies: right, lenient, wrong, unreadable."""
    k = F.col("doc_id") % 5
    null = lambda t: F.lit(None).cast(t)
    g = F.struct(F.lit("B").alias("letter"), null("array<struct<letter:string,cwe:string,name:string>>").alias("options"), F.lit("CWE-79").alias("cwe"), T.parse_vector(F.lit("AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"), T.VECTOR).alias("vector"), F.lit(True).alias("vulnerable"), F.array(F.lit(3), F.lit(9)).alias("lines"), F.lit(12).alias("n_lines"))
    kinds = ["mcq", "exact_id", "cvss", "find_error", "line_loc"]
    said = {
        "mcq": ["ANSWER: B", "answer: (B)", "ANSWER: C", "dunno"], "exact_id": ["CWE-79", "I say cwe 79.", "CWE-20", "dunno"],
        "cvss": ["AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "AV: network, AC:L PR:N UI:N S:U C:H I:H A:L", "AV:P", "dunno"],
        "find_error": ["VULNERABLE: yes, CWE-79", "it is vulnerable: CWE-20", "VULNERABLE: no", "dunno"], "line_loc": ["LINES: 3, 9", "Lines: 4 and 9", "LINES: 1", "dunno"],
    }
    j = F.floor(F.col("doc_id") / 5) % 4
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (j + 1).cast("int"))
    kind, reply = F.lit(kinds[4]), pick(said["line_loc"])
    for i in reversed(range(4)):
        kind, reply = F.when(k == i, kinds[i]).otherwise(kind), F.when(k == i, pick(said[kinds[i]])).otherwise(reply)
    rows = documents(spark, d).select("doc_id", kind.alias("type"), reply.alias("reply"), g.alias("gold"))
    credits = F.create_map(F.lit("CWE-79"), F.lit(8), F.lit("CWE-20"), F.lit(2))
    return rows.withColumn("v", V.verdict(F.col("type"), F.col("reply"), F.col("gold"), credits))


SCORE = {0: [(1, 1), (1, 1), (0, 0), (0, 0)], 1: [(1, 1), (1, 1), (0, 0.25), (0, 0)], 2: [(1, 1), (0.875, 0.875), (0, 0), (0, 0)], 3: [(1, 1), (1, 0.625), (0, 0), (0, 0)], 4: [(1, 1), (1, 1), (0, 0), (0, 0)]}


def scores(i: int) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN [{', '.join(str(float(x[i])) for x in v)}]" for k, v in SCORE.items()) + " END"


@query(f"WITH d AS (SELECT doc_id, doc_id % 5 AS k, (doc_id // 5 % 4 + 1)::INT AS j FROM documents) SELECT doc_id, j < 4 AS parse_ok, CASE WHEN k = 2 THEN j = 1 ELSE j IN (1, 3) END AS strict_ok, ({scores(0)})[j]::DOUBLE AS metric, ({scores(1)})[j]::DOUBLE AS dense FROM d")
def q_verdicts(spark, d):
    """Verdicts of all five types on right, lenient, wrong and unreadable replies."""
    v = gold(spark, d)
    return v.select("doc_id", "v.parse_ok", "v.strict_ok", (F.col("v.metric.n") / F.col("v.metric.d")).alias("metric"), (F.col("v.dense.n") / F.col("v.dense.d")).alias("dense"))


@query("WITH d AS (SELECT doc_id, doc_id % 5 AS k, doc_id // 5 % 4 AS j, doc_id % 2 AS cut FROM documents) SELECT doc_id, CASE WHEN j = 3 THEN CASE WHEN cut = 0 THEN 'parse_failure' END WHEN j = 1 THEN CASE WHEN k = 3 THEN 'no_field' ELSE 'lenient_not_strict' END WHEN j = 2 AND k = 2 THEN 'no_field' END AS category FROM d")
def q_review_category(spark, d):
    """Why replies want a look; those cut off and unreadable don't."""
    v = gold(spark, d).withColumn("finish", F.when(F.col("doc_id") % 2 == 0, "stop").otherwise("length"))
    return v.select("doc_id", V.review_category(F.col("type"), F.col("reply"), F.col("finish"), F.col("v")).alias("category"))


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'truncated' WHEN 1 THEN 'empty' WHEN 2 THEN 'no_final_answer' WHEN 3 THEN 'wrong_final_answer' WHEN 4 THEN 'no_reasoning' WHEN 5 THEN 'hint_leak' END AS reason, CASE WHEN doc_id % 7 = 6 THEN 'It writes past the end.' || chr(10) || chr(10) || 'CWE-79' END AS target FROM documents")
def q_rationale(spark, d):
    """Synthetic rationales with the first reason against each, or the target that is made of it."""
    k = F.col("doc_id") % 7
    text = F.when(k == 0, "It writes past").when(k == 1, "  \n ").when(k == 2, "It writes past the end.\nso it is").when(k == 3, "It writes past the end.\nCWE-20").when(k == 4, "\nCWE-79\n").when(k == 5, "As the hint says, it writes.\nCWE-79").otherwise(" It writes past the end.\n\ncwe-79.\n")
    verdict = lambda c: F.struct(V.parse_id(c).isNotNull().alias("parse_ok"), V.parse_id(c).alias("parsed"))
    r = V.rationale(text, F.when(k == 0, "length").otherwise("stop"), F.lit("CWE-79"), verdict(T.final_line(text)), verdict(F.lit("CWE-79")))
    return documents(spark, d).select("doc_id", r.alias("r")).select("doc_id", "r.reason", "r.target")


@query("SELECT doc_id // 10 AS unit, count(*) FILTER (doc_id // 5 % 4 NOT IN (0, 1)) = 0 AS both_right, count(*) FILTER (doc_id // 5 % 4 <> 0) = 0 AS both_strict FROM documents WHERE doc_id % 5 = 3 GROUP BY 1")
def q_paired_accuracy(spark, d):
    """Units of two replies on labels: both right, and the exact id as well."""
    rows = gold(spark, d).withColumn("unit", F.floor(F.col("doc_id") / 10))
    return V.both_right(rows, ["unit"], "type", "v")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'AV:N/AC:L/PR:N/UI:R/S:U/C:H/I:L/A:N' ELSE NULL END AS canonical FROM documents")
def q_canonical_vector(spark, d):
    """Vectors in any order and case brought to the canonical one; doubled or unknown components refuse."""
    k = F.col("doc_id") % 3
    said = F.when(k == 0, "AV:N/AC:L/PR:N/UI:R/S:U/C:H/I:L/A:N/A:N").when(k == 1, "cvss:3.0/a:n/i:l/c:h/s:u/ui:r/pr:n/ac:l/av:n").otherwise("AV:X/AC:L/PR:N/UI:R/S:U/C:H/I:L/A:N")
    parts = T.parse_vector(said, T.VECTOR)
    return documents(spark, d).select("doc_id", F.when(parts.isNotNull(), T.canonical_vector(parts, tuple(T.VECTOR))).alias("canonical"))


@query("SELECT doc_id, array_to_string(CASE WHEN doc_id % 2 = 0 THEN [4, 5, -1] ELSE [4, 5] END, ',') AS ids, (CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 2 END)::INT AS first_difference FROM documents")
def q_stop_and_difference(spark, d):
    """Token ids without the stop token, and where they first differ from others."""
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    ids = T.stop_normalised(F.when(F.col("doc_id") % 2 == 0, arr(4, 5, 9)).otherwise(arr(4, 5)), 9)
    return documents(spark, d).select("doc_id", F.array_join(ids, ",").alias("ids"), T.first_difference(ids, arr(4, 5, -1)).alias("first_difference"))


@query("SELECT user_id, event_type AS kind, event_id AS pos, 'item' || (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 3 AS item, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 3 + 1)::BIGINT AS used FROM events")
def q_replacements(spark, d):
    """Events as requests, each answered from its type's queue of three items, which starts again at its end."""
    e = load(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("pos"))
    line = e.select("kind").distinct().select("kind", F.posexplode(F.array(*[F.lit(f"item{i}") for i in range(3)])).alias("o", "item"))
    return M.replacements(e, "kind", "pos", line, "item", "o").select("user_id", "kind", "pos", "item", F.col("used").cast("long").alias("used"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'early' WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'stale' END AS verdict, 0.25::DOUBLE AS gap FROM documents")
def q_sync_verdicts(spark, d):
    """Whether replies come from the current weights, by mean gaps and drift."""
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    gap = M.mean_absolute_gap(arr(1, 2), arr(1, 2.5))
    drift, start = F.when(F.col("doc_id") % 3 == 0, 0.001).otherwise(1.0), F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.3)
    return documents(spark, d).select("doc_id", M.sync_verdict(gap, start, drift, 0.01, 0.5).alias("verdict"), gap.alias("gap"))


@query("SELECT doc_id, lang FROM documents")
def q_covered_join(spark, d):
    """Requests with exactly one result each."""
    docs = documents(spark, d)
    return R.full_coverage(docs.select("doc_id"), docs.select("doc_id", "lang"), "doc_id").select("doc_id", "lang")


# Jobs.


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'not_in_source' WHEN toxic = 1 THEN 'rejected' ELSE 'ok' END AS \"join\", CASE WHEN quality IS NULL THEN NULL WHEN quality = 0 THEN 'no_description' WHEN doc_id % 2 = 0 THEN 'bad_published' ELSE 'ok' END AS complete FROM documents LEFT JOIN labels USING (doc_id)")
def q_entity_status(spark, d):
    """Documents by what their label says of them as records of a source."""
    source = load(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "Rejected").otherwise("Analyzed").alias("s"), F.when(F.col("quality") == 1, "text").otherwise(" ").alias("d"), F.when(F.col("doc_id") % 2 == 0, "soon").otherwise("2020-01-01T00:00:00").alias("p"))
    return W.entity_status(documents(spark, d).select("doc_id"), "doc_id", source, "s", "Rejected", "d", "p").select("doc_id", "join", "complete")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'self_a1' WHEN toxic = 0 THEN 'self_a2' ELSE 'gold_only' END AS source, CASE WHEN quality = 1 THEN 'one' WHEN toxic = 0 THEN 'two' ELSE 'gold' END AS result FROM labels")
def q_two_attempts(spark, d):
    """Each label's first valid attempt, or its gold."""
    labels = load(spark, d, "labels")
    first = labels.select("doc_id", F.lit(1).alias("attempt"), F.lit("one").alias("result"), F.when(F.col("quality") == 0, "empty").alias("reason"))
    second = labels.where("quality = 0").select("doc_id", F.lit(2).alias("attempt"), F.lit("two").alias("result"), F.when(F.col("toxic") == 1, "truncated").alias("reason"))
    return W.two_attempts(labels.select("doc_id", F.lit("gold").alias("gold")), "doc_id", first.union(second), "gold", ("self_a1", "self_a2", "gold_only")).select("doc_id", "source", "result")


@query("SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0")
def q_wanted_retries(spark, d):
    labels = load(spark, d, "labels")
    first = labels.select("doc_id", F.lit(1).alias("attempt"), F.when(F.col("quality") == 0, "empty").alias("reason"))
    return W.wanted_retries(first.union(labels.where("toxic = 1").select("doc_id", F.lit(2), F.lit(None).cast("string"))), "doc_id")


@query("SELECT c_custkey, '- R' || n_regionkey || ': region ' || n_regionkey || ' (more general)' || coalesce((SELECT string_agg(chr(10) || '- S' || s_suppkey || ': ' || s_name || ' (more specific)', '' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey), '') AS neighbours FROM customer JOIN nation ON n_nationkey = c_nationkey")
def q_neighbour_lists(spark, d):
    """The neighbours of each customer's nation as lines of a prompt."""
    golds = load(spark, d, "customer").select("c_custkey", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("gold"))
    names = load(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name")).union(load(spark, d, "nation").select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))).distinct())
    number = F.when(F.col("id").startswith("R"), -1).otherwise(F.substring("id", 2, 20).cast("int"))
    return W.neighbour_lists(golds, "c_custkey", "gold", edges(spark, d), names, number)


@query(f"SELECT 'audit:' || doc_id || ':a1' AS request_id, {mod_sql('2147483648', 'doc_id::VARCHAR', chr(39) + 'audit' + chr(39))} AS seed, 'm1' AS model, n_chars + 128 AS room FROM documents")
def q_session_requests(spark, d):
    """A request for each document, with its seed and the room that it needs."""
    docs = documents(spark, d).select(F.col("doc_id").cast("string").alias("item"), "n_chars")
    r = W.requests(docs, "item", "audit", 1, F.concat(F.lit("Read "), F.col("item")), "Be brief.", F.col("n_chars"), {"model": F.lit("m1")}, {"n": 8, "max_tokens": 128}, "audit")
    return r.select("request_id", F.get_json_object("sampling", "$.seed").cast("long").alias("seed"), "model", (F.col("prompt_tokens") + F.get_json_object("sampling", "$.max_tokens").cast("long")).alias("room"))


@query("SELECT max(n_chars) + 128 AS needed FROM documents")
def q_session_capacity(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").cast("string").alias("item"), "n_chars")
    return W.capacity(W.requests(docs, "item", "audit", 1, F.col("item"), "", F.col("n_chars"), {}, {"max_tokens": 128}))


def rollouts(spark, d):
    """Events as rollouts: views answer labels, clicks name lines."""
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "find_error").when(F.col("event_type") == "click", "line_loc").otherwise("mcq")
    parsed = F.when(kind == "find_error", F.when(k % 20 == 0, "VULNERABLE: no").otherwise("VULNERABLE: yes, CWE-1")).when(kind == "line_loc", F.when(k % 3 == 0, "LINES: none").otherwise("LINES: 3, 4")).otherwise("B")
    score = F.struct((k % 5).cast("int").alias("n"), F.lit(4).alias("d"))
    v = F.struct(parsed.alias("parsed"), (k % 7 != 0).alias("parse_ok"), score.alias("metric"), score.alias("dense"))
    rows = load(spark, d, "events").select((F.floor(k / 50) + 1).alias("step"), kind.alias("kind"), F.col("user_id").alias("g"), (k % 2).cast("int").alias("index"), v.alias("v"), (k % 11 == 0).alias("cut"), (k % 13).alias("tokens"))
    return W.monitor(rows, F.col("step"), 10, "kind", "g", "index", "v", "cut", "tokens")


ROLLOUTS = "r AS (SELECT (event_id // 500)::INT AS \"window\", CASE event_type WHEN 'view' THEN 'find_error' WHEN 'click' THEN 'line_loc' ELSE 'mcq' END AS kind, user_id AS g, event_id % 2 AS i, (event_id % 5) / 4 AS x, event_id % 7 <> 0 AS ok, event_id % 11 = 0 AS cut, event_id % 13 AS tokens, event_id % 20 <> 0 AS yes, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS size FROM events), l AS (SELECT \"window\", kind, count(*) AS groups, avg(d::INT) AS live_dense, avg(b::INT) AS live_binary FROM (SELECT \"window\", kind, g, min(x) <> max(x) AS d, min((x = 1)::INT) <> max((x = 1)::INT) AS b FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2), p AS (SELECT \"window\", kind, avg(x) AS mean, var_pop(x) AS var, avg(ok::INT) AS parse, avg(cut::INT) AS cut, avg(tokens) AS tokens, CASE kind WHEN 'find_error' THEN avg(yes::INT) FILTER (ok) END AS predicted, CASE kind WHEN 'find_error' THEN avg(yes::INT) FILTER (ok AND i = 0) END AS p0, CASE kind WHEN 'find_error' THEN avg(yes::INT) FILTER (ok AND i = 1) END AS p1 FROM r GROUP BY 1, 2)"


@query(f"WITH {ROLLOUTS} SELECT \"window\", kind, groups, round(live_dense, 6) AS live_dense, round(live_binary, 6) AS live_binary, round(mean, 6) AS reward_mean, round(var, 6) AS reward_var, round(parse, 6) AS parse_rate, round(cut, 6) AS cut_off_rate, round(tokens, 6) AS mean_tokens, round(predicted, 6) AS predicted, round(p0, 6) AS predicted_0, round(p1, 6) AS predicted_1 FROM l JOIN p USING (\"window\", kind)")
def q_monitor(spark, d):
    """The running audit of rollouts over windows of ten steps."""
    m = rollouts(spark, d)[0]
    return m.select("window", "kind", "groups", *[F.round(c, 6).alias(c) for c in m.columns[3:]])


@query(f"WITH {ROLLOUTS} SELECT \"window\", size::INT AS size, count(*) AS n FROM r WHERE kind = 'line_loc' AND ok GROUP BY 1, 2")
def q_monitor_sizes(spark, d):
    return rollouts(spark, d)[1]


@query(f"WITH {ROLLOUTS}, e AS (SELECT \"window\", kind, unnest(['below_floor', 'collapse']) AS event, [live_dense < 0.1, greatest(predicted, 1 - predicted) > 0.9] AS f FROM l JOIN p USING (\"window\", kind)) SELECT \"window\", kind, event FROM e WHERE f[CASE event WHEN 'below_floor' THEN 1 ELSE 2 END]")
def q_monitor_events(spark, d):
    return rollouts(spark, d)[2]


@query(f"WITH s AS (SELECT s AS seed, CASE WHEN (c_custkey + s) % 5 = 0 THEN 'dev' ELSE 'train' END AS \"set\", c_custkey, 'N' || c_nationkey AS label, c_name AS day, substr('ABCD', ({mod_sql('4', 'c_custkey::VARCHAR', chr(39) + 'letter' + chr(39))} + 1)::INT, 1) AS letter FROM customer, range(2) AS g(s)), t AS (SELECT DISTINCT seed, label FROM s WHERE \"set\" = 'train') SELECT s.seed::INT AS seed, \"set\", count(*) AS members, min(day) AS first, max(day) AS last, count(DISTINCT s.label) AS labels, count(*) FILTER (t.label IS NULL) AS unseen, " + ", ".join(f"count(*) FILTER (letter = '{x}') AS letter_{x}" for x in "ABCD") + " FROM s LEFT JOIN t ON t.seed = s.seed AND t.label = s.label GROUP BY 1, 2")
def q_partition_statistics(spark, d):
    """Members, labels and letters of each seed's sets of customers."""
    from ..functions.rank import rank_mod

    c = load(spark, d, "customer")
    sets = c.select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("seed")).withColumn("set", F.when((F.col("c_custkey") + F.col("seed")) % 5 == 0, "dev").otherwise("train"))
    facts = c.select("c_custkey", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("label"), F.col("c_name").alias("day"))
    letter = F.substring(F.lit("ABCD"), (rank_mod(4, F.col("c_custkey"), "letter") + 1).cast("int"), F.lit(1))
    return W.partition_statistics(sets, facts, "c_custkey", "label", "day", letter)


@query("SELECT doc_id, CASE WHEN doc_id = 0 THEN '' ELSE '@@ replace vulnerable lines 3-3 @@' || chr(10) || '-    3:   return ' || doc_id || ';' || chr(10) || '+    3:   return 0;' END AS view FROM documents")
def q_diff_view(spark, d):
    """A change of one line for a reader."""
    old = F.concat(F.lit("int f()\n{\n  return "), F.concat(F.col("doc_id").cast("string"), F.lit(";\n}")))
    return documents(spark, d).select("doc_id", C.diff_views(old, F.lit("int f()\n{\n  return 0;\n}")).alias("view"))
