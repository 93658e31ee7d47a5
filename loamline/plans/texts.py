"""Texts, near-duplicates, replies and items."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import verify as V
from ..functions.rank import rank_mod
from ..operators import graph as G
from ..operators import similarity as N
from ..tables import load
from .curation import KEYS
from .samples import mod_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def documents(spark, d):
    return load(spark, d, "documents").select("doc_id", "text")


SHINGLES = f"""k AS MATERIALIZED (SELECT doc_id, {KEYS} AS ks FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ks[i : i + 2], chr(31)) AS sh FROM k, unnest(range(1, greatest(len(ks) - 2, 1) + 1)) AS r(i)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b, shared, x.n + y.n - shared AS total FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared * 5 >= (x.n + y.n - shared) * 4)"""


@query(f"WITH {SHINGLES} SELECT a, b, CASE WHEN array_to_string(x.ks, chr(10)) = array_to_string(y.ks, chr(10)) THEN 'exact' ELSE 'fuzzy' END AS kind, shared, total FROM links JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b")
def q_near_dup_links(spark, d):
    """All pairs of documents with a Jaccard similarity of 4/5 or more on runs of three lines."""
    return N.near_duplicate_links(documents(spark, d), "doc_id", "text", code=False)


@query(f"WITH RECURSIVE {SHINGLES}, e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), c(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.id, e.b FROM c JOIN e ON c.r = e.a), m AS (SELECT id, min(r) AS cluster_id FROM c GROUP BY 1) SELECT id AS doc_id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM m")
def q_near_dup_clusters(spark, d):
    """Clusters of those links; copies are joined by one link each."""
    rows = documents(spark, d)
    return G.clusters(rows.select("doc_id"), "doc_id", [], N.spanning_links(rows, "doc_id", "text", code=False)).select("doc_id", "cluster_id", "cluster_size")


WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query(f"WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE text IS NOT NULL), ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 7], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS r(i) WHERE len(w) > 0), bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 7], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS r(i) WHERE len(w) > 0), z AS (SELECT item_id, count(*) AS size FROM bs GROUP BY 1) SELECT doc_id, item_id, count(*) AS shared, any_value(size) AS size FROM ds JOIN bs USING (s) JOIN z USING (item_id) GROUP BY 1, 2")
def q_benchmark_overlap(spark, d):
    """Documents that share runs of eight words with items of the benchmark."""
    return N.containment(documents(spark, d), "doc_id", "text", load(spark, d, "benchmark"), "item_id", "text", 8)


@query(f"SELECT h AS body_hash, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, sha256(array_to_string({KEYS}, chr(10))) AS h FROM documents) GROUP BY 1 HAVING count(*) > 1")
def q_norm_hash_groups(spark, d):
    """Groups of documents with one body but for white space."""
    return documents(spark, d).groupBy(T.body_hash(F.col("text")).alias("body_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("SELECT doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: i || ': ' || l), chr(10))) AS numbered, len(string_split(text, chr(10)))::INT AS n_lines FROM documents")
def q_numbered_lines(spark, d):
    """The hash of each document with numbered lines."""
    return documents(spark, d).select("doc_id", T.text_hash(T.numbered(F.col("text"))).alias("numbered"), F.size(T.lines(F.col("text"))).alias("n_lines"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '^([ \t\x0B\f\r]*\n)+', ''), '(\n[ \t\x0B\f\r]*)+$', '')) AS cleaned FROM (SELECT doc_id, chr(10) || '  ' || chr(10) || text || chr(13) || chr(10) || ' ' AS t FROM documents)")
def q_clean_text(spark, d):
    """The hash of each document, wrapped in blank lines, after cleaning."""
    t = F.concat(F.lit("\n  \n"), F.col("text"), F.lit("\r\n "))
    return documents(spark, d).select("doc_id", T.text_hash(T.clean(t)).alias("cleaned"))


@query("SELECT doc_id, regexp_replace(own, 'DOC-[0-9]+', 'DOC-[redacted]') AS own FROM (SELECT doc_id, 'see doc-' || doc_id || ' and DOC-' || (doc_id + 1) || ', not XDOC-5' AS t, 'see DOC-' || doc_id || ' and DOC-[redacted], not XDOC-5' AS own FROM documents)")
def q_redact(spark, d):
    """Numbers with a prefix are redacted but inside longer words."""
    t = F.concat(F.lit("see doc-"), F.col("doc_id").cast("string"), F.lit(" and DOC-"), (F.col("doc_id") + 1).cast("string"), F.lit(", not XDOC-5"))
    return documents(spark, d).select("doc_id", T.redact_ids(t, "DOC").alias("own"))


@query("SELECT conv_id, sha256(string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>', chr(10) ORDER BY turn)) AS chat, count(*) AS turns FROM conversations GROUP BY 1")
def q_render_chat(spark, d):
    """The hash of each conversation in ChatML."""
    turns = F.collect_list(F.struct("turn", "role", "text"))
    return load(spark, d, "conversations").groupBy("conv_id").agg(T.text_hash(T.chat_turns(turns)).alias("chat"), F.count("*").alias("turns"))


@query("SELECT doc_id || ':' || t || ':' || i AS item_id, t AS type, CASE t WHEN 'quality' THEN quality::VARCHAR WHEN 'toxic' THEN toxic::VARCHAR ELSE lang END AS target FROM documents JOIN labels USING (doc_id), (VALUES ('quality', 0), ('toxic', 0), ('lang', 0), ('lang', 1)) AS v(t, i)")
def q_item_expand(spark, d):
    """Four items for each labelled document."""
    rows = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id")
    item = lambda t, i, x: F.struct(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(t), F.lit(str(i))).alias("item_id"), F.lit(t).alias("type"), x.cast("string").alias("target"))
    return rows.select(F.inline(F.array(item("quality", 0, F.col("quality")), item("toxic", 0, F.col("toxic")), item("lang", 0, F.col("lang")), item("lang", 1, F.col("lang")))))


def replies(spark, d):
    return load(spark, d, "documents").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'CWE-' || (doc_id % 999 + 1) END AS parsed, doc_id % 5 = 1 AS strict_ok FROM documents")
def q_parse_ids(spark, d):
    """Ids read from synthetic replies: none, exact, in other case and spelling, with others before."""
    n = (F.col("doc_id") % 999 + 1).cast("string")
    kind = F.col("doc_id") % 5
    reply = F.when(kind == 0, "nothing, xCWE-5").when(kind == 1, F.concat(F.lit(" CWE-"), n)).when(kind == 2, F.concat(F.lit("I'd say cwe 00"), n, F.lit("."))).when(kind == 3, F.concat(F.lit("CWE-1, no: CWE_"), n, F.lit(" it is"))).otherwise(F.concat(F.lit("(CWE:"), n, F.lit(")")))
    return replies(spark, d).select("doc_id", V.parse_id(reply).alias("parsed"), V.strict_id(reply).alias("strict_ok"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 4 THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter([(doc_id % 7)::INT, (doc_id % 11)::INT, 3], lambda x: x >= 1 AND x <= 9))), ',') END AS parsed FROM documents")
def q_parse_lines(spark, d):
    """Line numbers read from synthetic replies, out of range, repeated, huge, and behind code."""
    a, b, kind = (F.col("doc_id") % 7).cast("string"), (F.col("doc_id") % 11).cast("string"), F.col("doc_id") % 5
    reply = F.when(kind == 0, "no idea").when(kind == 1, F.concat(F.lit("LINES: 5\nLINES: "), a, F.lit(", "), b, F.lit(", 3, 3"))).when(kind == 2, F.concat(F.lit("```\n8\n```\n12: x\nlines are "), a, F.lit(" and "), b, F.lit(" and 3"))).when(kind == 3, F.concat(F.lit("lines : 99999999999999999999 "), a, F.lit(" "), b, F.lit(" 03"))).otherwise("LINES: none")
    return replies(spark, d).select("doc_id", F.array_join(V.parse_lines(reply, F.lit(9)), ",").alias("parsed"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE substr('ABCD', (doc_id % 4 + 1)::INT, 1) END AS parsed, doc_id % 6 = 1 AS strict_ok FROM documents")
def q_parse_mcq(spark, d):
    """Letters read from synthetic replies by each step of the cascade."""
    letter, kind = F.substring(F.lit("ABCD"), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1)), F.col("doc_id") % 6
    reply = F.when(kind == 0, "answer: a guess").when(kind == 1, F.concat(F.lit("ANSWER: "), letter)).when(kind == 2, F.concat(F.lit("ANSWER: A or\nAnswer: **("), letter, F.lit(")"))).when(kind == 3, F.concat(F.lit(" ("), letter, F.lit(")."))).when(kind == 4, F.concat(F.lit("maybe (D) but Option "), letter, F.lit(" is it"))).otherwise(F.concat(F.lit("x\n"), letter, F.lit(". CWE-"), letter, F.lit(": N")))
    options = F.transform(F.split(F.lit("A,B,C,D"), ","), lambda l: F.struct(l.alias("letter"), F.concat(F.lit("CWE-"), l).alias("cwe"), F.lit("N").alias("name")))
    return replies(spark, d).select("doc_id", V.parse_mcq(reply, options).alias("parsed"), V.strict_mcq(reply).alias("strict_ok"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'yes' WHEN 2 THEN 'no' WHEN 3 THEN 'no' ELSE 'yes' END AS parsed, (CASE doc_id % 5 WHEN 1 THEN 12 WHEN 4 THEN 12 ELSE 0 END)::INT AS vulnerable_score, (CASE doc_id % 5 WHEN 2 THEN 16 WHEN 3 THEN 16 ELSE 0 END)::INT AS patched_score FROM documents")
def q_parse_label(spark, d):
    """Labels read from synthetic replies, and their scores in sixteenths with a credit of four eighths."""
    kind = F.col("doc_id") % 5
    reply = F.when(kind == 0, "who knows").when(kind == 1, "vulnerable: no\nVULNERABLE: **yes, CWE-5").when(kind == 2, "VULNERABLE: no").when(kind == 3, "It seems vulnerable, yet it is not vulnerable.").otherwise("No vulnerability at first; but it is vulnerable.")
    parsed = V.parse_label(reply)
    return replies(spark, d).select("doc_id", parsed.alias("parsed"), V.label_sixteenths(parsed, F.lit(True), F.lit(4)).alias("vulnerable_score"), V.label_sixteenths(parsed, F.lit(False), F.lit(4)).alias("patched_score"))


@query("WITH t AS (SELECT doc_id, substr('NALP', (doc_id % 4 + 1)::INT, 1) AS av, substr('NLH', (doc_id % 3 + 1)::INT, 1) AS pr FROM documents) SELECT doc_id, 'AV:' || av || '/AC:L/PR:' || pr || '/UI:R/S:?/C:H/I:?/A:?' AS parsed, ((av = 'N')::INT + 1 + (pr = 'N')::INT + 0 + 1)::INT AS eighths FROM t")
def q_parse_vector(spark, d):
    """Components read from synthetic replies in letters and words, and those that agree with a fixed vector."""
    av, pr = F.substring(F.lit("NALP"), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1)), F.substring(F.lit("NLH"), (F.col("doc_id") % 3 + 1).cast("int"), F.lit(1))
    reply = F.concat(F.lit("AV:P then av: "), av, F.lit(", AC:Low, PR : "), pr, F.lit("; UI:Required S:Single C:HIGH"))
    gold = F.create_map(*[F.lit(x) for kv in zip(T.VECTOR, "NLNNUHHH", strict=True) for x in kv])
    read = replies(spark, d).select("doc_id", V.parse_components(reply).alias("parts"))
    return read.select("doc_id", V.vector_text(F.col("parts")).alias("parsed"), V.vector_eighths(F.col("parts"), gold).alias("eighths"))


@query(None)
def q_line_f1(spark, d):
    """Each order's line numbers against those of the returned ones, as a matching within one."""
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("p"), F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")))).alias("g"))
    return rows.select("l_orderkey", V.line_f1("p", "g").alias("f")).select("l_orderkey", "f.n", "f.d").where("d IS NOT NULL")


@query("SELECT doc_id, list_filter(string_split_regex(text, '[\\s]+'), lambda x: x <> '')[-1] AS last_word, len(list_filter(string_split_regex(text, '[\\s]+'), lambda x: x <> ''))::INT AS n_tokens FROM documents")
def q_tokens(spark, d):
    """The last and the number of each document's stand-in tokens."""
    t = T.word_tokens(F.col("text"))
    return documents(spark, d).select("doc_id", F.try_element_at(t, F.lit(-1)).alias("last_word"), F.size(t).alias("n_tokens"))


@query("SELECT conv_id, turn, trim(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')[-1]) AS final FROM conversations")
def q_final_line(spark, d):
    """The last line of each turn that isn't blank."""
    return load(spark, d, "conversations").select("conv_id", "turn", T.final_line(F.col("text")).alias("final"))


@query(f"SELECT doc_id, {mod_sql('2147483648', 'doc_id::VARCHAR', chr(39) + 'seed' + chr(39))} AS seed, doc_id || '_quality_0_a1' AS custom_id FROM documents")
def q_requests(spark, d):
    """A request for each document: its seed and its id as sent."""
    return load(spark, d, "documents").select("doc_id", rank_mod(2**31, F.col("doc_id"), "seed").alias("seed"), T.custom_id(F.concat(F.col("doc_id").cast("string"), F.lit(":quality:0")), F.lit(1)).alias("custom_id"))


@query("WITH t AS (SELECT doc_id, list_transform(range(20), lambda i: ((doc_id * (i + 3)) % 23)::INT) AS ids FROM documents), c AS (SELECT doc_id, ids[1 : 8 + doc_id % 9] AS h FROM t), p AS (SELECT *, list_position(h, 7) AS z FROM c) SELECT doc_id, array_to_string(CASE WHEN coalesce(z, 0) > 0 THEN h[1 : z] ELSE h END, ',') AS ids, coalesce(z, 0) = 0 AS cut FROM p")
def q_prefix_cut(spark, d):
    """Synthetic token ids under caps of 8 to 16, with 7 as the stop token."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: ((F.col("doc_id") * (i + 3)) % 23).cast("int"))
    cut = T.prefix_cut(ids, (8 + F.col("doc_id") % 9).cast("int"), 7)
    return load(spark, d, "documents").select("doc_id", cut.alias("c")).select("doc_id", F.array_join("c.ids", ",").alias("ids"), "c.cut")
