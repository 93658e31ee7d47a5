"""Replies in running text: each line of a conversation's turn or a document is followed by what a hash of it chooses, and the SQL applies the parsers' rules to the whole reply."""

from pyspark.sql import functions as F

from ..functions import verify as V
from ..tables import load

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


#: What may follow a line, by the first hex digit of its MD5; # stands for a number from its next digits.
TAILS = (
    "as in CWE-#", "so cwe_00# it is", "CWE: # and (C) too", "Answer: (B)", "ANSWER:d", "option A", "VULNERABLE: **Yes", "it is not vulnerable", "a known vulnerability",
    "no known vulnerabilities", "LINES: 3, #, 3", "lines : none", "#: code();", "vulnerable: no", "xCWE-5 answerable", "",
)


def replies(spark, d, table: str, keys: list[str]):
    """Texts as replies. Every seventh key's is the last line's tail alone, so that strict forms come."""
    lines = F.split("text", "\n")
    digest = lambda line: F.md5(line.cast("binary"))
    tail = lambda line: F.replace(F.element_at(F.array(*[F.lit(t) for t in TAILS]), F.conv(F.substring(digest(line), 1, 1), 16, 10).cast("int") + 1), F.lit("#"), (F.conv(F.substring(digest(line), 2, 2), 16, 10).cast("int") + 1).cast("string"))
    whole = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit(" "), tail(line))), "\n")
    rows = load(spark, d, table).where("text IS NOT NULL")
    return rows.select(*keys, F.when(F.col(keys[0]) % 7 == 0, tail(F.element_at(lines, -1))).otherwise(whole).alias("reply"))


def said(table: str, keys: str) -> str:
    """The same in SQL, as r(keys, reply)."""
    tails = "[" + ", ".join("'" + t + "'" for t in TAILS) + "]"
    tail = f"replace({tails}[('0x' || substr(md5(l), 1, 1))::INT + 1], '#', (('0x' || substr(md5(l), 2, 2))::INT + 1)::VARCHAR)"
    first = keys.split(",")[0]
    return f"""l AS (SELECT {keys}, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {table} WHERE text IS NOT NULL),
r AS (SELECT {keys}, CASE WHEN {first} % 7 = 0 THEN arg_max({tail}, i) ELSE string_agg(l || ' ' || {tail}, chr(10) ORDER BY i) END AS reply FROM l GROUP BY {keys})"""


@query(rf"""WITH {said('documents', 'doc_id')} SELECT doc_id, 'CWE-' || nullif(regexp_extract(reply, '(?is)^(?:.*[^a-z0-9])?cwe[-_ :]*0*([0-9]{{1,5}})(?:[^0-9].*)?$', 1), '')::INT AS parsed, regexp_matches(reply, '^\s*CWE-[1-9][0-9]*\s*$') AS strict FROM r""")
def q_reply_ids(spark, d):
    """The last id in each document as a reply."""
    return replies(spark, d, "documents", ["doc_id"]).select("doc_id", V.parse_id(F.col("reply")).alias("parsed"), V.strict_id(F.col("reply")).alias("strict"))


@query(rf"""WITH {said('conversations', 'conv_id, turn')}, p AS (SELECT *, regexp_extract(reply, '(?s)^.*(?i:ANSWER)\s*:\s*[(\[*]*\s*([A-D])(?:[^A-Za-z0-9].*)?$', 1) AS field, regexp_extract(reply, '^[\s(\[*]*([A-D])[\s).\]*]*$', 1) AS lone,
regexp_extract(reply, '(?s)^.*(?:\(([A-D])\)|(?:[^0-9A-Za-z_](?i:option|answer is)|^(?i:option|answer is))\s+([A-D])(?:[^A-Za-z0-9].*)?$)', ['a', 'b']) AS loose FROM r)
SELECT conv_id, turn, coalesce(nullif(field, ''), nullif(lone, ''), nullif(loose['a'], ''), nullif(loose['b'], '')) AS parsed, regexp_matches(reply, '^\s*ANSWER: [A-D]\s*$') AS strict FROM p""")
def q_reply_letters(spark, d):
    """The letter that each turn of a conversation answers."""
    return replies(spark, d, "conversations", ["conv_id", "turn"]).select("conv_id", "turn", V.parse_mcq(F.col("reply")).alias("parsed"), V.strict_mcq(F.col("reply")).alias("strict"))


@query(rf"""WITH {said('documents', 'doc_id')}, m AS (SELECT *, lower(nullif(regexp_extract(reply, '(?is)^.*VULNERABLE\s*:\s*\**\s*(yes|no)(?:[^A-Za-z].*)?$', 1), '')) AS field,
regexp_replace(regexp_replace(regexp_replace(reply, '(?i)\b(?:not|isn''t|is\s+not|no\s+longer)\s+vulnerable\b|\bno\s+(?:known\s+|security\s+)?vulnerabilit(?:y|ies)\b', chr(1), 'g'), '(?i)\bvulnerab(?:le|ilit(?:y|ies))\b', chr(2), 'g'), '[^\x01\x02]', '', 'g') AS events FROM r)
SELECT doc_id, coalesce(field, CASE right(events, 1) WHEN chr(2) THEN 'yes' WHEN chr(1) THEN 'no' END) AS parsed FROM m""")
def q_reply_labels(spark, d):
    """What each document as a reply says last: vulnerable or not."""
    return replies(spark, d, "documents", ["doc_id"]).select("doc_id", V.parse_label(F.col("reply")).alias("parsed"))


@query(rf"""WITH {said('documents', 'doc_id')}, t AS (SELECT *, CASE WHEN regexp_matches(reply, '(?i)LINES\s*:') THEN regexp_replace(reply, '(?is)^.*LINES\s*:', '')
ELSE array_to_string(list_filter(string_split(regexp_replace(reply, '(?s)```.*?(?:```|$)', ' ', 'g'), chr(10)), lambda x: NOT regexp_matches(x, '^\s*[0-9]+:')), chr(10)) END AS tail FROM r),
n AS (SELECT *, regexp_extract_all(tail, '[0-9]+') AS found FROM t)
SELECT doc_id, CASE WHEN len(found) > 0 THEN array_to_string(list_sort(list_distinct(list_filter(list_transform(found, lambda x: CASE WHEN length(ltrim(x, '0')) <= 9 THEN x::BIGINT END), lambda x: x BETWEEN 1 AND 200))), ',') WHEN regexp_matches(tail, '(?i)\bnone\b') THEN '' END AS parsed FROM n""")
def q_reply_lines(spark, d):
    """The lines, of 200, that each document as a reply names."""
    found = V.parse_lines(F.col("reply"), F.lit(200))
    return replies(spark, d, "documents", ["doc_id"]).select("doc_id", F.when(found.isNotNull(), F.array_join(found.cast("array<string>"), ",")).alias("parsed"))


@query(rf"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, list_transform(l, lambda x, i: CASE WHEN i % 5 = 2 THEN 'v' || i || ' = 1; // ' || replace(x, '\', '') WHEN i % 5 = 4 THEN '/* ' || replace(x, '*/', '') || ' */ w();' ELSE 'x' || md5(x) || '();' END) AS c FROM l)
SELECT doc_id, array_to_string(list_transform(c, lambda x, i: CASE WHEN i % 5 = 2 THEN 'v' || i || ' = 1; ' || repeat(' ', length(x) - length('v' || i || ' = 1; ')) WHEN i % 5 = 4 THEN repeat(' ', length(x) - 5) || ' w();' ELSE x END), chr(10)) AS masked, true AS ok FROM c""")
def q_masked_documents(spark, d):
    """Documents as comments in code: lines behind // and in /* */ are blanked, as many characters as they have."""
    from ..functions import code as C

    line = lambda x, i: F.when(i % 5 == 1, F.concat(F.lit("v"), (i + 1).cast("string"), F.lit(" = 1; // "), F.replace(x, F.lit("\\"), F.lit("")))).when(i % 5 == 3, F.concat(F.lit("/* "), F.replace(x, F.lit("*/"), F.lit("")), F.lit(" */ w();"))).otherwise(F.concat(F.lit("x"), F.md5(x.cast("binary")), F.lit("();")))
    rows = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", C.masked(F.array_join(F.transform(F.split("text", "\n"), line), "\n")).alias("m"))
    return rows.select("doc_id", F.col("m.text").alias("masked"), "m.ok")
