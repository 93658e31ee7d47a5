import itertools
import random

import pytest
from pyspark.sql import functions as F

from loamline.functions import code, rank
from loamline.functions import text as T
from loamline.functions import verify as V


def values(spark, columns, *exprs):
    names = list(columns)
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"`{n}` string" for n in names))
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_rank_is_the_known_one(spark):
    row = spark.range(1).select(rank.rank_hex(F.lit("CVE-2016-0001"), "abc"), rank.rank_mod(4, F.lit("CVE-2016-0001"), "abc")).first()
    assert row[0].upper() == "73B757FBC6BCC229" and row[1] == 0x73B757FBC6BCC229 % 4


@pytest.mark.parametrize(("text", "want"), [
    ("a // b\nc", "a     \nc"), ("a /* b\n c */ d", "a     \n      d"), ('x = "// no"; // yes', 'x = "// no";       '), ("c = '\"'; // q", "c = '\"';     "),
    ('R"x(// no )" )x" // y', 'R"x(// no )" )x"     '), ("1'000'000 // n", "1'000'000     "), ("a // b \\\n still\nc", "a       \n      \nc"), ("a / b", "a / b"),
])
def test_comments_are_blanked(text, want):
    assert code.mask_comments(text) == (want, True)


@pytest.mark.parametrize("text", ["a /* b", 'x = "open\n', "c = 'a", 'R"(never'])
def test_what_is_open_stays(text):
    assert code.mask_comments(text) == (text, False)


@pytest.mark.parametrize(("before", "after", "lines", "come", "gone"), [
    ("a\nb\nc", "a\nx\nc", [2], 1, 1), ("a\nb\nc", "a\nc", [2], 0, 1), ("a\nb", "a\nx\nb", [1], 1, 0), ("a\nb", "x\na\nb", [1], 1, 0), ("a\nb", "a\nb\nx", [2], 1, 0),
    ("a\n\nb", "a\n\nx\nb", [1], 1, 0), ("a // one\nb", "a // two\nb", [], 0, 0),
])
def test_changed_lines(before, after, lines, come, gone):
    got = code.changed_lines(before, after)
    assert (got["lines"], got["n_inserted"], got["n_deleted"]) == (lines, come, gone)


def test_code_columns(spark):
    df = spark.createDataFrame([("int a::f(int x) { if (y) {} }", "int a::f(int x) { return g(x); }")], "a string, b string")
    row = df.select(code.names("a").alias("n"), code.line_change("a", "b").alias("c"), code.masked(F.lit("x // y")).alias("m")).first()
    assert row.n == ["a::f", "f"] and row.c.lines == [1] and row.m == ("x     ", True)


def test_lines_and_keys(spark):
    t = "\n \n a b \r\n\nc d\n\n"
    got = values(spark, {"t": [t]}, T.clean(F.col("t")), F.array_join(T.line_keys(T.clean(F.col("t"))), "|"), F.size(T.lines(F.col("t"))))
    assert got == [(" a b \n\nc d", "ab|cd", 7)]


def test_shingles_of_short_and_empty(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b", "c", "d"],)], "k array<string>")
    assert [r[0] for r in df.select(T.shingles(F.col("k"))).collect()] == [[""], ["a"], ["a\x1fb\x1fc", "b\x1fc\x1fd"]]


def test_redaction_and_words(spark):
    got = values(spark, {"t": ["CWE-79, cwe-1 and XCWE-5; CVE-2020-1 CVE-2020-12"], "own": ["cve-2020-1"]}, T.redact_ids(F.col("t"), "CWE"), T.redact_own(F.col("t"), F.col("own"), "CVE-[redacted]"), T.holds_word(F.col("t"), F.array(F.lit("and"))), T.holds_word(F.col("t"), F.array(F.lit("an"))))
    assert got == [("CWE-[redacted], CWE-[redacted] and XCWE-5; CVE-2020-1 CVE-2020-12", "CWE-79, cwe-1 and XCWE-5; CVE-[redacted] CVE-2020-12", True, False)]


def test_json_status(spark):
    raw = ['{"k": 1}', '{"k": true}', '{"k": "1"}', "{}", "{", None]
    assert [r[0] for r in values(spark, {"t": raw}, T.json_int_status(F.col("t"), "k"))] == ["ok", "wrong_type", "wrong_type", "missing", "bad_json", "bad_json"]


@pytest.mark.parametrize(("reply", "parsed", "strict"), [("CWE-787", "CWE-787", True), (" CWE-787\n", "CWE-787", True), ("cwe 0787.", "CWE-787", False), ("CWE-1 or CWE-22", "CWE-22", False), ("xCWE-5", None, False), ("CWE-123456", None, True), ("", None, False)])
def test_parse_id(spark, reply, parsed, strict):
    assert values(spark, {"r": [reply]}, V.parse_id(F.col("r")), V.strict_id(F.col("r"))) == [(parsed, strict)]


def test_parse_mcq(spark):
    got = values(spark, {"r": ["ANSWER: B", "answer: a buffer", "(C).", "maybe (A), option D", "x ANSWER: A then Answer: **(C)", "none"]}, V.parse_mcq(F.col("r")))
    assert [g[0] for g in got] == ["B", None, "C", "D", "C", None]


def test_parse_label(spark):
    replies = ["VULNERABLE: yes, CWE-1", "vulnerable: ** no", "it is not vulnerable", "vulnerable, yet no known vulnerability", "No vulnerabilities, later vulnerable", "hm"]
    assert [g[0] for g in values(spark, {"r": replies}, V.parse_label(F.col("r")))] == ["yes", "no", "no", "no", "yes", None]


def test_parse_lines(spark):
    replies = ["LINES: 3, 1, 3", "LINES: none", "the lines 2 and 40", "```\n5", "```\n5\n``` and 6", "7: code\nline 8", "no", "LINES: 0", "LINES: 1\nLINES: 2"]
    assert [g[0] for g in values(spark, {"r": replies}, V.parse_lines(F.col("r"), F.lit(10)))] == [[1, 3], [], [2], None, [6], [8], None, [], [2]]
    assert values(spark, {"r": ["LINES: 1, 3", "LINES: 3, 1", "LINES: none", "lines: 1"]}, V.strict_lines(F.col("r"), F.lit(5))) == [(True,), (False,), (True,), (False,)]


def test_vectors(spark):
    v = "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
    texts = [v, f"CVSS:3.1/{v}", v.lower(), v.replace("AV:N", "AV:X"), v + "/AV:N", v[5:], None]
    assert [r[0] is not None for r in values(spark, {"t": texts}, T.parse_vector(F.col("t"), T.VECTOR))] == [True, True, True, False, False, False, False]
    assert values(spark, {"t": ["AV:Network ac: low, AC:h S:Single"]}, V.vector_text(V.parse_components(F.col("t")))) == [("AV:N/AC:H/PR:?/UI:?/S:?/C:?/I:?/A:?",)]


def largest_matching(p, g):
    best = 0
    for k in range(len(p) + 1):
        for some in itertools.combinations(p, k):
            if any(all(abs(a - b) <= 1 for a, b in zip(some, o, strict=True)) for o in itertools.permutations(g, k)):
                best = k
    return best


def test_line_matching_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(sorted(rng.sample(range(1, 12), rng.randrange(5))), sorted(rng.sample(range(1, 12), rng.randrange(5)))) for _ in range(300)]
    got = spark.createDataFrame(rows, "p array<int>, g array<int>").select("p", "g", V.matched_lines(F.col("p"), F.col("g")).alias("n"), V.line_f1(F.col("p"), F.col("g")).alias("f")).collect()
    for r in got:
        assert r.n == largest_matching(r.p, r.g)
        assert (r.f is None) == (not r.g)


def test_token_arrays(spark):
    df = spark.createDataFrame([([1, 2, 9, 3], [1, 2, 4])], "a array<int>, b array<int>")
    row = df.select(T.prefix_cut(F.col("a"), F.lit(4), 9).alias("c"), T.prefix_cut(F.col("a"), F.lit(2), 9).alias("d"), T.first_difference(F.col("a"), F.col("b")).alias("x"), T.stop_normalised(F.col("a"), 9).alias("s"), T.loss_labels(F.col("b"), F.array(F.lit(0), F.lit(1), F.lit(1))).alias("l")).first()
    assert row.c == ([1, 2, 9], False) and row.d == ([1, 2], True) and row.x == 2 and row.s == [1, 2, 3, -1] and row.l == [-100, 2, 4]


def test_verdicts(spark):
    gold = "struct<letter:string,cwe:string,vector:map<string,string>,vulnerable:boolean,lines:array<int>,n_lines:int,options:array<struct<letter:string,cwe:string,name:string>>>"
    g = ("B", "CWE-787", dict(zip("AV AC PR UI S C I A".split(), "NLNNUHHH", strict=True)), True, [3, 5], 9, [("B", "CWE-787", "Write")])
    c = {"CWE-787": 8, "CWE-119": 4}
    cases = [
        ("mcq", "ANSWER: B", ("B", True, True, (1, 1), (1, 1))), ("mcq", "x\nCWE-787: Write", ("B", True, False, (1, 1), (1, 1))), ("mcq", None, (None, False, False, (0, 1), (0, 1))),
        ("exact_id", "CWE-119", ("CWE-119", True, True, (0, 1), (4, 8))), ("cvss", "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", ("AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", True, True, (8, 8), (8, 8))), ("cvss", "AV:network C:LOW", ("AV:N/AC:?/PR:?/UI:?/S:?/C:L/I:?/A:?", True, False, (1, 8), (1, 8))),
        ("find_error", "VULNERABLE: yes, CWE-119", ("VULNERABLE: yes, CWE-119", True, True, (1, 1), (12, 16))), ("find_error", "not vulnerable", ("VULNERABLE: no", True, False, (0, 1), (0, 16))),
        ("line_loc", "LINES: 3, 6, 9", ("LINES: 3, 6, 9", True, True, (4, 5), (4, 5))), ("line_loc", "LINES: none", ("LINES: none", True, True, (0, 2), (0, 2))), ("line_loc", "?", (None, False, False, (0, 1), (0, 1))),
    ]
    df = spark.createDataFrame([(i, k, r, g, c) for i, (k, r, _) in enumerate(cases)], f"i int, kind string, reply string, gold {gold}, credits map<string,int>")
    got = df.select("i", V.verdict(F.col("kind"), F.col("reply"), F.col("gold"), F.col("credits")).alias("v")).orderBy("i").collect()
    for r, (_, _, want) in zip(got, cases, strict=True):
        assert (r.v.parsed, r.v.parse_ok, r.v.strict_ok, tuple(r.v.metric), tuple(r.v.dense)) == want
    with pytest.raises(Exception, match="unknown item type"):
        df.select(V.verdict(F.lit("odd"), F.col("reply"), F.col("gold"), F.col("credits"))).collect()
