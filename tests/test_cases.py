"""Hand-made cases of rules that have to give exact results."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.functions import code
from loamline.functions import text as T
from loamline.functions import verify as V
from loamline.operators import bank as B
from loamline.operators import checks as C
from loamline.operators import evaluation as E
from loamline.operators import graph as G
from loamline.operators import inference as I
from loamline.operators import jobs as W
from loamline.operators import runs as R
from loamline.operators import sampling as S
from loamline.operators import similarity as N
from loamline.operators import training as M


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# A hierarchy in which `grand` is reached from `low` by two steps and also shares a parent with it.
EDGES = [("mid", "top"), ("low", "mid"), ("other", "mid"), ("grand", "root"), ("via", "grand"), ("leaf", "via"), ("leaf", "root"), ("x", "p1"), ("x", "p2"), ("deep", "low")]


def test_relations_and_credit(spark):
    e = spark.createDataFrame(EDGES, "child string, parent string")
    nodes = G.neighbours(e).select(F.col("node").alias("id")).distinct()
    cases = [
        ("low", "low", "exact", 8, 8), ("low", "mid", "child", 4, 4), ("mid", "low", "parent", 2, 4), ("other", "low", "sibling", 2, 2), ("top", "low", "ancestor_2", 1, 2),
        ("grand", "leaf", "ancestor_2", 1, 2), ("low", "top", "descendant_2", 2, 2), ("p1", "p2", "coparent", 2, 2), ("deep", "top", "far", 0, 0), ("nowhere", "low", "far", 0, 0), (None, "low", "far", 0, 0),
    ]
    df = spark.createDataFrame([(p, g) for p, g, *_ in cases], "pred string, gold string")
    got = G.relation_of(df, "pred", "gold", G.relations(e), nodes).withColumns({"d": G.credit(F.col("relation"), G.DIRECTED), "s": G.credit(F.col("relation"))})
    assert {(r.pred, r.gold): (r.relation, r.d, r.s) for r in got.collect()} == {(p, g): (k, d, s) for p, g, k, d, s in cases}
    with pytest.raises(Exception, match="not a live node"):
        G.relation_of(spark.createDataFrame([("low", "nowhere")], "pred string, gold string"), "pred", "gold", G.relations(e), nodes).collect()


def test_closure_of_a_long_chain_and_a_hidden_cycle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(150)], "child int, parent int")
    up = G.closure(chain)
    assert up.count() == 150 * 151 // 2 and up.agg(F.max("depth")).first()[0] == 150
    with pytest.raises(ValueError, match="cycle"):
        G.closure(chain.union(spark.createDataFrame([(150, 100)], "child int, parent int")))
    with pytest.raises(RuntimeError):
        G.closure(chain, 3)
    assert rows(C.cyclic(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)], "child int, parent int")), "id") == [(1,), (2,), (3,)]


@pytest.mark.parametrize(("source", "want"), [
    ("static int foo(int a)\n{\n}", ["foo"]), ("static Image *ReadOneJNGImage(MngInfo *m,\n    const ImageInfo *i)\n{", ["ReadOneJNGImage"]), ("int Foo::Bar::baz(int x) const\n{", ["Foo::Bar::baz", "baz"]),
    ("Foo::~Foo()\n{", ["Foo::~Foo", "Foo"]), ("Foo::Foo(int x) : m_x(x), m_y{0}\n{", ["Foo::Foo", "Foo", "m_x"]), ("PHP_FUNCTION(array_walk)\n{", ["PHP_FUNCTION", "array_walk"]),
    ("SYSCALL_DEFINE4(epoll_ctl, int, epfd, int, op)\n{", ["SYSCALL_DEFINE4", "epoll_ctl"]), ("int\nold_style(a, b)\n    int a; char *b;\n{", ["old_style"]),
    ("static __attribute__((unused)) int quiet(void)\n{", ["quiet"]), ("/* helper(x) */\nint real_name(void)\n{", ["real_name"]), ("    while (1) {\n        x++;\n    }", []),
])
def test_function_names(source, want):
    assert code.function_names(source) == want


BASE = "int f(int a)\n{\n    int r = a;\n    r += 1;\n    return r;\n}"


def test_bodies_ignore_white_space_and_comments(spark):
    df = spark.createDataFrame([(BASE,), (BASE.replace("    ", "\t") + "\n// tail",), (BASE.replace("1", "2"),)], "t string")
    a, b, c = (r[0] for r in df.select(T.body_hash(code.masked_text(F.col("t")))).collect())
    assert a == b != c
    docs = spark.createDataFrame([(1, "cve-a", "v", BASE), (2, "cve-b", "v", BASE + " // same"), (3, "cve-b", "p", BASE.replace("1", "2")), (4, "cve-c", "v", None)], "id int, e string, s string, t string")
    assert rows(N.near_duplicate_links(docs, "id", "t"), "a", "b", "kind") == [(1, 2, "exact")]
    assert N.near_duplicate_links(docs, "id", "t", code=False).count() == 0
    assert rows(N.entity_links(docs, "e", "s", "t"), "a", "b", "kind", "jaccard", "side_a", "side_b") == [("cve-a", "cve-b", "exact", 1.0, "v", "v")]
    members, links = N.near_duplicate_classes(docs, "id", "t")
    assert rows(members, "id", "rep") == [(1, 1), (2, 1), (3, 3)] and links.count() == 0


@pytest.mark.parametrize(("text", "leaks"), [
    ("We were told the answer, so it must be B.", True), ("Since the provided answer is B, B.", True), ("I 've been given it", True), ("I've been given it", False), ("the solution has been stated above", True), ("As THE HINT suggests", True),
    ("the prompt says that the answer is B", True), ("you told me\nthe answer", False), ("An answer follows from the code.", False), ("Hints are absent", False),
])
def test_hints(spark, text, leaks):
    assert spark.range(1).select(T.leaks_hint(F.lit(text))).first()[0] is leaks


def test_review_categories(spark):
    j = lambda ok, strict, parsed: (parsed, ok, strict)
    cases = [
        ("mcq", "no idea", "stop", j(False, False, None), "parse_failure"), ("mcq", "no id", "length", j(False, False, None), None), ("mcq", "(B)", "stop", j(True, False, "B"), "no_field"),
        ("mcq", "ANSWER: B", "stop", j(True, True, "B"), None), ("find_error", "it is vulnerable", "stop", j(True, False, "VULNERABLE: yes"), "no_field"), ("line_loc", "3 and 4", "stop", j(True, False, "LINES: 3, 4"), "no_field"),
        ("cvss", "AV:N", "stop", j(True, False, "AV:N/AC:?"), "no_field"), ("exact_id", "CWE-79 it is\nso there", "stop", j(True, False, "CWE-79"), "no_field"), ("exact_id", "x\nI say cwe 79 ", "stop", j(True, False, "CWE-79"), "lenient_not_strict"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, k string, t string, f string, v struct<parsed:string,parse_ok:boolean,strict_ok:boolean>, want string")
    got = df.select("want", V.review_category(F.col("k"), F.col("t"), F.col("f"), F.col("v")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_rationale_target(spark):
    verdict = lambda c: F.struct(V.parse_id(c).isNotNull().alias("parse_ok"), V.parse_id(c).alias("parsed"))
    t = F.lit("  It overruns.\n Then it ends.\n\nCWE-79\n")
    r = spark.range(1).select(V.rationale(t, F.lit("stop"), F.lit("CWE-79"), verdict(T.final_line(t)), verdict(F.lit("CWE-79"))).alias("r")).first().r
    assert tuple(r) == ("It overruns.\n Then it ends.\n\nCWE-79", None)


def test_invalid_golds_are_errors(spark):
    gold = "struct<letter:string,options:array<struct<letter:string,cwe:string,name:string>>,cwe:string,vector:map<string,string>,vulnerable:boolean,lines:array<int>,n_lines:int>"
    for kind, g in (("cvss", (None, None, None, {"AV": "N"}, None, None, None)), ("line_loc", (None, None, None, None, None, [], 9)), ("what", (None,) * 7)):
        df = spark.createDataFrame([(kind, "LINES: 3", g)], f"k string, t string, g {gold}")
        with pytest.raises(Exception, match="gold isn't valid|unknown item type"):
            df.select(V.verdict(F.col("k"), F.col("t"), F.col("g"), F.create_map(F.lit("a"), F.lit(1)))).collect()


def test_labels_resolve_in_order(spark):
    mapping = spark.createDataFrame([("CWE-71", "CWE-62"), ("CWE-92", "CWE-62"), ("CWE-216", None)], "old string, new string")
    nodes = spark.createDataFrame([("CWE-62", False, False, True), ("CWE-79", False, False, True), ("CWE-199", True, False, False), ("CWE-1000", False, True, False)], "id string, is_category boolean, is_view boolean, in_view boolean")
    cases = [
        (None, (None, "no_nvd_cwe", [])), ([], (None, "placeholder_only", [])), (["NVD-CWE-Other", "NVD-CWE-noinfo"], (None, "placeholder_only", [])), (["CWE-79"], ("CWE-79", "ok", [])),
        (["CWE-92", "CWE-71"], ("CWE-62", "ok", ["CWE-71", "CWE-92"])), (["CWE-79", "CWE-216", "CWE-x"], (None, "deprecated_no_replacement", ["CWE-216"])), (["CWE-", "CWE-216"], (None, "malformed_cwe", [])),
        (["CWE-79", "CWE-71"], (None, "multi_cwe", ["CWE-71"])), (["CWE-199"], (None, "category", [])), (["CWE-1000"], (None, "view", [])), (["CWE-5"], (None, "not_in_view_1000", [])),
    ]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, vs array<string>")
    got = {r.i: (r.label, r.reason, r.mapped_from) for r in M.resolve_labels(df, "i", "vs", mapping, nodes).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_draws_avoid_what_is_banned(spark):
    pool = spark.createDataFrame([("a", 5), ("b", 1), ("c", 2), ("d", 3)], "i string, w int")
    banned = spark.createDataFrame([(k, "a") for k in range(50)] + [(k, "d") for k in range(25)], "id long, i string")
    got = {r.id: r.drawn for r in S.weighted_draw(spark.range(60), "id", pool, "i", "w", 3, "s", banned).collect()}
    assert all(sorted(got[k]) == ["b", "c"] for k in range(25)) and all(sorted(got[k]) == ["b", "c", "d"] for k in range(25, 50)) and all(len(set(got[k])) == 3 for k in range(50, 60))


def test_latest_cuts_within_a_day(spark):
    df = spark.createDataFrame([(i, f"2020-01-0{i // 4 + 1}") for i in range(12)] + [(99, None)], "id int, day string").withColumn("ts", F.col("day").cast("timestamp"))
    for n in (0, 1, 4, 6, 13, 20):
        for order in (["day", "id"], ["ts", "id"]):
            got = {r.id for r in S.latest(df, order, n).collect() if r.late}
            assert got == {r.id for r in sorted(df.collect(), key=lambda r: (r.day or "", r.id), reverse=True)[:n]}


def test_places_in_an_order(spark):
    df = spark.createDataFrame([(random.Random(i).randrange(10**9),) for i in range(500)], "k long").distinct()
    got = [r.k for r in S.ordered(df, "i", "k").orderBy("i").collect()]
    assert got == sorted(got) and [r.i for r in S.ordered(df, "i", "k").orderBy("i").collect()] == list(range(len(got)))


def test_selection_has_as_many_rows(spark):
    items = spark.createDataFrame([(f"u{i}:{t}:0", t) for i in range(12) for t in ("a", "b", "c")], "item string, kind string")
    salts = {"mask": "m", "upsample": "u", "order": "o"}
    for options in ({}, {"dropped": "b"}, {"share": (1, 6)}):
        got = S.selection(items, "item", "kind", "cfg", 1, salts, **options).orderBy("pos").collect()
        n = Counter(r.item for r in got)
        assert len(got) == 36 and [r.pos for r in got] == list(range(36)) and max(n.values()) - min(n.values()) <= 1
        assert len(n) == {0: 36, 1: 24 if "dropped" in options else 30}[len(options)]
    assert [S.checkpoint_steps(n, 4) for n in (4, 10, 56)] == [[1, 2, 3, 4], [3, 5, 8, 10], [14, 28, 42, 56]]
    with pytest.raises(ValueError):
        S.checkpoint_steps(3, 4)


def brute_margin(data, unit, score):
    n = len(data)
    hits = sum(score(a, g) for a, g in data)
    pairs = sum(score(a, h) for i, (a, _) in enumerate(data) for j, (_, h) in enumerate(data) if i != j)
    return hits, pairs, n, hits / (unit * n) - pairs / (unit * n * (n - 1))


def test_margins_with_credit(spark):
    rng = random.Random(4)
    table = {("a", "a"): 8, ("b", "b"): 8, ("c", "c"): 8, ("a", "b"): 4, ("b", "a"): 2}
    data = [(rng.choice([None, "a", "b", "c"]), rng.choice("abc")) for _ in range(60)]
    data += [(g, g) for _, g in data[:25]]
    df = spark.createDataFrame([(i, a, g) for i, (a, g) in enumerate(data)], "i int, answer string, gold string")
    m = spark.createDataFrame([(a, g, u) for (a, g), u in table.items()], "answer string, gold string, units long")
    hits, pairs, n, margin = brute_margin(data, 8, lambda a, g: table.get((a, g), 0))
    assert tuple(I.observed_and_control(df, "answer", "gold", m).first()) == (hits, pairs, n)
    null = np.array([r.units for r in I.permuted_units(df, "answer", "gold", 3000, m).collect()])
    golds, want = [g for _, g in data], []
    for _ in range(3000):
        rng.shuffle(golds)
        want.append(sum(table.get((a, g), 0) for (a, _), g in zip(data, golds, strict=True)))
    assert abs(null.mean() - np.mean(want)) < 5 * np.std(want) / np.sqrt(1500) and abs(null.std() / np.std(want) - 1) < 0.1
    draws = np.array([r.margin for r in I.margin_resamples(df, "answer", "gold", 1500, 8, m).collect()])
    plain = [brute_margin([rng.choice(data) for _ in data], 8, lambda a, g: table.get((a, g), 0))[3] for _ in range(300)]
    assert abs(draws.mean() - np.mean(plain)) < 5 * np.std(plain) / np.sqrt(250) and abs(draws.std() / np.std(plain) - 1) < 0.2
    means = np.array([r["mean"] for r in I.paired_resamples(df.select((F.col("i") % 7).cast("double").alias("d")), "d", 1500).collect()])
    values = np.array([i % 7 for i in range(len(data))])
    assert abs(means.mean() - values.mean()) < 0.05 and abs(means.std() / (values.std() / np.sqrt(len(values))) - 1) < 0.1


def test_scores_are_collected_or_refused(spark):
    good = [("x", s, f"u{u}:{t}:{i}", n, 2) for s in (0, 1) for u in (1, 2) for t, i, n in (("pair", 0, 2), ("pair", 1, u), ("one", 0, 1))]
    df = lambda data: spark.createDataFrame(data, "arm string, seed int, item_id string, num long, den long")
    units = spark.createDataFrame([("u1",), ("u2",)], "unit string")
    kinds = {"pair": 2, "one": 1}
    got = rows(I.collected_scores(df([*good, ("other", 0, "u1:one:0", 1, 2)]), ["x"], kinds, units, [0, 1]), "kind", "seed", "unit", "score")
    assert got == sorted((t, s, f"u{u}", {"one": 0.5, "pair": float(u == 2)}[t]) for t in kinds for s in (0, 1) for u in (1, 2))
    for bad in ([*good, good[0]], [*good, ("x", 0, "u1:pair:2", 1, 2)], [*good, ("x", 0, "u3:one:0", 3, 2)], good[1:], [g for g in good if not g[2].startswith("u2")], [*good, ("x", 0, "u3:one:0", 1, 2)]):
        with pytest.raises(ValueError):
            I.collected_scores(df(bad), ["x"], kinds, units, [0, 1]).collect()


def test_choices_stay_frozen(spark):
    new = spark.createDataFrame([("a", 1), ("b", 2)], "g string, run int")
    old = spark.createDataFrame([("a", 1), ("c", 3)], "g string, run int")
    assert rows(I.frozen_choice(new, old, ["g"], "run"), "g", "run") == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(Exception, match="would change"):
        I.frozen_choice(new, old.withColumn("run", F.lit(9)), ["g"], "run").collect()


def test_admission_keeps_the_first_of_equal_ones(spark):
    above = spark.createDataFrame([("n1", "r"), ("s", "n1"), ("s", "r")], "node string, ancestor string")
    live = spark.createDataFrame([(x,) for x in ("N1", "N2", "N3", "R", "S")], "id string")
    above = above.select(F.upper("node").alias("node"), F.upper("ancestor").alias("ancestor"))
    df = spark.createDataFrame([(1, "N1", [" n2", "N2", "N1", "r", "s", "N9", "??", "n3"], ["N3"])], "k int, gold string, ps array<string>, taken array<string>")
    got = B.judged_proposals(df, "k", "gold", "ps", r"\A[NRS]\d*\z", lambda v: v, live, above, "taken").orderBy("pos")
    assert [r.reason for r in got.collect()] == [None, "duplicate", "gold", "ancestor", "descendant", "not_live", "malformed", "duplicate"]


def test_parts_pins_chains_and_gates(spark, tmp_path):
    df = spark.createDataFrame([(i, 64 if i % 3 else 128) for i in range(10)], "pos int, cap int")
    parts = R.parts_by_cap(df, "pos", "cap").withColumn("x", F.col("pos") * 10).drop("pos")
    assert rows(R.merged_parts(df, parts, "pos", "cap"), "pos", "x") == [(i, i * 10) for i in range(10)]
    with pytest.raises(Exception, match="parts don't fit"):
        R.merged_parts(df, parts.where("part_pos <> 2"), "pos", "cap").collect()
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("1")
    (tmp_path / "b.txt").write_text("2")
    pin = R.tree_hash(str(tmp_path))
    R.gate(str(tmp_path), pin)
    (tmp_path / "b.txt").write_text("3")
    for p in (pin, None):
        with pytest.raises(ValueError):
            R.gate(str(tmp_path), p)
    R.gate(str(tmp_path), R.tree_hash(str(tmp_path), ("b.txt",)), ("b.txt",))
    assert R.config_of(R.config_name(1, 6)) == {"dropped": None, "share": (1, 6)} and R.config_of(R.config_name(dropped="mcq"))["dropped"] == "mcq" and R.config_name() == "m1"
    assert R.next_version("a/b.json", {"a/b.json", "a/b_v2.json"}.__contains__) == "a/b_v3.json"
    assert R.drift({"a": "1", "b": "2"}, {"a": "1"}) == ["b"] and R.not_ready({"a": None, "b": 1}) == ["a"]
    a, b = R.resolved_config({"lr": 1, "n": 2}, {"lr": 3}), R.resolved_config({"n": 2}, {"lr": 3})
    assert a == b and R.unequal_settings({"x": {"n": 1}, "y": {"n": 2}}, ("n",)) == ["n"]
    with pytest.raises(ValueError):
        R.score_export(df.limit(0).select(F.lit("r").alias("run"), F.lit("i").alias("item_id"), F.lit(1).alias("n"), F.lit(2).alias("d")), spark.createDataFrame([("r",)], "run string"), ["run"], "n", "d")


def test_summaries(spark):
    df = spark.createDataFrame([("a", "self_a1", True)] * 3 + [("a", "gold_only", False)] * 2 + [("b", "gold_only", False)] * 9 + [("b", "self_a1", False)] + [("c", "self_a2", False)] * 20, "t string, s string, l boolean")
    got = {r.t: (r.n, r.passed, r.fallback, r.leaks, r.band, r.fires, r.drops_arm) for r in E.rationale_summary(df, "t", "s", "l", 2).collect()}
    assert got == {"a": (5, 3, 2, 3, "as_specified", False, True), "b": (10, 1, 9, 0, "report_quality", True, True), "c": (20, 0, 0, 0, "floored", True, True)}
    with pytest.raises(Exception, match="different units"):
        E.engine_gap(spark.createDataFrame([("k", 1, "x", 0.5)], "k string, u int, e string, v double"), "k", "u", "e", "v", "x", "y").collect()


def test_attempts_are_decided_or_refused(spark):
    items = spark.createDataFrame([("a", "ga"), ("b", "gb"), ("c", "gc")], "item string, gold string")
    good = [("a", 1, "x", None), ("b", 1, None, "empty"), ("b", 2, "y", None), ("c", 1, None, "empty"), ("c", 2, None, "truncated")]
    df = lambda data: spark.createDataFrame(data, "item string, attempt int, result string, reason string")
    names = ("self_a1", "self_a2", "gold_only")
    assert rows(W.two_attempts(items, "item", df(good), "gold", names), "item", "source", "result") == [("a", "self_a1", "x"), ("b", "self_a2", "y"), ("c", "gold_only", "gc")]
    for bad in (good[1:], [*good[:1], *good[2:]], good[:-1], [*good, ("a", 2, "z", None)], [*good, ("d", 1, "z", None)]):
        with pytest.raises(Exception, match="attempt"):
            W.two_attempts(items, "item", df(bad), "gold", names).collect()
    assert rows(W.wanted_retries(df(good[:2]), "item"), "item") == [("b",)]


@pytest.mark.parametrize(("before", "after", "want"), [
    ("a\nb\nc", "a\nx\nc", "@@ replace vulnerable lines 2-2 @@\n-    2: b\n+    2: x"), ("a\n\nb", "a\n\nx\nb", "@@ insert after vulnerable line 1 (gold 1) @@\n+    3: x"),
    ("a\nb", "x\na\nb", "@@ insert before vulnerable line 1 (gold 1) @@\n+    1: x"), ("a\nb\nc", "c", "@@ delete vulnerable lines 1-2 @@\n-    1: a\n-    2: b"), ("a // b", "a", ""),
])
def test_diff_views(spark, before, after, want):
    assert spark.createDataFrame([(before, after)], "b string, a string").select(code.diff_views(F.col("b"), F.col("a"))).first()[0] == want


def test_tokens_round_trip(spark):
    from loamline.functions import tokens

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")
    texts = ["Hello, world", "", "é\n\t x", "<|endoftext|> is text", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.withColumn("ids", tokens.token_ids(F.col("t"), path)).withColumns({"n": tokens.token_count(F.col("t"), path), "back": tokens.decoded(F.col("ids"), path)}).orderBy("i").collect()
    assert [r.back for r in out] == texts and all(r.n == (None if r.ids is None else len(r.ids)) for r in out) and out[3].n > 1


def test_outputs_are_counted(spark):
    from loamline.operators import reconcile

    asked = spark.createDataFrame([(1,), (2,)], "k int")
    got = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "k int, o array<string>")
    assert rows(reconcile.reconcile(asked, got, "k", outputs="o", wanted=2), "k", "status") == [(1, "ok"), (2, "outputs_differ")]


def test_requests_carry_their_pins(spark):
    df = spark.createDataFrame([("a:mcq:0", 5), ("b:mcq:0", 9)], "item string, n int")
    r = W.requests(df, "item", "rationale", 2, F.col("item"), "S", F.col("n"), {"model": F.lit("m")}, {"n": 1, "max_tokens": 100}, "salt")
    assert rows(r, "request_id", "model") == [("rationale:a:mcq:0:a2", "m"), ("rationale:b:mcq:0:a2", "m")] and W.capacity(r).first()[0] == 109
    assert R.pin_violations(r, "item", {"model": F.lit("m")}).count() == 0
    frozen = df.withColumnRenamed("n", "copy")
    from loamline.sources.jsonl import content_hash

    assert W.frozen_file(frozen, [["item", "copy"], ["item"]], content_hash(frozen), content_hash).count() == 2
    for layouts, h in (([["item"]], None), ([["item", "copy"]], "0")):
        with pytest.raises(ValueError):
            W.frozen_file(frozen, layouts, h, content_hash)
    assert W.passes(50, 24, 600) == 2
