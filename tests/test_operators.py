import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.functions.rank import rank_hex
from loamline.operators import aggregate as A
from loamline.operators import checks as C
from loamline.operators import graph as G
from loamline.operators import inference as I
from loamline.operators import ledger as L
from loamline.operators import reconcile as R
from loamline.operators import sampling as S
from loamline.operators import similarity as N


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_ledger_balances(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), ("b", 9), ("c", 5), ("c", 9), ("d", 1)], "e string, v int")
    fated = L.with_fate(df, [("nine", F.col("v") == 9), ("big", F.col("v") >= 5)])
    assert rows(L.stage_ledger(fated, "e", 2), "stage", "rows_left", "entities_left") == [(0, 6, 4), (1, 3, 3), (2, 2, 2)]
    assert rows(L.entity_drops(fated, "e"), "e", "stage", "reason", "all_failures") == [("b", 1, "nine", ["big", "nine"]), ("c", 2, "big", ["big", "nine"])]
    assert rows(L.filter_alone(df, "e", [("nine", F.col("v") == 9), ("big", F.col("v") >= 5)]), "check", "rows_dropped", "entities_dropped") == [("big", 4, 2), ("nine", 3, 1)]


@pytest.mark.parametrize(("count", "of", "out"), [(2, 10, False), (3, 10, True), (1, 5, False), (2, 9, True)])
def test_exactly_a_fifth_is_kept(spark, count, of, out):
    assert spark.range(1).select(L.exceeds_fraction(F.lit(count), F.lit(of), 1, 5)).first()[0] is out


def test_latest_wins_and_ties(spark):
    df = spark.createDataFrame([("a", "2", "f2"), ("a", "2", "f1"), ("a", "1", "f0"), ("b", None, "f9")], "k string, t string, f string")
    assert rows(L.latest_wins(df, "k", "t", "f"), "k", "f") == [("a", "f1"), ("b", "f9")]


def test_one_per_entity(spark):
    df = spark.createDataFrame([("a", 1, False), ("b", 1, True), ("b", 2, False), ("c", 1, True), ("c", 2, True), ("d", 1, False), ("d", 2, False)], "e string, i int, p boolean")
    assert rows(L.one_per_entity(df, "e", F.col("p"), rank_hex(F.col("e"), F.col("i")), "i"), "e", "rule") == [("a", "single"), ("b", "preferred"), ("c", "preferred_rank"), ("d", "rank")]


def test_holdout_keeps_days_and_clusters_whole(spark):
    df = spark.createDataFrame([(i, f"2020-01-{d:02}", c) for i, (d, c) in enumerate([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 1), (9, 10)])], "id int, day string, c int")
    plain = S.temporal_holdout(df, "id", "day", 3, 20)
    assert rows(plain.where("pool = 'test'"), "id") == [(8,), (9,)]  # k is 2, and both of that day
    tied = S.temporal_holdout(df, "id", "day", 1, 20)
    assert rows(tied.where("pool = 'test'"), "id") == [(8,), (9,)]  # k is 1
    whole = S.temporal_holdout(df, "id", "day", 3, 20, "c")
    assert rows(whole.where("pool = 'test'"), "id") == [(9,)] and rows(whole.where("moved"), "id") == [(8,)]


def test_partition_sizes(spark):
    df = spark.createDataFrame([(i, i // 2, f"{i:03}") for i in range(100)], "id int, c int, day string")
    out = S.seeded_partition(df, "id", "c", ["day", "id"], 3, 3, 20, 5)
    got = out.groupBy("seed").agg(F.sum(F.col("late").cast("int")).alias("w"), F.sum((F.col("role") == "dev").cast("int")).alias("dev"), F.sum(F.col("checkpoint").cast("int")).alias("ck"))
    assert rows(got, "w", "dev", "ck") == [(30, 16, 5)] * 3  # clusters of two: the one that crosses 15 is included
    with pytest.raises(ValueError):
        S.seeded_partition(df, "id", "c", ["day", "id"], 1, 3, 5, 5)


def test_weighted_draw_never_repeats(spark):
    pool = spark.createDataFrame([("a", 5), ("b", 1), ("c", 2), ("d", 1)], "i string, w int")
    got = [r.drawn for r in S.weighted_draw(spark.range(400), "id", pool, "i", "w", 4, "s").collect()]
    assert len(got) == 400 and all(sorted(x) == list("abcd") for x in got)
    first = [x[0] for x in got].count("a")
    assert 180 < first < 265  # five ninths


def test_mask_must_be_whole(spark):
    with pytest.raises(ValueError):
        S.item_mask(spark.range(10), "id", 1, 3, "m")
    assert S.item_mask(spark.range(12), "id", 1, 3, "m").where("masked").count() == 4


def lines(rng, n):
    return [f"line {rng.random()}" for _ in range(n)]


def test_near_duplicates_at_the_boundary(spark):
    base = lines(random.Random(1), 12)  # ten shingles
    eight = [*base[:-1], "other"]  # 9 of 11
    inside = [*base[:10], "x", "y"]  # 8 of 12
    docs = spark.createDataFrame([(1, "\n".join(base)), (2, "\n".join(eight)), (3, "\n".join(inside)), (4, "\n".join("  " + x for x in base)), (5, ""), (6, " \n"), (7, None)], "id int, t string")
    got = rows(N.near_duplicate_links(docs, "id", "t"), "a", "b", "kind", "shared", "total")
    assert got == [(1, 2, "fuzzy", 9, 11), (1, 4, "exact", 10, 10), (2, 4, "fuzzy", 9, 11), (5, 6, "exact", 1, 1)]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    bases = [lines(rng, rng.randrange(3, 40)) for _ in range(12)]
    docs = []
    for i in range(80):
        t = list(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = f"edit {rng.randrange(5)}"
        docs.append((i, "\n".join(t)))
    sets = {i: {tuple("".join(x.split()) for x in t.split("\n"))[j : j + 3] for j in range(max(1, len(t.split("\n")) - 2))} for i, t in docs}
    want = sorted((a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    df = spark.createDataFrame(docs, "id int, t string")
    assert rows(N.near_duplicate_links(df, "id", "t"), "a", "b") == want and want
    root = {i: i for i in sets}
    for a, b in want * 3:
        lo = min(root[a], root[b])
        root = {k: lo if v in (root[a], root[b]) else v for k, v in root.items()}
    assert dict(rows(G.clusters(df.select("id"), "id", [], N.spanning_links(df, "id", "t")), "id", "cluster_id")) == root


EDGES = [("b", "a"), ("c", "a"), ("d", "b"), ("e", "b"), ("e", "c"), ("f", "e"), ("d", "a"), ("g", "d")]


def test_graph(spark):
    e = spark.createDataFrame(EDGES, "child string, parent string")
    up = G.closure(e)
    assert ("f", "a", 3) in rows(up, "node", "ancestor", "depth") and up.count() == 14
    sib = rows(G.siblings(e, up), "node", "sibling")
    assert ("b", "c") in sib and ("d", "e") in sib and ("d", "b") not in sib  # b is an ancestor of d
    rel = {(p, g): r for p, g, r in rows(G.relations(e), "pred", "gold", "relation")}
    assert rel["a", "a"] == "exact" and rel["d", "a"] == "child" and rel["a", "e"] == "ancestor_2" and rel["f", "b"] == "descendant_2" and rel["b", "c"] == "sibling" and rel["d", "e"] == "sibling"
    assert ("g", "f", 4) in rows(G.distances(e, 5), "node", "other", "distance")
    with pytest.raises(ValueError):
        G.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"), 6)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a int, b int")
    assert {r.component for r in G.component_labels(links).collect()} == {0, 100}


@pytest.mark.parametrize("n", [1, 2, 7, 20])
def test_nearest_rank(spark, n):
    v = sorted(random.Random(n).choices(range(9), k=n))
    got = rows(A.nearest_rank(spark.createDataFrame([("g", x) for x in v], "g string, v int"), ["g"], "v", [(0, 1), (1, 4), (7, 100), (1, 2), (1, 1)]), "q_num", "q_den", "v")
    assert got == sorted((a, b, v[max(0, -(-a * n // b) - 1)]) for a, b in [(0, 1), (1, 4), (7, 100), (1, 2), (1, 1)])


def test_mode_ties_follow_the_domain(spark):
    df = spark.createDataFrame([("x", "H"), ("x", "L"), ("y", "N"), ("y", "N"), ("y", "H"), ("z", "?")], "k string, v string")
    assert rows(A.ordered_mode(df, ["k"], "v", "HLN"), "k", "mode", "votes") == [("x", "H", 1), ("y", "N", 2)]


def test_bands_and_caps(spark):
    df = spark.createDataFrame([(5, 10), (4, 10), (1, 10), (0, 10)], "l int, n int")
    assert [r[0] for r in df.select(A.band(F.col("l"), F.col("n"))).collect()] == ["as_specified", "dynamic_sampling", "dynamic_sampling", "floored"]
    cut = spark.createDataFrame([("a", 16, 2, 10), ("a", 24, 1, 10), ("b", 16, 5, 10), ("b", 24, 5, 10)], "k string, cap int, n_cut int, n int")
    assert rows(A.cap_choice(cut, ["k"]), "k", "cap") == [("a", 24), ("b", 24)]


def test_control_against_brute_force(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([None, "a", "b", "c"]), rng.choice("abc")) for i in range(40)]
    got = I.observed_and_control(spark.createDataFrame(data, "i int, a string, g string"), "a", "g").first()
    assert got == (sum(a == g for _, a, g in data), sum(a == h for i, a, _ in data for j, _, h in data if i != j), 40)


def test_interaction_ignores_main_effects():
    rng = np.random.default_rng(1)
    y = rng.normal(0.5, 0.02, (4, 5, 3))
    t, _ = I.statistic(y)
    sd = np.sqrt(y.var(-1, ddof=1).mean(-2))
    moved = y + (rng.normal(0, 1, (4, 1, 1)) + rng.normal(0, 1, (1, 5, 1))) * sd[None, :, None]
    assert np.isclose(I.statistic(moved)[0], t)


def test_interaction_finds_what_is_planted_and_not_more():
    rng = np.random.default_rng(2)
    null = [I.interaction_test(rng.normal(0, 1, (4, 5, 3)), 300, i)["p"] < 0.05 for i in range(120)]
    assert np.mean(null) < 0.13
    y = rng.normal(0.5, 0.01, (4, 5, 3))
    y[1, 2] += 0.2
    found = I.interaction_test(y, 500)
    assert found["significant"] and np.abs(found["residuals"]).argmax() == 7 and np.isclose(found["contributions"].sum(), 1)
    small, large = (I.minimal_effect(rng.normal(0.5, s, (4, 5, 3)), 40, 300)["minimal_effect"] for s in (0.005, 0.02))
    assert all(a and b and a < b for a, b in zip(small, large, strict=True))


def test_planting_is_quadratic():
    rng = np.random.default_rng(4)
    y = rng.normal(0.5, 0.02, (3, 4, 3))
    t, r = I.statistic(y)
    sd = np.sqrt(y.var(-1, ddof=1).mean(-2))
    z = y.copy()
    z[1, 2] += 0.7 * sd[2]
    assert np.isclose(I.statistic(z)[0], t + 2 * r[1, 2] * 0.7 + (1 - 1 / 3) * (1 - 1 / 4) * 0.49)


def test_schedule_and_steps():
    assert I.list_schedule({"a": 3, "b": 2, "c": 2, "d": 1}, 2) == [("a", 0, 0.0), ("b", 1, 0.0), ("c", 1, 2.0), ("d", 0, 3.0)]
    assert I.feasible_steps(10, 60, 1100) == 104 and I.feasible_steps(100, 60, 1100) is None


def test_reconciliation(spark):
    asked, got = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "k int, h string"), spark.createDataFrame([(1, "x"), (2, "y"), (4, "x"), (4, "x")], "k int, h string")
    assert rows(R.reconcile(asked, got, "k", "h"), "k", "status") == [(1, "ok"), (2, "hash_differs"), (3, "missing"), (4, "unexpected")]
    with pytest.raises(ValueError):
        R.full_coverage(asked, got.select("k"), "k")
    tries = spark.createDataFrame([(1, 1, "a", None), (2, 1, "b", "empty"), (2, 2, "c", None), (3, 1, "d", "x"), (3, 2, "e", "x")], "k int, n int, t string, r string")
    assert rows(R.retry_decision(tries, "k", "n", "t", "r", asked, "h"), "k", "source", "text") == [(1, "attempt_1", "a"), (2, "attempt_2", "c"), (3, "gold", "x")]
    with pytest.raises(ValueError):
        R.retry_decision(tries.withColumn("n", F.col("n") + 1), "k", "n", "t", "r", asked, "h")
    assert R.same_rows(asked, asked) and not R.same_rows(asked, asked.union(asked))


def test_checks(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, None, "a"), (2, 7, "b")], "k int, v int, g string")
    bad = C.together([C.row_checks(df, "k", {"v": F.col("v") > 5}), C.unique(df, "k"), C.one_value(df, "k", "g")])
    assert rows(bad, "check", "key") == [("one g for each k", "2"), ("unique k", "2"), ("v", "1"), ("v", "2")]
    with pytest.raises(AssertionError):
        C.require(bad)
    C.require(bad.where("false"))


def test_replacements_wrap(spark):
    from loamline.operators import training as R2

    queue = spark.createDataFrame([("t", "x", 1), ("t", "y", 2), ("t", "x", 3), ("u", "z", 1)], "kind string, item string, o int")
    asked = spark.createDataFrame([("t", i) for i in range(5)] + [("u", 9)], "kind string, pos int")
    assert rows(R2.replacements(asked, "kind", "pos", queue, "item", "o"), "kind", "pos", "item", "used") == [("t", 0, "x", 1), ("t", 1, "y", 1), ("t", 2, "x", 2), ("t", 3, "y", 2), ("t", 4, "x", 3), ("u", 9, "z", 1)]
    df = spark.createDataFrame([([1.0, 2.0], [1.5, 2.0], 0.001), ([1.0, 2.0], [1.5, 2.0], 1.0)], "a array<double>, b array<double>, d double")
    got = df.select(R2.sync_verdict(F.lit(0.1), R2.mean_absolute_gap(F.col("a"), F.col("b")), F.col("d"), 0.01, 0.5)).collect()
    assert [r[0] for r in got] == ["early", "ok"]


def test_outcome_needs_its_own_p(spark, tmp_path):
    from loamline.plans.training import q_outcome

    for name, good, bad, want in (("noise", 3, 1, "not detected"), ("sure", 30, 10, "large"), ("none", 0, 0, "not detected")):
        labels = [(i, int(i < good), int(i >= good)) for i in range(good + bad)]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        assert [r.outcome for r in q_outcome(spark, str(tmp_path / name)).collect()] == [want]
