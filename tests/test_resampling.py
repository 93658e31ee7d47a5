"""Bootstraps, schedules and quantiles against their laws and plain Python."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.operators import aggregate as A
from loamline.operators import bootstrap as P
from loamline.operators import schedule as Q


def test_weights_are_poisson_and_independent():
    rng = np.random.default_rng(1)
    w = P.weights(rng.integers(-(1 << 62), 1 << 62, 4000), np.arange(200), 3)
    share = [np.mean(w == k) for k in range(5)]
    assert np.allclose(share, [np.exp(-1) / f for f in (1, 1, 2, 6, 24)], atol=0.002) and abs(w.var() - 1) < 0.01
    assert abs(np.corrcoef(w[:2000].ravel(), w[2000:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(w[:, :100].ravel(), w[:, 100:].ravel())[0, 1]) < 0.01
    assert (P.weights(np.array([5, 7]), np.arange(10), 3)[1] == P.weights(np.array([7]), np.arange(10), 3)[0]).all() and (P.weights(np.array([7]), np.arange(50), 4) != P.weights(np.array([7]), np.arange(50), 3)).any()


def test_means_of_resamples_follow_the_law(spark):
    """Centred at the mean, with the variance of a mean; units are drawn whole; the same for any partitions; groups apart."""
    rng = np.random.default_rng(2)
    rows = [(g, u, float(v)) for g in ("x", "y", None) for u, v in enumerate(rng.normal(3, 2, 300)) for _ in range(1 + (g == "y"))] + [("x", 1, None)]
    df = spark.createDataFrame(rows, "g string, u long, v double")
    got = P.poisson_means(df, ["g"], F.col("u"), "v", 1000).toPandas()
    again = P.poisson_means(df.repartition(7), ["g"], F.col("u"), "v", 1000).toPandas()
    for g in ("x", "y", None):
        own = np.array([v for a, _, v in rows if a == g and v is not None])
        single = own if g != "y" else own[::2]
        mine, other = (t[t.g.isna() if g is None else t.g == g].sort_values("replicate")["mean"].to_numpy() for t in (got, again))
        assert len(mine) == 1000 and np.allclose(mine, other)
        assert abs(mine.mean() - own.mean()) < 0.02 and abs(mine.std() / (single.std() / np.sqrt(len(single))) - 1) < 0.12
    assert P.poisson_means(df.where("false"), [], F.col("u"), "v", 10).count() == 0


def test_three_engines(spark):
    rng = random.Random(3)
    rows = [(k, u, e, rng.random() * 0.1 + (0.3 if (k, e) == ("far", "c") else 0)) for k in ("far", "near") for u in range(200) for e in "abc"]
    df = spark.createDataFrame(rows, "kind string, unit int, engine string, value double")
    got = {(r.second, r.kind): r for r in P.engine_comparisons(df, "kind", "unit", "engine", "value", [("a", "c"), ("a", "b")], 1000).collect()}
    assert {k for k, r in got.items() if r.material} == {("c", "far")} and all(r.outcome == "material" for r in got.values())
    assert got["c", "far"].decides and not got["b", "far"].decides and got["c", "far"].low < got["c", "far"].gap < got["c", "far"].high and got["c", "far"].second_better == 200
    noise = P.engine_comparisons(df, "kind", "unit", "engine", "value", [("a", "b"), ("a", "c")], 1000).collect()
    assert {r.outcome for r in noise} == {"agree"}  # only the first pair decides
    with pytest.raises(Exception, match="different units"):
        P.engine_comparisons(df.where("NOT (engine = 'b' AND unit = 7)"), "kind", "unit", "engine", "value", [("a", "c"), ("a", "b")], 10).collect()


def test_interval_of_a_standardised_gap(spark):
    rng = np.random.default_rng(4)
    rows = [(u, k, r, float(rng.normal(s * (2 + r), s))) for u in range(150) for k, s in (("p", 1.0), ("q", 10.0)) for r in (0, 1)]
    df, scale = spark.createDataFrame(rows, "u int, k string, r int, v double"), spark.createDataFrame([("p", 1.0), ("q", 10.0)], "kind string, scale double").withColumnRenamed("kind", "k")
    got = P.standardised_gap(df, "u", "k", "r", "v", scale, 0, 1, 1000).first()
    each = {}
    for u, k, r, v in rows:
        each[u] = each.get(u, 0) + (1 if r else -1) * v / {"p": 1, "q": 10}[k] / 2
    d = np.array(list(each.values()))
    assert got.units == 150 and abs(got.difference - d.mean()) < 1e-9 and abs((got.high - got.low) / (2 * 1.96 * d.std() / np.sqrt(150)) - 1) < 0.15
    with pytest.raises(Exception, match="lacks a kind|different units"):
        P.standardised_gap(df.where("NOT (u = 3 AND k = 'p' AND r = 1)"), "u", "k", "r", "v", scale, 0, 1, 10).collect()


def dealt(jobs, machines):
    """The rule, job by job."""
    free, out = [(0.0, i) for i in range(machines)], {}
    for key, size in sorted(jobs, key=lambda j: (-j[1], j[0])):
        at, i = heapq.heappop(free)
        out[key] = (i, at)
        heapq.heappush(free, (at + size, i))
    return out


def test_schedules_are_those_of_the_rule(spark):
    rng = random.Random(5)
    for machines, sizes, n in ((1, [2.0], 5), (3, [1.0, 2.5, 0.5], 60), (7, [0.25, 8.0, 3.0, 3.25], 40), (50, [1.0], 20), (4, [0.0, 1.0], 11)):
        jobs = [(i, rng.choice(sizes)) for i in range(n)]
        got = Q.list_schedule(spark.createDataFrame(jobs, "job int, hours double"), "job", "hours", [], machines).collect()
        want = dealt(jobs, machines)
        assert {r.job: (r.machine, r.start) for r in got} == want, (machines, sizes)


def test_work_that_is_left(spark):
    grid = spark.createDataFrame([(a, s) for a in "xyz" for s in range(3)], "arm string, seed int")
    hours = spark.createDataFrame([("x", 2.0), ("y", 5.0), ("z", 1.0)], "arm string, hours double")
    out = Q.remaining_work(grid, grid.where("seed = 0 OR arm = 'z'"), ["arm", "seed"], hours, "arm", ["arm", "seed"], 2, 7.0).collect()
    assert sorted((r.arm, r.seed, r.machine, r.start) for r in out) == [("x", 1, 0, 5.0), ("x", 2, 1, 5.0), ("y", 1, 0, 0.0), ("y", 2, 1, 0.0)] and {(r.finish, r.over_budget) for r in out} == {(7.0, False)}
    assert Q.remaining_work(grid, grid, ["arm", "seed"], hours, "arm", ["seed"], 2, 7.0).count() == 0


@pytest.mark.parametrize("n", [1, 2, 99, 5000])
def test_quantiles_without_groups(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.random(), 0.5, -1.0]) for _ in range(n)]
    qs = [(0, 1), (1, 100), (1, 2), (99, 100), (1, 1)]
    got = A.nearest_rank(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), [], "v", qs).collect()
    assert {(r.q_num, r.q_den): r.v for r in got} == {(a, b): sorted(values)[max(1, -(-a * n // b)) - 1] for a, b in qs}
