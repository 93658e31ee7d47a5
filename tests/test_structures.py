"""Shortest scripts, cycles and components, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.functions import diff
from loamline.operators import bank
from loamline.operators import graph as G


def common(a, b):
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_scripts_are_scripts_and_the_shortest():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ([rng.randrange(rng.choice([1, 2, 4, 30])) for _ in range(rng.randrange(22))] for _ in range(2))
        b = [x for x in a if rng.random() < 0.8] if rng.random() < 0.3 else b
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        gone, come = diff.shortest_script(x, y)
        assert x[~gone].tolist() == y[~come].tolist() and int((~gone).sum()) == common(a, b), (a, b)
        parts = diff.hunks(gone, come)
        assert sum(j - i for i, j, _, _ in parts) == gone.sum() and sum(l - k for _, _, k, l in parts) == come.sum()
        assert all(p[1] < q[0] and p[3] < q[2] for p, q in zip(parts, parts[1:], strict=False))


def test_scripts_of_long_texts_need_no_square_of_memory():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 500, 20_000)
    b = np.insert(np.delete(a, rng.choice(20_000, 200, replace=False)), rng.integers(0, 19_000, 150), 999)
    gone, come = diff.shortest_script(a, b)
    assert a[~gone].tolist() == b[~come].tolist() and gone.sum() <= 200 and come.sum() <= 150


@pytest.mark.parametrize(("before", "after", "lines"), [("a\n\nb", "a\nb", []), ("a\n b ", "a\nb", []), ("a\nb", "x\na\nb", [1]), ("a\n\nb", "a\n\nx\nb", [1]), ("", "x", []), ("a\nb\nc", "", [1, 2, 3]), ("a // b", "a", [1])])
def test_second_lines(before, after, lines):
    assert diff.second_lines(before, after)["lines"] == lines


def test_agreement_of_two_diffs(spark):
    same, swapped = "int a;\nint b;\nint c;", "int b;\nint a;\nint c;"
    rows = spark.createDataFrame([(1, same, same.replace("b", "x")), (2, same, same), (3, "a;\n/* c */\nb;", "a;\nb;"), (4, None, "x"), (5, swapped, same), (6, "'", "''")], "k int, b string, a string")
    got = {r.k: r for r in bank.line_agreement(rows, "k", "b", "a").collect()}
    assert (got[1]["class"], got[1].ours, got[1].f1) == ("agree", [2], 1.0) and got[2]["class"] == "agree" and got[3]["class"] == "comment_lines_only"
    assert got[4].ours == got[4].theirs == [] and len(got) == 6


def on_cycles(edges):
    """Each node on a cycle with the smallest node that it reaches and that reaches it."""
    following = {}
    for a, b in edges:
        following.setdefault(a, set()).add(b)
    reach = {}
    for a in {x for e in edges for x in e}:
        seen, stack = set(), list(following.get(a, ()))
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += following.get(x, ())
        reach[a] = seen
    return {a: min(x for x in reach if x in reach[a] and a in reach[x]) for a in reach if a in reach[a]}


def random_edges(seed, n, share):
    rng = random.Random(seed)
    return {(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * share))}


@pytest.mark.parametrize("edges", [
    {(1, 2), (2, 1), (2, 10), (10, 3), (3, 4), (4, 3), (7, 7), (8, 9), (9, 9)}, {(i, i + 1) for i in range(400)} | {(300, 120)}, {(i, (i + 1) % 50) for i in range(50)}, random_edges(3, 60, 1.6), random_edges(4, 90, 1.1),
])
def test_strong_components(spark, edges):
    """Nodes between two cycles aren't their own ancestors; a loop is a cycle; chains and rings of any length."""
    got = G.strong_components(spark.createDataFrame([*edges, (None, 1), (1, None)], "child long, parent long")).collect()
    assert {r.id: r.component for r in got} == on_cycles(edges) and len(got) == len(on_cycles(edges))


def test_no_edges_have_no_cycles(spark):
    assert G.strong_components(spark.createDataFrame([], "child string, parent string")).collect() == []


def test_components_of_a_star_and_a_chain(spark):
    links = spark.range(1, 20_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(spark.range(30_000, 31_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).union(spark.createDataFrame([(5, 5), (40_000, 40_000), (None, 7)], "a long, b long"))
    assert {(r.component, r["count"]) for r in G.component_labels(links).groupBy("component").count().collect()} == {(0, 20_000), (30_000, 1_001), (40_000, 1)}
