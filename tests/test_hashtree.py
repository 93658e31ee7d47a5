"""Which rows of two versions differ, and how little is read to tell."""

from loamline.sources import hashtree as H


def test_changes_are_named_and_found_from_the_top(spark, tmp_path):
    rows = [(i, f"v{i}", None if i % 5 else i * 0.5) for i in range(3000)] + [(7, "v7", None), (None, "no key", 1.0)]
    later = [r for r in rows if r[0] != 100] + [(5000, "new", None), (7, "v7", None)]
    later = [(a, "other" if a == 42 else b, c) for a, b, c in later]
    schema = "k long, v string, x double"
    paths = {n: str(tmp_path / n) for n in ("a", "b", "c")}
    for n, data in (("a", rows), ("b", later), ("c", rows[::-1])):
        H.freeze(spark.createDataFrame(data, schema).repartition(3 + len(n)), "k", paths[n], 3)
    assert {(r.k, r.change) for r in H.changed_rows(spark, paths["a"], paths["b"], "k", 3).collect()} == {(100, "removed"), (5000, "added"), (42, "changed"), (7, "changed")}
    leaves, read = H.differing_nodes(spark, paths["a"], paths["b"], 3)
    assert len(leaves) <= 4 and read[0] == 1 and all(n <= 4 for n in read)
    assert H.differing_nodes(spark, paths["a"], paths["c"], 3) == ([], [0]) and H.changed_rows(spark, paths["a"], paths["c"], "k", 3).count() == 0
    assert H.same_version(spark, paths["a"], paths["c"]) and not H.same_version(spark, paths["a"], paths["b"])


def test_where_too_much_differs_all_rows_are_compared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "FOLLOWED", 3)
    a, b = (spark.range(200).selectExpr("id AS k", f"id * {m} AS v") for m in (1, 2))
    H.freeze(a, "k", str(tmp_path / "a"), 2)
    H.freeze(b, "k", str(tmp_path / "b"), 2)
    assert H.differing_nodes(spark, str(tmp_path / "a"), str(tmp_path / "b"), 2)[0] is None
    assert H.changed_rows(spark, str(tmp_path / "a"), str(tmp_path / "b"), "k", 2).count() == 199  # 0 stays 0


def test_an_empty_version(spark, tmp_path):
    rows = spark.range(5).selectExpr("id AS k")
    H.freeze(rows, "k", str(tmp_path / "a"), 2)
    H.freeze(rows.where("k < 0"), "k", str(tmp_path / "b"), 2)
    assert {r.change for r in H.changed_rows(spark, str(tmp_path / "a"), str(tmp_path / "b"), "k", 2).collect()} == {"removed"}
