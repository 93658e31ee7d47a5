"""Queries on tables whose numbers of rows, keys and texts aren't those of the driver's small ones, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def against_sql(spark, compare, folder, name, **tables):
    """Runs a query and its SQL on tables that are made by SQL over the small ones."""
    c = duckdb.connect()
    for t, sql in tables.items():
        c.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    got = entry.queries()[name](spark, str(folder)).toPandas()
    assert compare(got) == compare(c.execute(entry.oracle_sql()[name]).df())
    return got


def small(table, where="true", **columns):
    put = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    return f"SELECT *{f' REPLACE ({put})' if put else ''} FROM '{SMALL}/{table}.parquet' WHERE {where}"


@pytest.mark.parametrize(("name", "n"), [("q_mask", 103), ("q_mask_overlap", 3)])
def test_masks_of_a_share_that_is_not_whole(spark, compare, tmp_path, name, n):
    assert len(against_sql(spark, compare, tmp_path, name, documents=small("documents", "doc_id < 103"))) == n


def test_draws_join_only_items_that_can_be_drawn(spark):
    """Relatives that no draw could give don't meet the rows: 3,000 children of the one gold, of which the pool has one."""
    from loamline.operators import bank as B

    above = spark.range(3000).select(F.concat(F.lit("s"), "id").alias("node"), F.lit("g").alias("ancestor"))
    counts = spark.createDataFrame([("g", 3), ("s1", 1), ("x", 2), ("y", 2)], "item string, w int")
    rows = spark.range(50).select("id", F.lit("g").alias("gold"))
    assert sorted(r.item for r in B.relatives(rows, "gold", above, counts).collect()) == ["g", "s1"]
    assert all(sorted(r.drawn) == ["x", "y"] for r in B.drawn_distractors(rows, "id", "gold", counts, above, 2, "s").collect())


def test_decisions_join_only_items_that_can_be_drawn(spark):
    from loamline.operators import bank as B

    above = spark.range(3000).select(F.concat(F.lit("s"), "id").alias("node"), F.lit("g").alias("ancestor"))
    counts = spark.createDataFrame([("g", 3), ("s1", 1), ("x", 2), ("y", 2), ("z", 1)], "item string, w int")
    rows = spark.range(40).select("id", F.lit("g").alias("gold"))
    first = spark.range(0, 40, 2).select("id", F.lit(0).alias("pos"), F.lit("x").alias("value"))
    got = {r.id: r for r in B.decided_distractors(rows, "id", "gold", [("first", first)], counts, above, 3, "s").collect()}
    assert len(got) == 40 and all(sorted(r.distractors) == ["x", "y", "z"] for r in got.values())
    assert all(r.sources == (["first", "draw", "draw"] if r.id % 2 == 0 else ["draw"] * 3) for r in got.values())


def test_pairs_of_long_keys(spark, compare, tmp_path):
    against_sql(spark, compare, tmp_path, "q_pairs_scan", customer=small("customer", c_custkey="c_custkey + 1000000"))


def test_near_misses_in_blocks(spark):
    """More neighbours than a block holds: the rank's least is the same as over all pairs."""
    from loamline.functions.rank import rank_hex
    from loamline.operators import training as R

    near = spark.range(1000).select(F.when(F.col("id") < 990, "a").otherwise("b").alias("node"), F.concat(F.lit("o"), "id").alias("other"))
    rows = spark.range(30).select("id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("gold"))
    got = R.near_misses(rows, "id", "gold", near, "miss", block=64)
    want = rows.join(near, F.col("gold") == F.col("node")).groupBy("id").agg(F.min(F.struct(rank_hex(F.col("id"), F.col("other"), "miss").alias("r"), "other"))["other"].alias("miss"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 20


def test_neighbour_lists_are_made_once_a_label(spark):
    from loamline.operators import jobs as W

    edges = spark.range(200).select(F.concat(F.lit("S"), "id").alias("child"), F.concat(F.lit("N"), (F.col("id") % 2).cast("string")).alias("parent"))
    golds = spark.range(5000).select("id", F.concat(F.lit("N"), (F.col("id") % 2).cast("string")).alias("gold"))
    names = edges.select(F.col("child").alias("id"), F.lower("child").alias("name"))
    got = W.neighbour_lists(golds, "id", "gold", edges, names, F.substring("id", 2, 9).cast("int"))
    want = {g: "\n".join(f"- S{i}: s{i} (more specific)" for i in range(g, 200, 2)) for g in (0, 1)}
    assert got.count() == 5000 and all(r.neighbours == want[r.id % 2] for r in got.collect())
    lists = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in line]
    assert lists and all("Aggregate [gold" in line for line in lists)


@pytest.mark.parametrize("labels", [3, 40])
def test_neighbour_lists_stand_label_by_label(spark, labels):
    """A task has one list alone, so that a file needs it but once, unless there are more labels than tasks; then it has few of them."""
    from loamline.operators import jobs as W

    label = lambda c: F.concat(F.lit("N"), (F.col(c) % labels).cast("string"))
    edges = spark.range(200).select(F.concat(F.lit("S"), "id").alias("child"), label("id").alias("parent"))
    golds = spark.range(3000).select("id", label("id").alias("gold")).union(spark.createDataFrame([(3000, None)], "id long, gold string"))
    names = edges.select(F.col("child").alias("id"), F.lower("child").alias("name"))
    got = W.neighbour_lists(golds, "id", "gold", edges, names, F.substring("id", 2, 9).cast("int")).withColumn("at", F.spark_partition_id()).collect()
    lists = {}
    for r in got:
        lists.setdefault(r["at"], []).append(r.neighbours)
    assert len(got) == 3000 and len({r.id for r in got}) == 3000 and max(len(set(rows)) for rows in lists.values()) <= (1 if labels == 3 else 25)


def kin(edges):
    """Relations and siblings of a small hierarchy by their definitions."""
    ids, up = {x for e in edges for x in e}, {}
    for n in ids:
        seen, todo = set(), [p for c, p in edges if c == n]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [p for c, p in edges if c == x]
        up[n] = seen
    near = {(a, b) for c, p in edges for a, b in ((c, p), (p, c))}
    share = {(a, b) for a, p in edges for b, q in edges if p == q and a != b}
    out = {(n, n): "exact" for n in ids} | {(c, p): "child" for c, p in edges} | {(p, c): "parent" for c, p in edges}
    for a, b in {(a, c) for a, x in near for y, c in near if x == y and a != c} - set(out):
        out[a, b] = "ancestor_2" if a in up[b] else "descendant_2" if b in up[a] else "sibling" if (a, b) in share else "coparent"
    return out, {(a, b) for a, b in share if a not in up[b] and b not in up[a]}


@pytest.mark.parametrize("seed", [1, 2])
def test_relations_by_definition(spark, monkeypatch, seed):
    import random

    from loamline.operators import graph as G

    monkeypatch.setattr(G, "CHILDREN", 2)
    r = random.Random(seed)
    pairs = {(f"n{b:02}", f"n{a:02}") for b in range(1, 22) for a in r.sample(range(b), min(b, r.choice([1, 1, 2, 3])))}
    rel, sib = kin(pairs)
    e = spark.createDataFrame(sorted(pairs), "child string, parent string")
    above = G.closure(e)
    got = [tuple(x) for x in G.relations(e, above).select("pred", "gold", "relation").collect()]
    assert sorted(got) == sorted((*k, v) for k, v in rel.items())
    assert sorted(map(tuple, G.siblings(e, above).collect())) == sorted(sib)
    some = lambda *x: spark.createDataFrame([(f"n{i:02}",) for i in x], "id string")
    got = [tuple(x) for x in G.relations(e, above, some(1, 5, 9, 12, 20), some(0, 3, 5, 11)).collect()]
    assert sorted(got) == sorted((*k, v) for k, v in rel.items() if k[0] in ("n01", "n05", "n09", "n12", "n20") and k[1] in ("n00", "n03", "n05", "n11"))
    far = {(x.node, x.other): x.distance for x in G.distances(e, 3, some(4, 7)).collect()}
    assert far == {(x.node, x.other): x.distance for x in G.distances(e, 3).collect() if x.node in ("n04", "n07")}


def test_near_dup_links_are_all_pairs(spark, compare, monkeypatch, tmp_path):
    """Two bodies of 7 and 6 copies, each like the other, and one document alone: every pair of different documents of the 13, in blocks smaller than a class."""
    from loamline.operators import similarity as N

    monkeypatch.setattr(N, "BLOCK", 2)
    line = "array_to_string(list_transform(range(1, 31), lambda i: 'line ' || i), chr(10))"
    docs = f"SELECT range AS doc_id, CASE WHEN range = 13 THEN 'alone' WHEN range % 2 = 0 THEN {line} ELSE {line} || chr(10) || 'tail' END AS text FROM range(14)"
    got = against_sql(spark, compare, tmp_path, "q_near_dup_links", documents=docs)
    assert len(got) == 13 * 12 // 2 and (got.kind == "exact").sum() == 7 * 6 // 2 + 6 * 5 // 2


def test_entity_links_are_the_strongest_of_all_pairs(spark, monkeypatch):
    """Entities with one body and with several, in blocks of 2, against all pairs of their texts."""
    import random

    from loamline.operators import similarity as N

    monkeypatch.setattr(N, "BLOCK", 2)
    r = random.Random(5)
    bodies = ["\n".join(f"x{i}" for i in range(30)), "\n".join(f"x{i}" for i in range(31)), "\n".join(f"x{i}" for i in range(33)), "\n".join(f"y{i}" for i in range(9)), "z"]
    rows = [(e, s, r.choice(bodies if e % 3 else bodies[:1])) for e in range(24) for s in range(r.choice([1, 1, 3]))]
    runs = lambda t: {tuple(t.split("\n")[i : i + 3]) for i in range(max(len(t.split("\n")) - 2, 1))}
    want = {}
    for a, sa, t in rows:
        for b, sb, u in rows:
            x, y = runs(t), runs(u)
            if a < b and 5 * len(x & y) >= 4 * len(x | y):
                k = (t != u, -len(x & y) / len(x | y), sa, sb)
                want[a, b] = min(want.get((a, b), k), k)
    got = N.entity_links(spark.createDataFrame(rows, "e int, s int, t string"), "e", "s", "t").collect()
    assert sorted(map(tuple, got)) == sorted((*ab, "fuzzy" if o else "exact", round(-j, 4), sa, sb) for ab, (o, j, sa, sb) in want.items())


def test_code_links_span_classes_that_grow(spark, compare, tmp_path):
    got = against_sql(spark, compare, tmp_path, "q_code_links", customer="SELECT range AS c_custkey FROM range(1000)")
    assert len(got) == sum(n * (n - 1) // 2 for n in [7] * 10 + [6] * 30) and set(got.a) == set(range(210)) and set(got.b) == set(range(40, 250))


def test_verdicts_of_targets_alone(spark):
    from loamline.operators import bank as B

    half = lambda n: f"named_struct('strict_ok', true, 'metric', named_struct('n', {n}, 'd', 2), 'dense', named_struct('n', 2, 'd', 2))"
    rows = spark.range(4).selectExpr("cast(id AS string) AS item_id", f"IF(id = 3, {half(1)}, {half(2)}) AS v")
    assert [tuple(r) for r in B.target_violations(rows).collect()] == [("own target scores 1", "3", "does not hold")]


def test_equal_targets_are_judged_once(spark, monkeypatch):
    """3,000 items with three targets, one of which has no gold id: a verdict that differs at each call is the same for equal ones."""
    from loamline.operators import bank as B

    monkeypatch.setattr(B.V, "verdict", lambda kind, reply, gold, credits: F.concat_ws(" ", F.expr("uuid()"), kind, reply, gold["cwe"], credits["x"].cast("string")))
    rows = spark.range(3000).selectExpr("cast(id AS string) AS item_id", "'exact_id' AS type", "concat('N', id % 3) AS target", "named_struct('cwe', nullif(concat('N', id % 3), 'N2')) AS gold")
    got = B.own_verdicts(rows, F.lower("target"), F.col("gold"), F.create_map(F.lit("x"), F.lit(8))).collect()
    assert len(got) == len({r.item_id for r in got}) == 3000 and len({r.v for r in got}) == 3
    assert all(r.v.split(" ")[1:] == [w for w in ("exact_id", f"n{k}", f"N{k}" if k < 2 else "", "8") if w] for r in got for k in [int(r.item_id) % 3])


def moved(spark, run):
    """Rows that Spark's shuffles wrote during a run."""
    bus = spark.sparkContext._jsc.sc().listenerBus()
    of = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in _stages(spark)}
    bus.waitUntilEmpty(60_000)
    before = of()
    run()
    bus.waitUntilEmpty(60_000)
    return sum(n for k, n in of().items() if k not in before)


def _stages(spark):
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def test_distances_move_no_pairs(spark):
    """A star of 1,500 has over two million pairs; what is moved grows with its nodes."""
    from loamline.operators import graph as G

    star = spark.range(1500).select(F.concat(F.lit("S"), "id").alias("child"), F.lit("N").alias("parent"))
    got = []
    rows = moved(spark, lambda: got.extend(G.distances(star, 3).groupBy("distance").agg(F.count("*").alias("n"), F.sum((F.col("node") == F.col("other")).cast("int")).alias("same")).collect()))
    assert sorted(map(tuple, got)) == [(1, 3000, 0), (2, 1500 * 1499, 0)]
    assert rows < 100_000


@pytest.mark.parametrize(("seed", "cap"), [(1, 1), (2, 2), (3, 3), (4, 4)])
def test_distances_by_definition(spark, monkeypatch, seed, cap):
    """Nodes that have the same neighbours, loops, nulls and nodes of many neighbours, in blocks of two."""
    import random

    from loamline.operators import graph as G

    monkeypatch.setattr(G, "BLOCK", 2)
    monkeypatch.setattr(G, "LISTED", 3)
    r = random.Random(seed)
    pairs = {(f"n{b}", f"n{a}") for b in range(1, 8) for a in r.sample(range(b), 1)} | {(f"s{i}", f"n{r.randrange(4)}") for i in range(14)}
    pairs |= {("t1", "u1"), ("t1", "u2"), ("t2", "u1"), ("t2", "u2"), ("l1", "l1"), ("l1", "l2"), ("l2", "l2"), ("n3", "n3"), (None, "n1"), ("s1", None)}
    near = {(a, b) for c, p in pairs for a, b in ((c, p), (p, c))}
    want, step = dict.fromkeys(near, 1), {k for k in near if None not in k}
    for d in range(2, cap + 1):
        step = {(a, c) for a, b in step for x, c in near if b == x and c is not None and a != c} - set(want)
        want |= dict.fromkeys(step, d)
    e = spark.createDataFrame(sorted(pairs, key=str), "child string, parent string")
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, G.distances(e, cap).collect()), key=key) == sorted(((*k, v) for k, v in want.items()), key=key)
    some = spark.createDataFrame([("s1",), ("s5",), ("n0",), ("l1",), ("t2",), ("x",)], "id string")
    assert sorted(map(tuple, G.distances(e, cap, some).collect()), key=key) == sorted(((*k, v) for k, v in want.items() if k[0] in ("s1", "s5", "n0", "l1", "t2")), key=key)


@pytest.mark.parametrize("big", [1, 1 << 50])
def test_bootstrap_sums_by_definition(spark, monkeypatch, big):
    """Several chunks of draws and blocks of values, values that are null, and rows that are moved far less often than drawn."""
    import hashlib

    from loamline.operators import inference as I

    monkeypatch.setattr(I, "DRAWS", 512)
    monkeypatch.setattr(I, "VALUES", 256)
    n, resamples = 1500, 40
    v = [None if i % 7 == 3 else big * (i % 11 - 4) for i in range(n)]
    rows = spark.createDataFrame([(n - 2 * i, x) for i, x in enumerate(reversed(v))], "k int, v long").repartition(3)
    order = sorted((n - 2 * i, x) for i, x in enumerate(reversed(v)))
    rank = lambda r, i: int(hashlib.sha256(f"boot\x1f{r}\x1f{i}".encode()).hexdigest()[:16], 16)
    want = {r: sum(order[rank(r, i) % n][1] or 0 for i in range(n)) for r in range(resamples)}
    got = []
    rows = moved(spark, lambda rows=rows: got.extend(I.bootstrap_sums(rows, "k", "v", resamples).collect()))
    assert {r.resample: r.total for r in got} == want and len(got) == resamples
    assert rows < n * resamples / 4


def test_bootstrap_sums_of_nothing(spark):
    from loamline.operators import inference as I

    assert I.bootstrap_sums(spark.createDataFrame([], "k int, v long"), "k", "v", 5).collect() == []
    assert [tuple(r) for r in I.bootstrap_sums(spark.createDataFrame([(1, None), (2, None)], "k int, v long"), "k", "v", 2).orderBy("resample").collect()] == [(0, None), (1, None)]


def test_strong_components_take_every_order(spark, compare, tmp_path):
    """No order's number is divisible by 7; customer 6 has an order that leads back to it alone."""
    orders = "SELECT range * 7 + 1 AS o_orderkey, range % 5 AS o_custkey FROM range(20) UNION ALL SELECT 7 * x + 2, 9 FROM (SELECT 1 AS x) UNION ALL SELECT 4, 6"
    assert 4 * 7919 % 10 == 6
    got = against_sql(spark, compare, tmp_path, "q_strong_components", orders=orders)
    assert (6, 6) in set(zip(got.id, got.component)) and len(got) > 1


def test_strong_components_broadcast_nothing(spark):
    """No table goes through the driver, in any of the rounds."""
    from loamline.operators import graph as G

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    store = spark._jsparkSession.sharedState().statusStore()
    plans = lambda: {(x := found.apply(i)).executionId(): x.physicalPlanDescription() for found in [store.executionsList()] for i in range(found.size())}
    last = max(plans(), default=-1)
    edges = spark.range(60).select((F.col("id") % 40).alias("child"), ((F.col("id") * 7 + 3) % 40).alias("parent"))
    assert G.strong_components(edges).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    new = [p for k, p in plans().items() if k > last]
    assert any("SortMergeJoin" in p for p in new) and not any("BroadcastExchange" in p for p in new)


def test_ordered_lines_are_written_from_many_partitions(spark, monkeypatch, tmp_path):
    """Documents come to the writer as they are read or by as many tasks as a shuffle has, not by a fixed few."""
    from loamline.plans import streams

    seen, write = [], streams.ordered.write_lines
    monkeypatch.setattr(streams.ordered, "write_lines", lambda df, *a: (seen.append(df.rdd.getNumPartitions()), write(df, *a)))
    (tmp_path / "documents.parquet").mkdir()
    for i in range(6):
        spark.read.parquet(f"{SMALL}/documents.parquet").where(F.col("doc_id") % 6 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(streams, "load", lambda s, d, t: s.read.parquet(f"{d}/{t}.parquet").repartition(11))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = streams.q_ordered_gzip(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert seen == [11, 13] and len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").where("text IS NOT NULL").count() and all(r.equal_bytes for r in rows)


def test_ordered_ties_and_long_common_beginnings(spark, tmp_path):
    import gzip

    from loamline.sources import ordered

    lines = [f"{'x' * 70}{i % 50:03}é" for i in range(400)] + [f"y{i}" for i in range(100)]
    df = spark.createDataFrame([(i % 2, x) for i, x in enumerate(lines)], "k int, line string")
    for n, parts in enumerate((1, 9)):
        ordered.write_lines(df.repartition(parts), "line", ["k"], str(tmp_path / str(n)), 60)
    files = [sorted((tmp_path / str(n)).glob("*.gz")) for n in (0, 1)]
    assert [f.read_bytes() for f in files[0]] == [f.read_bytes() for f in files[1]]
    assert [x for f in files[0] for x in gzip.decompress(f.read_bytes()).decode().splitlines()] == [x for _, x in sorted((i % 2, x) for i, x in enumerate(lines))]
