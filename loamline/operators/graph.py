"""Hierarchies given as edges (child, parent), and components of links."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import scratch, spread


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, ancestor, depth): every proper ancestor with its least depth. Paths double in each round, so 64 rounds hold any depth; a cycle is refused."""
    found = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    size = None
    for _ in range(rounds):
        longer = found.alias("x").join(found.alias("y"), F.col("x.ancestor") == F.col("y.node")).select("x.node", "y.ancestor", (F.col("x.depth") + F.col("y.depth")).alias("depth"))
        found = kept(found.union(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        *now, cycle = found.agg(F.count("*"), F.sum("depth"), F.bool_or(F.col("node") == F.col("ancestor"))).first()
        if cycle:
            raise ValueError("the hierarchy has a cycle")
        if now == size:
            return found
        size = now
    raise RuntimeError(f"the closure isn't complete after {rounds} rounds")


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder that spark.checkpoint.dir names; where none is named and Spark runs in one process, in a temporary one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, lineage cut."""
    path = scratch(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(rows: DataFrame, column: str, ids: DataFrame | None) -> DataFrame:
    """Rows whose column is one of ids (its first column), or all without ids."""
    return rows if ids is None else rows.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


#: Children of one parent that meet all its children in one group.
CHILDREN = 256


def siblings(edges: DataFrame, above: DataFrame, nodes: DataFrame | None = None, others: DataFrame | None = None) -> DataFrame:
    """(node, sibling): other children of any parent, without ancestors and descendants; with nodes and others (id) only of those.

    There may be as many pairs as the square of a parent's children. So a parent's children meet in groups of some hundred of them with all, and whether a pair is given by its
    least parent, and isn't above or below, is told from what a child carries: its parents and ancestors. No pair is moved.
    """
    up = above.groupBy("node").agg(F.collect_set("ancestor").alias("up"))
    carried = edges.groupBy(F.col("child").alias("node")).agg(F.array_sort(F.collect_set("parent")).alias("ps")).join(up, "node", "left")
    carried = carried.select("node", "ps", F.coalesce("up", F.array().cast(dict(up.dtypes)["up"])).alias("up"), F.explode("ps").alias("p"))
    a, b = only(carried, "node", nodes).toDF("node", "ps", "up", "p"), only(carried, "node", others)
    groups = a.groupBy("p").agg(F.ceil(F.count("*") / CHILDREN).alias("n"))
    left = spread(a.join(groups, "p").withColumn("r", F.pmod(F.xxhash64("node"), "n")).drop("n"), "p", "r")
    right = b.toDF("sibling", "ps_b", "up_b", "p").join(groups, "p").withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    pairs = left.join(spread(right, "p", "r"), ["p", "r"]).where(F.col("node") != F.col("sibling"))
    first = F.col("p") == F.array_min(F.array_intersect("ps", "ps_b"))
    return pairs.where(first & ~F.array_contains("up", F.col("sibling")) & ~F.array_contains("up_b", F.col("node"))).select("node", "sibling")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other): parents and children."""
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("other")).union(edges.select(F.col("parent").alias("node"), F.col("child").alias("other"))).distinct()


#: Nodes with more neighbours than this are told apart without a list of them.
LISTED = 16
#: Members of a class that meet at once.
BLOCK = 1024


def alike(near: DataFrame) -> DataFrame:
    """near: neighbours() without nulls. Returns (node, head, n): nodes that have the very same neighbours are one class, named by its least node, of n. Nodes with many neighbours are alone."""
    few = near.groupBy("node").agg(F.count("*").alias("k")).where(F.col("k") <= LISTED).select("node")
    lists = near.join(few, "node").groupBy("node").agg(F.array_sort(F.collect_list("other")).alias("near"))
    classes = lists.groupBy("near").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    many = lists.join(classes, "near").select("node", "head", "n")
    alone = near.select("node").distinct().join(many.select("node"), "node", "left_anti")
    return many.union(alone.select("node", F.col("node").alias("head"), F.lit(1).cast("long").alias("n")))


def distances(edges: DataFrame, cap: int, nodes: DataFrame | None = None) -> DataFrame:
    """(node, other, distance): shortest undirected distances of 1 to cap, with nodes (id) only from those. A missing pair is farther.

    There may be as many pairs as the square of a parent's children. Nodes with the same neighbours have the same distances to all others, and 2 (or 1, if they are their own
    neighbours) to each other: so distances are found between one node of each class, and the members of two classes meet in blocks, each pair once, where they stand.
    """
    near = neighbours(edges)
    lost = only(near.where("node IS NULL OR other IS NULL"), "node", nodes).withColumn("distance", F.lit(1))  # nulls lead nowhere
    near = near.where("node IS NOT NULL AND other IS NOT NULL")
    members = stored(alike(near))
    heads = members.where("node = head").select("node")
    near = stored(near.join(heads, "node", "left_semi").join(heads.toDF("other"), "other", "left_semi").select("node", "other"))
    asked = only(members, "node", nodes)
    found = only(near, "node", asked.select("head")).withColumn("distance", F.lit(1))
    frontier = found
    for d in range(2, cap + 1):
        frontier = frontier.select("node", F.col("other").alias("via")).join(near.select(F.col("node").alias("via"), "other"), "via").where("node <> other").select("node", "other").distinct()
        frontier = frontier.join(found.select("node", "other"), ["node", "other"], "left_anti").withColumn("distance", F.lit(d))
        found = found.union(frontier)
    many = members.where("n > 1 AND node = head")
    if cap > 1:
        within = only(many, "node", asked.select("head")).join(near.where("node = other").select("node"), "node", "left_anti")
        found = found.union(within.select("node", F.col("node").alias("other"), F.lit(2).alias("distance")))
    of = lambda c: many.select(F.col("node").alias(c), F.ceil(F.col("n") / BLOCK).alias(f"n_{c}"))
    sized = found.join(of("node"), "node", "left").join(of("other"), "other", "left")
    plain = sized.where("n_node IS NULL AND n_other IS NULL").select("node", "other", "distance")
    dealt = sized.where("n_node IS NOT NULL OR n_other IS NOT NULL").withColumnsRenamed({"node": "a", "other": "b"})
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(c, F.lit(1)) - 1))
    dealt = dealt.withColumn("i", every("n_node")).withColumn("j", every("n_other")).select("a", "b", "i", "j", "distance")
    at = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK))
    left = dealt.join(asked.select("node", F.col("head").alias("a"), at.alias("i")), ["a", "i"])
    right = dealt.drop("distance").join(members.select(F.col("node").alias("other"), F.col("head").alias("b"), at.alias("j")), ["b", "j"])
    by = ["a", "b", "i", "j"]
    pairs = spread(left, *by).join(spread(right, *by), by).where("distance = 1 OR node <> other")
    return lost.union(plain).union(pairs.select("node", "other", "distance"))


def relations(edges: DataFrame, above: DataFrame | None = None, preds: DataFrame | None = None, golds: DataFrame | None = None) -> DataFrame:
    """(pred, gold, relation) for nodes within two undirected steps. At two steps any ancestor, by whatever path, comes before any descendant, then
    a sibling, then a coparent. above: closure(edges), if it is there already; with preds and golds (id) only of those.

    Siblings may be as many as the square of a parent's children; they come from siblings(), which moves no pair. All else is found from edges and closure.
    """
    above = closure(edges) if above is None else above
    edges = edges.where("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct()
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("n")).distinct()
    of = lambda df: only(only(df, "pred", preds), "gold", golds)
    told = lambda df, kind: of(df).withColumn("relation", F.lit(kind))
    exact = told(nodes.select(F.col("n").alias("pred"), F.col("n").alias("gold")), "exact")
    child, parent = (told(edges.select(F.col(p).alias("pred"), F.col(g).alias("gold")), kind) for p, g, kind in (("child", "parent", "child"), ("parent", "child", "parent")))
    high = above.where("node <> ancestor").select("node", "ancestor").join(edges.toDF("node", "ancestor"), ["node", "ancestor"], "left_anti")
    up, down = edges.toDF("node", "via"), edges.toDF("via", "node")
    reached = [
        high.join(up, "node").join(edges.toDF("via", "ancestor"), ["via", "ancestor"], "left_semi"),  # a parent's parent
        high.join(up, "node").join(edges.toDF("ancestor", "via"), ["via", "ancestor"], "left_semi"),  # a parent in common
        high.join(down, "node").join(edges.toDF("via", "ancestor"), ["via", "ancestor"], "left_semi"),  # a child in common
    ]
    two = reduce(DataFrame.union, [r.select("node", "ancestor") for r in reached]).distinct()
    over, under = told(two.toDF("gold", "pred"), "ancestor_2"), told(two.toDF("pred", "gold"), "descendant_2")
    same = siblings(edges, above, preds, golds).toDF("pred", "gold").withColumn("relation", F.lit("sibling"))
    x, y = edges.toDF("via", "pred"), edges.toDF("via", "gold")
    both = x.join(y, "via").where("pred <> gold").select("pred", "gold").distinct()
    for p, g in (("node", "ancestor"), ("ancestor", "node")):
        both = both.join(above.select(F.col(p).alias("pred"), F.col(g).alias("gold")), ["pred", "gold"], "left_anti")
    shared = both.join(edges.toDF("pred", "via"), "pred").join(edges.toDF("gold", "via"), ["gold", "via"], "left_semi").select("pred", "gold").distinct()
    co = told(both.join(shared, ["pred", "gold"], "left_anti"), "coparent")
    return reduce(DataFrame.union, [k.select("pred", "gold", "relation") for k in (exact, child, parent, over, under, same, co)])


def node_flags(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id, kind, abstraction, status); adds is_category, is_view, is_deprecated (a weakness that is) and in_view: a weakness that isn't deprecated and has a
    parent or is a pillar."""
    parented = edges.select(F.col("child").alias("id"), F.lit(True).alias("_has")).distinct()
    weak = F.col("kind") == "weakness"
    old = weak & F.coalesce(F.col("status") == "Deprecated", F.lit(False))
    live = weak & ~old & (F.coalesce("_has", F.lit(False)) | F.coalesce(F.col("abstraction") == "Pillar", F.lit(False)))
    return nodes.join(parented, "id", "left").withColumns({"is_category": F.col("kind") == "category", "is_view": F.col("kind") == "view", "is_deprecated": old, "in_view": live}).drop("_has")


def relation_of(pairs: DataFrame, pred: str, gold: str, relation: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds relation to rows: far where the prediction isn't one of nodes (id) or is farther than two steps. A gold that isn't one of nodes is an error."""
    known = nodes.select("id").distinct()
    out = pairs.join(known.select(F.col("id").alias(gold), F.lit(True).alias("_gold")), gold, "left")
    out = out.withColumn(gold, F.when(F.col("_gold"), F.col(gold)).otherwise(F.raise_error(F.concat(F.lit("gold is not a live node: "), F.coalesce(F.col(gold).cast("string"), F.lit("null")))).cast(dict(pairs.dtypes)[gold])))
    out = out.join(known.select(F.col("id").alias(pred), F.lit(True).alias("_pred")), pred, "left").join(relation.toDF(pred, gold, "relation"), [pred, gold], "left")
    return out.withColumn("relation", F.when(F.col("_pred"), F.coalesce("relation", F.lit("far"))).otherwise("far")).drop("_gold", "_pred").select(*pairs.columns, "relation")


# Credit in eighths.
SYMMETRIC = {"exact": 8, "child": 4, "parent": 4, "ancestor_2": 2, "descendant_2": 2, "sibling": 2, "coparent": 2}
DIRECTED = {"exact": 8, "child": 4, "parent": 2, "descendant_2": 2, "sibling": 2, "coparent": 2, "ancestor_2": 1, "far": 0}


def credit(relation: Column, table: dict[str, int] = SYMMETRIC) -> Column:
    """Eighths; far and unknown are 0."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), relation), F.lit(0))


def component_labels(links: DataFrame, rounds: int = 200) -> DataFrame:
    """links (a, b). Returns (id, component): the smallest id reached. Nulls link nothing; a link of an id with itself makes it a component.

    Stars are contracted: in turn all larger neighbours of an id, then all smaller ones, are linked to the smallest of them. A step moves each link
    once, whatever a component's or a neighbourhood's size, and the number of steps grows with the logarithm of the number of ids. It stops with an
    error, never with unfinished components.
    """
    alone = links.where("a = b").select(F.col("a").alias("id")).distinct()
    step = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(rounds):
        both = step.union(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least.withColumn("m", F.least("a", "m")), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        step = stored(small)
        now = step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            found = step.select(F.col("a").alias("id"), F.col("b").alias("component")).union(step.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
            return found.union(alone.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("component")))
        last = now
    raise RuntimeError(f"components aren't complete after {rounds} rounds")


def met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that deals both tables to tasks by key. A table that is broadcast goes through the driver, and where each of many rounds has several of them, all that grows with the input."""
    return left.join(right.hint("merge"), on, how)


def furthest(edges: DataFrame, rounds: int) -> DataFrame:
    """edges (a, b). Returns (id, top): of each node the largest node from which it is reached, itself included.

    What reaches a node's top so far reaches the node, so a step takes the best of a node's parents and then its top's own top: paths are crossed in jumps that grow.
    """
    top = stored(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("top", F.col("id")))
    for _ in range(rounds):
        near = met(edges, top.toDF("a", "t"), "a").groupBy("b").agg(F.max("t").alias("t")).withColumnRenamed("b", "id")
        up = met(top, near, "id", "left").select("id", F.greatest("top", "t").alias("top"))
        new = stored(met(up, up.toDF("top", "t"), "top").select("id", F.greatest("top", "t").alias("top")))
        if met(new, top, ["id", "top"], "left_anti").isEmpty():
            return top
        top = new
    raise RuntimeError(f"reachability isn't complete after {rounds} rounds")


def raked(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of rake and compress on edges (a, b) without loops: nodes without a parent or a child go, and each chain of nodes with one of each becomes one edge.

    Both ends of a chain are found by jumps that double, so in as many steps as its length's logarithm. Returns what is left, loops among it; (id, up, down) of the chains' nodes,
    with the ends of their chains; and (id, component) of those whose chain has no end, as it is a cycle.
    """
    out = edges.groupBy("a").agg(F.count("*").alias("n_out"), F.min("b").alias("down")).withColumnRenamed("a", "id")
    into = edges.groupBy("b").agg(F.count("*").alias("n_in"), F.min("a").alias("up")).withColumnRenamed("b", "id")
    inner = stored(met(out, into, "id"))
    thin = "n_in = 1 AND n_out = 1"
    stay = inner.where(f"NOT ({thin})").select("id")
    jumps, n, length = inner.where(thin).select("id", "up", "down", F.col("id").alias("least")), inner.where(thin).count(), 1
    while n and length < 2 * n:
        on, before = jumps.select(F.col("id").alias("down"), F.col("down").alias("d"), F.col("least").alias("l")), jumps.select(F.col("id").alias("up"), F.col("up").alias("u"))
        far = met(met(jumps, on, "down", "left"), before, "up", "left")
        jumps = stored(far.select("id", F.coalesce("u", "up").alias("up"), F.coalesce("d", "down").alias("down"), F.least("least", "l").alias("least"), (F.col("d").isNotNull() | F.col("u").isNotNull()).alias("on")))
        length *= 2
        if jumps.where("on").isEmpty():
            break
    round_ = met(jumps, inner.where(thin).select(F.col("id").alias("down")), "down", "left_semi").select("id", F.col("least").alias("component"))
    gone = met(jumps, round_.select("id"), "id", "left_anti").select("id", "up", "down")
    rest = edges.select("a", "b").union(gone.select(F.col("up").alias("a"), F.col("down").alias("b")))
    left = met(met(rest, stay.toDF("a"), "a", "left_semi"), stay.toDF("b"), "b", "left_semi").select("a", "b").distinct()
    return stored(left), gone, round_


def strong_components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """edges (child, parent). Returns (id, component) of every node that is on a cycle: nodes that reach each other have one component, named by the smallest of them.

    Trees and chains are raked and compressed away, in a number of rounds that grows with the logarithm of their length; a chain's nodes are on a cycle if its two ends are on
    one. What is left is cut by reachability both ways: of each node the largest node that reaches it and the largest that it reaches; where both
    are one node, they are its component; edges between nodes that differ in either are on no cycle, and the rest is cut again. Nulls are no nodes.
    """
    e = stored(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    loops, found, given_way = [e.where("a = b").select(F.col("a").alias("id"))], [], []
    n = e.where("a <> b").count()
    for _ in range(rounds):
        if not n:
            break
        before = n
        e, gone, round_ = raked(e.where("a <> b"))
        n = e.where("a <> b").count()
        given_way.append(gone)
        found.append(round_)
        loops.append(e.where("a = b").select(F.col("a").alias("id")))
        if not n or n <= 0.9 * before:
            continue
        e = e.where("a <> b")
        there = furthest(e, rounds)
        back = furthest(e.select(F.col("b").alias("a"), F.col("a").alias("b")), rounds)
        named = stored(met(there, back.toDF("id", "low"), "id"))
        whole = named.where("top = low").select("id", F.col("top").alias("component"))
        many = whole.groupBy("component").count().where("count > 1").select("component")
        found.append(met(whole, many, "component").select("id", "component"))
        open_ = named.where("top <> low")
        ends = lambda c: open_.select(F.col("id").alias(c), F.col("top").alias(f"top_{c}"), F.col("low").alias(f"low_{c}"))
        e = stored(met(met(e, ends("a"), "a"), ends("b"), "b").where("top_a = top_b AND low_a = low_b").select("a", "b"))
        n = e.count()
    else:
        if n:
            raise RuntimeError(f"cycles aren't complete after {rounds} rounds")
    looped = stored(reduce(DataFrame.union, loops).distinct())
    known = stored(reduce(DataFrame.union, found, looped.select("id", F.col("id").alias("component")).where("false")))
    chained = reduce(DataFrame.union, [g.select("id") for g in given_way], looped.where("false"))
    alone = met(met(looped, known, "id", "left_anti"), chained, "id", "left_anti")
    known = known.union(alone.select("id", F.col("id").alias("component")))
    for gone in reversed(given_way):
        if gone.isEmpty():
            continue
        each = met(met(met(gone, known.toDF("up", "c_up"), "up", "left"), known.toDF("down", "c_down"), "down", "left"), looped.withColumn("loop", F.lit(True)), "id", "left")
        each = each.select("id", F.when(F.col("c_up") == F.col("c_down"), F.col("c_up")).when(F.col("loop"), F.col("id")).alias("component")).where("component IS NOT NULL")
        known = stored(known.union(each))
    return met(known, known.groupBy("component").agg(F.min("id").alias("least")), "component").select("id", F.col("least").alias("component"))


def clusters(rows: DataFrame, key: str, order: list[str], links: DataFrame) -> DataFrame:
    """Adds cluster_id, the member that is first by order and key, and cluster_size. Rows without links are clusters of their own."""
    labels = component_labels(links).toDF("_id", "_component")
    out = rows.join(labels, rows[key] == labels["_id"], "left").withColumn("_c", F.coalesce("_component", key)).drop("_id", "_component")
    heads = out.groupBy("_c").agg(F.min(F.struct(*order, key))[key].alias("cluster_id"), F.count("*").alias("cluster_size"))
    return out.join(heads, "_c").drop("_c")
