"""Embedding near-duplicates by a forest of random-projection trees with spill."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import small_batches, written

#: Rows of a leaf at which splitting ends; share of a node's rows, on each side of the median, that go to both sides.
LEAF, SPILL = 128, 0.05
#: The chance that one split parts a pair at the threshold, and the chance that all trees part it that decides how many trees a node has.
PARTS, MISSES = 0.045, 0.005
#: Rows, by hash, on which a node's trees are fitted, and rows of such a sample under which it is not split; rows of one task that takes rows down.
SAMPLE, LEAST, CHUNK = 16_384, 16, 20_000
#: Share of a node's pairs that link, in a sample of PROBE rows, from which on it isn't split: such a node is a cluster, whose pairs must be counted anyway.
DENSE, PROBE = 0.1, 256
#: Rows of a block: a leaf of more rows is split in a further round, of which there are ROUNDS at most, or else compared block by block, all pairs of blocks.
BLOCK, ROUNDS = 2048, 6
COSINE = 0.93


def trees_for(rows, leaf: int):
    """How many trees a node of so many rows has (a column): one where nothing is split, more the deeper they are.

    A split's spill leaves a pair of cosine 0.93, whose projections differ by 0.37 of a vector's own spread, apart in PARTS of all cases (a difference
    beyond twice SPILL's quantile, about the median); a tree of some depth parts it with 1 - (1 - PARTS) ** depth, and trees are independent.
    """
    depth = F.greatest(F.ceil(F.log(rows / F.lit(float(leaf))) / F.lit(float(np.log(1 / (0.5 + SPILL))))), F.lit(0))
    miss = 1 - F.pow(F.lit(1 - PARTS), depth)
    return F.when(depth == 0, 1).otherwise(F.ceil(F.log(F.lit(MISSES)) / F.log(miss))).cast("int")


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors that can have links, with id and label, in their own precision."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("embedding", lambda x: x != 0)
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & ~zero)
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    e = F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))  # -0.0 and 0.0 are one
    return good.select("vec_id", "label", e.alias("v"))


def directions(tree: int, path: str, width: int) -> np.ndarray:
    """The random direction of a node: the same wherever it is asked for."""
    import xxhash

    return np.random.default_rng(xxhash.xxh64_intdigest(f"{tree}/{path}/{width}")).standard_normal(width)


def unit(column, width: int | None = None) -> np.ndarray:
    """The rows of a list column as doubles of length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, width or 1)
    big = np.abs(x).max(1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(1, keepdims=True))


SPLITS = pa.list_(pa.struct([("path", pa.string()), ("low", pa.float64()), ("high", pa.float64())]))


def fit_splits(leaf: int, cosine: float):
    """Of a node's sample, the splits of a tree until its leaves hold `leaf` of all the node's rows, or are clusters: the bounds between which rows go to both sides."""

    def run(group):
        node, tree, rows = (group.column(c)[0].as_py() for c in ("node", "tree", "rows"))
        x, out = unit(group.column("v").combine_chunks()), []
        stack = [("", np.arange(len(x)))]
        while stack:
            path, at = stack.pop()
            if len(at) * rows <= leaf * len(x) or len(at) < LEAST or len(path) > 60:
                continue
            some = x[at[:: -(-len(at) // PROBE)]]
            if ((some @ some.T >= cosine).sum() - len(some)) > DENSE * len(some) * (len(some) - 1):
                continue
            p = x[at] @ directions(tree, f"{node}/{path}", x.shape[1])
            low, high = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
            sides = at[p <= high], at[p >= low]
            if max(map(len, sides)) > 0.9 * len(at):  # rows are nearly equal
                continue
            out.append({"path": path, "low": float(low), "high": float(high)})
            stack += [(path + "0", sides[0]), (path + "1", sides[1])]
        return pa.table({"node": pa.array([node], pa.int64()), "tree": pa.array([tree], pa.int32()), "splits": pa.array([out], SPLITS)})

    return run


def descend(rows, splits):
    """The leaves of every tree that each row of a chunk of a node comes to, both sides where it spills: (rep, leaf)."""
    import xxhash

    reps, leaves, whole = [], [], set()
    if rows.num_rows:
        rep, x = rows.column("rep").to_numpy(), unit(rows.column("v").combine_chunks())
        for node, tree, found in zip(*(splits.column(c).to_pylist() for c in ("node", "tree", "splits")), strict=True):
            bounds = {s["path"]: s for s in found}
            stack = [("", np.arange(len(rep)))]
            while stack:
                path, at = stack.pop()
                if path in bounds and len(at):
                    p = x[at] @ directions(tree, f"{node}/{path}", x.shape[1])
                    stack += [(path + "0", at[p <= bounds[path]["high"]]), (path + "1", at[p >= bounds[path]["low"]])]
                elif len(at):
                    name = f"{node}/{tree}/{path}" if path else f"{node}/"  # a tree without splits is the node itself
                    if path or name not in whole:
                        leaves.append(np.full(len(at), np.uint64(xxhash.xxh64_intdigest(name))).astype(np.int64))
                        reps.append(rep[at])
                    whole.add(name)
    none = np.zeros(0, np.int64)
    return pa.table({"rep": pa.array(np.concatenate([none, *reps])), "leaf": pa.array(np.concatenate([none, *leaves]))})


def split_nodes(rows: DataFrame, trees: int | None, leaf: int, cosine: float) -> DataFrame:
    """rows (node, rows, rep, v): every row of a node with the number of them all. Returns (rep, leaf) for each leaf of each tree that a row is in.

    trees: of each node; None: as many as its rows ask for. Trees without a split have one leaf together.

    The trees of a node are fitted on a sample of bounded size, each by one task; then the node's rows are dealt to chunks, which go down all
    its trees at once. So a vector is moved once for all trees, and once more for each tree if it is in the sample.
    """
    share = (F.xxhash64(F.lit(5), "rep").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))) < F.lit(SAMPLE) / F.col("rows")
    sample = rows.where(share).withColumn("tree", F.explode(F.sequence(F.lit(0), (trees_for(F.col("rows"), leaf) if trees is None else F.lit(trees)) - 1)))
    fitted = written(sample.select("node", "tree", "rows", "v").groupBy("node", "tree").applyInArrow(fit_splits(leaf, cosine), "node long, tree int, splits array<struct<path:string,low:double,high:double>>"), "splits")
    chunks = F.ceil(F.col("rows") / CHUNK).cast("int")
    nodes = rows.groupBy("node").agg(F.max("rows").alias("rows")).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select("node", "chunk")
    every = fitted.join(nodes, "node").groupBy("node", "chunk")
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit(6), "rep"), chunks).cast("int")).select("node", "chunk", "rep", "v")
    return dealt.groupBy("node", "chunk").cogroup(every).applyInArrow(descend, "rep long, leaf long")


def forest(reps: DataFrame, trees: int | None = None, leaf: int = LEAF, cosine: float = COSINE, rounds: int = ROUNDS) -> DataFrame:
    """reps (rep, label, v). Returns each row's leaves: (rep, leaf), a row for each leaf that it is in.

    A first round splits every label's rows, vectors of one length together. A leaf that is still larger than a block, since its sample could not tell
    more, is a node of the next round, for its own tree. A leaf that splits no further, as it is a cluster, stays as large as it is.
    """
    kinds = reps.withColumn("node", F.xxhash64("label", F.size("v")))
    sizes = written(kinds.groupBy("node").agg(F.count("*").alias("rows")).where("rows > 1"), "nodes")
    now = written(split_nodes(kinds.join(sizes, "node").select("node", "rows", "rep", "v"), trees, leaf, cosine), "forest")
    out = None
    for _ in range(rounds):
        sizes = now.groupBy("leaf").agg(F.count("*").alias("rows"))
        large = written(sizes.where(F.col("rows") > max(BLOCK, leaf)), "large")
        most = large.agg(F.max("rows")).first()[0]
        done = now if most is None else now.join(large, "leaf", "left_anti").select("rep", "leaf")
        out = done if out is None else out.union(done)
        if most is None:
            return out
        rows = now.join(large, "leaf").withColumnRenamed("leaf", "node").join(reps.select("rep", "v"), "rep").select("node", "rows", "rep", "v")
        after = written(split_nodes(rows, 1, leaf, cosine), "forest")
        if after.groupBy("leaf").agg(F.count("*").alias("rows")).agg(F.max("rows")).first()[0] >= most:
            return out.union(after)
        now = after
    return out.union(now)


def compare(cosine: float):
    """Compares a leaf's blocks i and j. Each pair counts in the first leaf, by tree and path, that both its rows are in."""

    def run(group):
        from .pairs import forest_of

        rep, n = group.column("rep").to_numpy(), group.column("n").to_numpy()
        mine, i, j = group.column("leaf")[0].as_py(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
        block = group.column("block").to_numpy()
        order = np.lexsort((rep, block))
        rep, n, block = rep[order], n[order], block[order]
        x = unit(group.column("v").combine_chunks())[order]
        leaves = group.column("leaves").combine_chunks()
        at, ids = leaves.offsets.to_numpy() - leaves.offsets[0].as_py(), leaves.flatten().to_numpy()
        owner = np.repeat(np.argsort(order), np.diff(at))
        # leaves before this one, as numbers of this group's own: rows that share one of them are counted there
        earlier = ids < mine
        names, local = np.unique(ids[earlier], return_inverse=True)
        shared = np.bincount(local, minlength=len(names)) > 1
        held = np.zeros((len(rep), int(shared.sum())), np.float32)
        col = np.cumsum(shared) - 1
        ok = shared[local] if len(names) else np.zeros(0, bool)
        held[owner[earlier][ok], col[local[ok]]] = 1
        a = np.flatnonzero(block == i)
        b = np.flatnonzero(block == j)
        links, pairs = np.zeros(len(rep), np.int64), []
        for s in range(0, len(a), 512):
            rows = a[s : s + 512]
            near = x[rows] @ x[b].T >= cosine
            near &= (rep[rows][:, None] < rep[b][None, :]) if i == j else True
            if not near.any():
                continue
            first = near & ~(held[rows] @ held[b].T > 0) if held.shape[1] else near
            links[rows] += first @ n[b]
            links[b] += first.T @ n[rows]
            p, q = np.nonzero(near)
            pairs.append(forest_of(rows[p], b[q], len(rep)))
        p = np.concatenate(pairs, 1) if pairs else np.zeros((2, 0), np.int64)
        p = forest_of(p[0], p[1], len(rep))
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array(np.concatenate([rep[p[0]], rep[some]])), "b": pa.array(np.concatenate([rep[p[1]], rep[some]])), "links": pa.array(np.concatenate([np.zeros(p.shape[1], np.int64), links[some]]))})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int | None = None, leaf: int = LEAF) -> DataFrame:
    """vectors (vec_id long, embedding array, label). Returns vec_id, n_links, component_id, kept for every row.

    Rows are compared only where labels are equal and not null. Vectors that are null, zero or hold null or non-finite components, and
    rows without id or label, link with nothing; without an id, component_id is null and kept is true. Equal vectors of a label are one
    until the end and link with each other (-0.0 equals 0.0). Vectors of different lengths don't link. Links are pairs in a common leaf of
    some tree with cosine >= `cosine` in double precision; n_links counts each once. All rows of a repeated id share its component.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    ok = written(usable(vectors).withColumn("g", F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string")), F.lit("of"), F.to_json(F.struct("label"))).cast("binary"), 256)), "vectors")
    reps = ok.groupBy("g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    reps = written(reps.select("g", "rep", "n", "label", "v").withColumn("id", F.xxhash64("g")), "reps")
    rows = written(forest(reps.select(F.col("id").alias("rep"), "label", "v"), trees, leaf, cosine), "leaves")
    # the leaf's number orders leaves; a pair counts in the first that both its rows are in
    own = rows.groupBy("rep").agg(F.sort_array(F.collect_set("leaf")).alias("leaves")).join(reps.select(F.col("id").alias("rep"), "n", "v"), "rep")
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("rows")).where("rows > 1")
    many = F.ceil(F.col("rows") / BLOCK).cast("int")
    dealt = rows.join(sizes, "leaf").join(own, "rep").withColumn("block", F.pmod(F.xxhash64(F.lit(9), "rep"), many).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    dealt = dealt.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "v", "leaves")
    found = written(dealt.groupBy("leaf", "i", "j").applyInArrow(compare(cosine), "a long, b long, links long"), "found")
    counts = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(found.where("a <> b").select("a", "b"))
    named = reps.select("g", "id", "rep", "n").join(counts, F.col("id") == F.col("a"), "left").drop("a").join(joined.withColumnRenamed("id", "c"), F.col("id") == F.col("c"), "left").drop("c")
    named = named.withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("g", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = ok.select("vec_id", "g").join(named, "g").select("vec_id", "n_links", "component_id")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("embedding", lambda x: x != 0)
    rest = vectors.where(F.col("vec_id").isNull() | F.col("label").isNull() | F.col("embedding").isNull() | bad).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embeddings(spark, sf_dir):
    """All vectors. Null, zero and non-finite ones, and rows without a label, link with nothing."""
    from .shared import table

    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
