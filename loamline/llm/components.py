"""Connected components of a graph given as links, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def local_forest(batches):
    """Of the links in a partition, keep as many as connect what they connect."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = list(range(len(names)))

        def find(i, root=root):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            i, j = find(i), find(j)
            if i != j:
                root[max(i, j)] = min(i, j)
        roots = np.array([find(i) for i in range(len(names))], dtype=np.int64)
        keep = roots != np.arange(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[roots[keep]]), pa.array(names[keep])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """links: (a long, b long), neither null. Returns (id, component): for each linked id the smallest id that its links reach.

    Each step moves at most one row for each link, whatever a vertex's degree; the number of steps grows with the logarithm
    of the number of vertices. A batch of links is first cut to a forest. Each step is a written table, so a lost executor
    costs a part of one step. No links: an empty table.
    """
    step = written(links.where("a <> b").select("a", "b").mapInArrow(local_forest, "a long, b long").distinct(), "links")
    last = None
    while True:
        # large star: larger neighbours go to the smallest of the neighbourhood
        both = step.select("a", "b").union(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: smaller neighbours, and the vertex itself, go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("m"), F.explode(F.array("a", "b")).alias("b")).where("m <> b").select(F.col("m").alias("a"), "b").distinct()
        after = written(small, "links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(step)
        step = after
        if state == last:
            return step.select(F.col("b").alias("id"), F.col("a").alias("component")).union(step.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
        last = state
