"""Exact Jaccard join on word shingles by signature trees.

A document's set of shingle hashes has a bitmap. A tree's nodes hold the OR of their documents' bitmaps, the range of their sizes, and the
most shingles that a bitmap of theirs hides (size less set bits). Two documents share at most the bits common to both bitmaps and the
lesser number hidden, so two nodes can hold no link if even that is too few for their least sizes.

Trees are built and traversed twice. First over lists of documents with a common key, on bitmaps alone: pairs that may link make families
(connected groups). Then over each family, on bitmaps and whole sets: pairs are verified where they are found. Either time a task gives
only which of its documents belong together, so what leaves it is no longer than what came in, however many pairs there are.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .pairs import forest_of
from .shared import dropped, free, small_batches, written
from .words import SPACED, mixed, shingle_set, words

#: Rows of one block of a list or family, and bytes of a block's bitmaps or sets; a longer one is joined block by block.
BLOCK, BLOCK_BYTES = 8192, 1 << 25
#: Documents of a leaf, children of a node; documents that the others of a block are first compared with, and rows from which on they are.
LEAF, FAN, PIVOTS, PIVOTS_FROM = 8, 8, 32, 64
#: Pairs of nodes or documents that a dual traversal expands at once, and words of their bitmaps or sets that it compares at once.
PAIRS, PAIR_WORDS = 1 << 18, 1 << 20
#: Documents on which the order of shingles is fitted, how many of them hold a common shingle, and common shingles at most. They fix an
#: order only: any order gives the same result.
SAMPLE, COMMON, MOST_COMMON = 20_000, 10, 200_000
#: Rows that name documents to fetch, of about 100 bytes each, that may be broadcast.
FETCH = 300_000


def prefix(n: int, share: int) -> int:
    """How many of the first of n shingles in a common order a set meets others by: two sets that link differ in at most (1 - share / 100) n
    of either's shingles, so of one more at least one is in the other set, and the first such is among the other's first as well."""
    return (100 - share) * n // 100 + 1


def size_class(n: int) -> int:
    """Sets of 2 ** (c - 1) < n <= 2 ** c shingles are of class c, 3 at least."""
    return max(3, (n - 1).bit_length())


def width(c: int) -> int:
    """Bits of a bitmap of class c in lists."""
    return 1 << max(6, c + 2)


def bitmap(hashes: np.ndarray) -> bytes:
    m = width(size_class(len(hashes)))
    bits = np.zeros(m, np.uint8)
    bits[(hashes & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fingerprint(hashes: np.ndarray) -> int:
    """A signed 64-bit number of a whole set."""
    both = np.array([np.add.reduce(mixed(hashes)), np.bitwise_xor.reduce(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))), len(hashes)], np.uint64)
    return int(mixed(both[:1] + mixed(both[1:2] + mixed(both[2:])))[0].astype(np.int64))


def text_sets(texts: pa.Array, k: int):
    for w in words(texts, SPACED):
        for d in range(w.n):
            yield shingle_set(w.hashes[w.at[d] : w.at[d + 1]], k)


def common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that COMMON or more documents of a sample hold, ascending, and how common they are (log2 of the count / COMMON, from 1)."""
    n = docs.count()

    def run(batches):
        for batch in batches:
            sets = list(text_sets(batch.column("text"), k))
            h, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    counts = docs.where(F.rand(7) < SAMPLE / max(n, 1)).select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h, n = rows.column("h").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], (1 + np.log2(n[order] / COMMON)).astype(np.uint8)


def keys_of(s: np.ndarray, share: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, rare before common, each by hash."""
    held, rank = common
    at = np.minimum(np.searchsorted(held, s), len(held) - 1) if len(held) else np.zeros(0, np.int64)
    is_common = held[at] == s if len(held) else np.zeros(len(s), bool)
    k = prefix(len(s), share)
    if not is_common.any():
        return s[:k]
    r = np.where(is_common, rank[at], 0)
    return s[np.lexsort((s, r))[:k]]


def sets_of(k: int, share: int, common):
    """Of each row doc_id, h, the size of its set, its fingerprint, keys and bitmap; null ones without words."""
    kind = pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            sets = list(text_sets(batch.column("text"), k))
            full = [len(s) > 0 for s in sets]
            out = [batch.column("doc_id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) if f else None for s, f in zip(sets, full, strict=True)], pa.int64())]
            out += [pa.array([keys_of(s, share, common.value).astype(np.int64) if f else None for s, f in zip(sets, full, strict=True)], kind), pa.array([bitmap(s) if f else None for s, f in zip(sets, full, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "h", "n", "g", "keys", "bits"])

    return run


class Trees:
    """Signature trees of several groups of documents, which follow one another: levels[0] are the documents, then nodes of LEAF, then of FAN
    children each; the last level has one node for each group. A level: bitmaps, least and largest size, most hidden, least and largest label."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, label: np.ndarray, start: np.ndarray):
        self.levels = [(bits, n, n, n - np.bitwise_count(bits).sum(1, dtype=np.int64), label, label)]
        self.first: list[np.ndarray] = [np.zeros(0, np.int64)]
        while len(self.levels) == 1 or np.diff(start).max(initial=1) > 1:
            step = LEAF if len(self.levels) == 1 else FAN
            nodes = -(-np.diff(start) // step)
            ends = np.concatenate([[0], np.cumsum(nodes)])
            at = np.repeat(start[:-1], nodes) + (np.arange(ends[-1]) - np.repeat(ends[:-1], nodes)) * step
            b, low, high, h, c0, c1 = self.levels[-1]
            self.first.append(np.append(at, len(b)))
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(h, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))
            start = ends

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of nodes at a level."""
        return self.first[level][nodes], self.first[level][nodes + 1] - self.first[level][nodes]


def possible(a, b, p: np.ndarray, q: np.ndarray, share: int) -> np.ndarray:
    """Whether nodes p of level a and q of level b can hold a link between different labels."""
    ok = ~((a[4][p] == a[5][p]) & (b[4][q] == b[5][q]) & (a[4][p] == b[4][q]))
    ok &= (100 * a[2][p] >= share * b[1][q]) & (100 * b[2][q] >= share * a[1][p])
    live = np.flatnonzero(ok)
    step = max(1, PAIR_WORDS // max(1, a[0].shape[1]))
    for i in range(0, len(live), step):
        s = live[i : i + step]
        x, y = p[s], q[s]
        most = np.bitwise_count(a[0][x] & b[0][y]).sum(1, dtype=np.int64) + np.minimum(a[3][x], b[3][y])
        most = np.minimum(most, np.minimum(a[2][x], b[2][y]))
        ok[s] = (100 + share) * most >= share * (a[1][x] + b[1][y])
    return ok


def dual(x: Trees, y: Trees, same: bool, share: int):
    """Pairs of documents, one of each of two trees of the same group, that may link; within a tree each pair once. Yields (p, q) in parts."""
    roots = np.arange(len(x.levels[-1][1]))
    stack = [(len(x.levels) - 1, len(y.levels) - 1, roots, roots)]
    while stack:
        i, j, p, q = stack.pop()
        step = PAIRS // ((LEAF if i == 1 else FAN if i else 1) * (LEAF if j == 1 else FAN if j else 1))
        if len(p) > step:
            stack += [(i, j, p[s : s + step], q[s : s + step]) for s in range(0, len(p), step)]
            continue
        ok = possible(x.levels[i], y.levels[j], p, q, share)
        p, q = p[ok], q[ok]
        if not len(p):
            continue
        if i == 0 and j == 0:
            yield p, q
            continue
        if i:
            first, n = x.children(i, p)
            r = np.repeat(np.arange(len(p)), n)
            p, q = (first[r] + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)), q[r]
        if j:
            first, n = y.children(j, q)
            r = np.repeat(np.arange(len(q)), n)
            q, p = (first[r] + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)), p[r]
        i, j = max(0, i - 1), max(0, j - 1)
        if same and i == j:
            keep = p < q if i == 0 else p <= q
            p, q = p[keep], q[keep]
        stack.append((i, j, p, q))


def same_as(*keys: np.ndarray) -> np.ndarray:
    """Of each row the first row with the same keys."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = order[new][np.cumsum(new) - 1]
    return out


class Labels:
    """Which documents belong together: a document's label leads to the least of its group. Groups only grow."""

    def __init__(self, label: np.ndarray):
        self.of = label.copy()

    def find(self, p: np.ndarray) -> np.ndarray:
        r = self.of[p]
        while (self.of[r] != r).any():
            r = self.of[r]
        self.of[p] = r
        return r

    def star(self, p: np.ndarray, q: np.ndarray) -> None:
        """All of q and p belong together."""
        roots = np.append(self.find(q), self.find(p))
        self.of[roots] = roots.min()

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        a, b = self.find(p), self.find(q)
        least, some = forest_of(a, b, len(self.of))
        self.of[some] = least


class Sets:
    """Sorted sets, one after another: of document d, values[at[d] : at[d] + n[d]]."""

    def __init__(self, values: np.ndarray, at: np.ndarray, n: np.ndarray):
        self.values, self.at, self.n = values, at, n

    def linked(self, p: int, q: np.ndarray, share: int) -> np.ndarray:
        """Which of q hold 100 * intersection >= share * union with p."""
        x = self.values[self.at[p] : self.at[p] + self.n[p]]
        out = np.zeros(len(q), bool)
        for rows in np.split(np.arange(len(q)), np.flatnonzero(np.diff(np.cumsum(self.n[q]) // PAIR_WORDS)) + 1):
            m = self.n[q[rows]]
            ends = np.cumsum(m)
            y = self.values[np.repeat(self.at[q[rows]] - (ends - m), m) + np.arange(ends[-1])]
            both = np.add.reduceat(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y, ends - m, dtype=np.int64)
            out[rows] = 100 * both >= share * (len(x) + m - both)
        return out


def link(labels: Labels, p: np.ndarray, q: np.ndarray, sets: Sets | None, share: int) -> None:
    """Join what pairs hold together: all of them, or with sets those that they verify. Pairs that belong together already are passed over."""
    apart = labels.find(p) != labels.find(q)
    p, q = p[apart], q[apart]
    if sets is None:
        if len(p):
            labels.join(p, q)
        return
    order = np.lexsort((q, p))
    p, q = p[order], q[order]
    for rows in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p)) + 1) if len(p) else []:
        own = p[rows[:1]]
        some = q[rows]
        some = some[labels.find(some) != labels.find(own)]
        if len(some):
            some = some[sets.linked(int(own[0]), some, share)]
        if len(some):
            labels.star(own, some)


def by_pivots(labels: Labels, level, rows: np.ndarray, sets: Sets | None, share: int) -> None:
    """Compare a large group's rows with some of them, one after another, each of a group of its own so far: most of a group of near copies joins."""
    first = 0
    for _ in range(PIVOTS):
        of = labels.find(rows)
        alone = np.bincount(of, minlength=len(labels.of))[of] == 1
        left = np.flatnonzero(alone[first:])
        if not len(left):
            return
        first += int(left[0])
        p = rows[first]
        q = rows[of != of[first]]
        ok = possible(level, level, np.full(len(q), p), q, share)
        link(labels, np.full(int(ok.sum()), p), q[ok], sets, share)
        first += 1


def folded(raw: bytes, bits: int) -> np.ndarray:
    """A bitmap of the class's width; the next class's is folded to it."""
    x = np.frombuffer(raw, np.uint8)
    return x if len(x) == bits // 8 else x[: bits // 8] | x[bits // 8 :]


def bitmaps(values: np.ndarray, at: np.ndarray, n: np.ndarray, c: int) -> np.ndarray:
    """Bitmaps of whole sets: twice as many bits as in lists, by another part of the hashes."""
    m = 1 << (c + 3)
    out = np.zeros((len(n), m // 64), np.uint64)
    step = max(1, (1 << 24) // m)
    for i in range(0, len(n), step):
        k = n[i : i + step]
        ends = np.cumsum(k)
        h = values[np.repeat(at[i : i + step] - (ends - k), k) + np.arange(ends[-1])] >> np.uint64(20)
        marks = np.zeros((len(k), m), np.uint8)
        marks[np.repeat(np.arange(len(k)), k), (h & np.uint64(m - 1)).astype(np.int64)] = 1
        out[i : i + step] = np.packbits(marks, axis=1, bitorder="little").view(np.uint64)
    return out


GROUP = ("c", "a", "b", "i", "j")


def whole_groups(batches):
    """Tables of whole groups of one c, of about BLOCK_BYTES / 4 or a group each, from batches in which a group's rows stand together."""
    held: list[pa.Table] = []

    def cuts(t: pa.Table, keys) -> np.ndarray:
        ids = [t.column(k).to_numpy() for k in keys]
        return np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1

    def by_class(t: pa.Table):
        at = [0, *cuts(t, ("c",)).tolist(), t.num_rows]
        yield from (t.slice(i, j - i) for i, j in zip(at[:-1], at[1:], strict=True))

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.nbytes
        if size < BLOCK_BYTES // 4:
            continue
        t = pa.concat_tables(held)
        at = cuts(t, GROUP)
        if len(at):
            yield from by_class(t.slice(0, at[-1]))
            held = [t.slice(at[-1])]
            size = held[0].nbytes
    if held:
        yield from by_class(pa.concat_tables(held))


def together(share: int, whole: bool):
    """Rows (x, y): classes of a group that belong together, each at most once as x. whole: data are sets, and pairs are verified; else bitmaps.

    Rows of a group with side 0 are compared with one another, rows of side 1 with those of side 2. Rows of one comp belong together already.
    """

    def run(batches):
        for t in whole_groups(batches):
            c = t.column("c")[0].as_py()
            ids = [t.column(k).to_numpy() for k in GROUP[1:]]
            new = np.ones(t.num_rows, bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in ids], axis=0)
            group = np.cumsum(new) - 1
            side, n = t.column("side").to_numpy(), t.column("n").to_numpy()
            order = np.lexsort((n, np.where(side > 0, t.column("comp").to_numpy(), 0), side, group))
            group, side, n = group[order], side[order], n[order]
            g, comp, guest = (t.column(k).to_numpy()[order] for k in ("g", "comp", "guest"))
            labels = Labels(same_as(group, comp))
            began = labels.of.copy()
            data = t.column("data").combine_chunks()
            if whole:
                offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data)]
                values = np.frombuffer(data.buffers()[2], np.uint8)
                values = values[offsets[0] :][: (len(values) - offsets[0]) // 8 * 8].view("<u8")
                sets = Sets(values, ((offsets - offsets[0]) // 8).astype(np.int64)[order], n)
                bits = bitmaps(sets.values, sets.at, n, c)
            else:
                sets, m = None, width(c)
                raw = data.to_pylist()
                bits = np.stack([folded(raw[i], m) for i in order.tolist()]).view(np.uint64)
            level = (bits, n, n, n - np.bitwise_count(bits).sum(1, dtype=np.int64), labels.of, labels.of)
            start = np.flatnonzero(np.diff(group, prepend=-1))
            ends = np.append(start[1:], len(group))
            for i, j in zip(start.tolist(), ends.tolist(), strict=True):
                if j - i >= PIVOTS_FROM and side[i] == 0:
                    by_pivots(labels, level, np.arange(i, j), sets, share)
            label = labels.find(np.arange(len(group)))
            alike = np.flatnonzero(side == 0)
            if len(alike):
                trees = Trees(bits[alike], n[alike], label[alike], np.append(np.flatnonzero(np.diff(group[alike], prepend=-1)), len(alike)))
                for p, q in dual(trees, trees, True, share):
                    p, q = alike[p], alike[q]
                    ok = ~(guest[p] & guest[q])
                    link(labels, p[ok], q[ok], sets, share)
            for i, j in zip(start.tolist(), ends.tolist(), strict=True):
                x, y = i + np.flatnonzero(side[i:j] == 1), i + np.flatnonzero(side[i:j] == 2)
                if len(x) and len(y):
                    one, two = (Trees(bits[r], n[r], label[r], np.array([0, len(r)])) for r in (x, y))
                    for p, q in dual(one, two, False, share):
                        p, q = x[p], y[q]
                        ok = ~(guest[p] & guest[q])
                        link(labels, p[ok], q[ok], sets, share)
            now = labels.find(np.arange(len(group)))
            moved = np.flatnonzero((began == np.arange(len(group))) & (now != began))
            yield pa.RecordBatch.from_arrays([pa.array(g[moved]), pa.array(g[now[moved]])], names=["x", "y"])

    return run


def with_sets(k: int):
    """Rows whose text has the set g, with the set instead of the text."""

    def run(batches):
        for batch in batches:
            sets = list(text_sets(batch.column("text"), k))
            own = [i for i, (s, g) in enumerate(zip(sets, batch.column("g").to_pylist(), strict=True)) if len(s) and fingerprint(s) == g]
            t = batch.drop_columns(["text"]).take(pa.array(own, pa.int64()))
            yield t.append_column("data", pa.array([sets[i].astype("<u8").tobytes() for i in own], pa.binary()))

    return run


def lists_of(classes: DataFrame, share: int) -> DataFrame:
    """classes (g, n, keys). A row for each class in each list of classes with a common key: (c, a, b, g, n, guest), a the key, b 0.

    Keys of one class alone go; of keys with the same classes one stays. Within a key, classes are told by size: bitmaps of a class c have one
    width, and sets that may link to smaller ones of the class below also go there, as guests, who aren't compared with one another.
    """
    keys = classes.select("g", "n", F.explode("keys").alias("a"))
    sums = keys.groupBy("a").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("g")).alias("x"), F.bit_xor(F.xxhash64("g", F.lit(1))).alias("y")).where("rows > 1")
    one = sums.groupBy("rows", "x", "y").agg(F.min("a").alias("a")).select("a")
    c = class_of(F.col("n"))
    low = F.ceil(F.col("n") * share / 100.0 - 1e-9) <= F.pow(F.lit(2), F.col("c") - 1)
    own, below = F.struct(F.col("c").alias("c"), F.lit(False).alias("guest")), F.struct((F.col("c") - 1).alias("c"), F.lit(True).alias("guest"))
    kept = keys.join(one, "a").withColumn("c", c).withColumn("to", F.explode(F.when((F.col("c") > 3) & low, F.array(own, below)).otherwise(F.array(own))))
    return kept.select("to.c", "a", F.lit(0).cast("long").alias("b"), "g", "n", "to.guest")


def class_of(n):
    return F.greatest(F.lit(3), F.ceil(F.log2(n) - 1e-12)).cast("int")


def belonging(rows: DataFrame, row_bytes, fetch, share: int, whole: bool, keep) -> DataFrame:
    """Links (x, y) that connect what belongs together within the groups of rows (c, a, b, g, n, guest); fetch adds data to rows.

    A group of more rows than a block holds is joined in two rounds. In the first, each block is joined within itself and with some rows of the
    others, the same for all blocks. In the second, rows that still don't belong to the group's largest part, and only they, are
    compared with all its rows, block by block. Either round moves rows once for each block of the other side.
    """
    group = ["c", "a", "b"]
    most = F.least(F.lit(BLOCK), F.lit(BLOCK_BYTES) / row_bytes)
    sizes = keep(rows.groupBy(*group).agg(F.count("*").alias("rows")).where("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / most).cast("int")), "sizes")
    sized = keep(rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("g", F.lit(2)), F.col("blocks")).cast("int")), "groups")

    def joined(x: DataFrame, name: str) -> DataFrame:
        x = x.select(*GROUP, "side", "g", "n", "comp", "guest")
        return keep(fetch(x).repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(together(share, whole), "x long, y long"), name)

    everywhere = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("g", F.lit(3)), F.col("rows")) < PIVOTS)
    first = sized.withColumn("i", F.explode(F.when(everywhere, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    links = joined(first.withColumns({"j": F.col("i"), "side": F.lit(0), "comp": F.col("g")}), "links")
    large = sized.where("blocks > 1")
    if large.isEmpty():
        return links
    comp = keep(components(links.toDF("a", "b")), "components")
    large = large.join(comp.withColumnRenamed("component", "comp"), large.g == comp.id, "left").drop("id").withColumn("comp", F.coalesce("comp", "g"))
    main = large.groupBy(*group, "comp").agg(F.count("*").alias("m")).groupBy(*group).agg(F.max_by("comp", F.struct("m", "comp")).alias("main"))
    large = large.join(main, group).withColumn("apart", F.col("comp") != F.col("main"))
    parts = large.where("apart").groupBy(*group).agg(F.ceil(F.count("*") / F.first(most)).cast("int").alias("parts"))
    large = keep(large.join(parts, group), "large-groups")
    x = large.where("apart").withColumns({"i": F.pmod(F.xxhash64("g", F.lit(4)), F.col("parts")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "side": F.lit(1)})
    y = large.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "j": F.col("block"), "side": F.lit(2)})
    both = [r.select(*GROUP, "side", "g", "n", "comp", "guest") for r in (x, y)]
    return links.union(joined(both[0].union(both[1]), "more-links"))


def jaccard_classes(docs: DataFrame, k: int = 4, share: int = 85) -> DataFrame:
    """docs (doc_id long, text). Returns doc_id, n_shingles, class_id (of equal sets) and component_id for every row.

    A set has the distinct k-word shingles of a whole text (words by ASCII white space, A-Z lower-cased); with fewer words, the whole
    sequence as one; a null or empty text has none, links with nothing, and its component is its own id. Classes link when
    100 * intersection >= share * union; component_id is the smallest doc_id that links reach (null ids don't count; null where all are).

    Equal sets are one class. Classes meet in lists by the first of their shingles in a common order, rare ones first, so many that each pair
    that links meets. Trees over each list say which classes may link; what those pairs connect is a family. Trees over each family find
    the pairs again and verify them on the full sets. Links within a group that is connected already are not looked for, so links
    aren't counted. Shingles are 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    way: list[DataFrame] = []

    def keep(df, name):
        way.append(written(df, name))
        return way[-1]

    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}["doc_id"]
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    common = spark.sparkContext.broadcast(common_shingles(docs, k))
    rows = keep(texts.mapInArrow(sets_of(k, share, common), f"doc_id {kind}, h long, n long, g long, keys array<long>, bits binary"), "sets")
    full = rows.where("g IS NOT NULL")
    ids = keep(full.groupBy("g", "n").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "h")).alias("at"), F.any_value("keys").alias("keys")), "classes")
    lists = keep(lists_of(ids, share), "lists")
    bits = keep(full.select("g", "bits").join(lists.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.any_value("bits").alias("data")), "bits")
    families = keep(components(belonging(lists, F.pow(F.lit(2), F.col("c") - 1), lambda x: x.join(bits, "g"), share, False, keep).toDF("a", "b")), "families")

    members = families.join(ids.select("g", "n"), families.id == F.col("g")).select(F.col("component").alias("a"), "g", "n")
    classes = members.groupBy("a").agg(class_of(F.max("n")).alias("c"))
    members = members.join(classes, "a").select("c", "a", F.lit(0).cast("long").alias("b"), "g", "n", F.lit(False).alias("guest"))

    def with_texts(x: DataFrame) -> DataFrame:
        x = keep(x.join(ids.select("g", F.col("at.doc_id").alias("rep"), F.col("at.h").alias("hash")), "g"), "needed")
        few = F.broadcast(x) if x.count() <= FETCH else x
        found = texts.join(few, (F.col("h") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("rep"))).drop("doc_id", "h", "rep", "hash")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields if f.name != "text")
        return found.mapInArrow(with_sets(k), f"{kinds}, data binary")

    comp = components(belonging(members, F.pow(F.lit(2), "c") * 9, with_texts, share, True, keep).toDF("a", "b"))
    out = ids.select("g", "rep").join(comp, F.col("g") == comp.id, "left").drop("id").withColumn("component", F.coalesce("component", "g"))
    least = out.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = keep(out.join(least, "component").select(F.col("g").alias("class_id"), "component_id"), "named")
    for t in way:
        if t is not named and t is not rows:
            dropped(t)
    done = full.select("doc_id", F.col("n").alias("n_shingles"), F.col("g").alias("class_id")).join(named, "class_id").select("doc_id", "n_shingles", "class_id", "component_id")
    empty = rows.where("g IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class_id"), F.col("doc_id").alias("component_id"))
    return done.union(empty)


def one_of_each(docs: DataFrame, found: DataFrame, k: int = 4) -> DataFrame:
    """The rows of docs whose id is that of their component; found is jaccard_classes(docs, k).

    Of rows without an id, one of each set of equal shingles stays unless its component has an id. Of rows with an id that others have too, those
    of a class of the component stay, one of each. Rows without words all stay.
    """
    spark, names = docs.sparkSession, docs.columns
    small_batches(spark)
    id_, class_ = free(names, "id", "class")
    found = written(found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays")), "found")
    ids = found.groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias("rows"), F.bool_and("stays").alias("stays"))
    several = F.col(id_).isNull() | (F.col("rows") > 1)
    ids = written(ids.where(several | ~F.col("stays")).select(id_, several.alias("several")), "told-ids")
    gone = ids.select(id_)
    gone = F.broadcast(gone) if ids.count() <= FETCH else gone
    out = docs.where(docs.doc_id.isNotNull()).join(gone, docs.doc_id == F.col(id_), "left_anti")
    more = ids.where("several").select(id_)
    if more.isEmpty():
        return out

    def with_class(batches):
        for batch in batches:
            yield batch.append_column(class_, pa.array([fingerprint(s) if len(s) else None for s in text_sets(batch.column("text"), k)], pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rest = docs.join(more, docs.doc_id.eqNullSafe(F.col(id_)), "left_semi").mapInArrow(with_class, f"{kinds}, `{class_}` long")
    of = free([*names, class_], "of")[0]
    kept = found.where("stays AND class_id IS NOT NULL").select(F.col("doc_id").alias(id_), F.col("class_id").alias(of)).distinct()
    full = rest.join(kept, rest.doc_id.eqNullSafe(F.col(id_)) & (F.col(class_) == F.col(of)), "left_semi").dropDuplicates(["doc_id", class_])
    return out.union(full.select(names)).union(rest.where(F.col(class_).isNull()).select(names))


def op5_jaccard(spark, sf_dir):
    """Four words and 0.85 over all documents. Null, empty and repeated rows as in jaccard_classes."""
    from .shared import table

    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: For DuckDB; it compares all documents with a common shingle.
OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + least(len(w), 4) - 1], ' ')) AS h FROM d, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS r(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
c(id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT c.id, e.b FROM c JOIN e ON c.reach = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id GROUP BY d.doc_id
"""
