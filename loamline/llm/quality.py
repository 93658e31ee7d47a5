"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts, flattened into arrays."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fraction, free, small_batches
from .words import SPACED, chunks, text_bytes, words

#: Most labelled rows that a classifier is fitted on, chosen by a hash of their id.
TRAIN_ROWS = 20_000
BINS, TREES, DEPTH, RATE, RIDGE, LEAST = 64, 80, 4, 0.15, 1.0, 3.0


def _class_table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for c in range(256):
        t[c] = 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c == 10 else 5 if c in (9, 11, 12, 13, 32) else 6 if chr(c) in ".,;:'\"()?-" and c < 128 else 8 if c >= 128 else 7
    return t


CLASSES, N_CLASSES = _class_table(), 9
N_FEATURES = 26


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of N_FEATURES numbers for each text; null and empty texts give zeros."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    data, offsets = text_bytes(texts)
    lengths = np.diff(offsets)
    for (i, j), w in zip(chunks(offsets), words(texts, SPACED), strict=True):
        raw, size = data[offsets[i] : offsets[j]], lengths[i:j]
        kind = CLASSES[raw]
        of = np.repeat(np.arange(j - i, dtype=np.int64), size)
        counts = np.bincount(of * N_CLASSES + kind, minlength=(j - i) * N_CLASSES).reshape(-1, N_CLASSES)
        bytes_ = np.maximum(size, 1)
        out[i:j, 0] = np.log1p(size)
        out[i:j, 1 : 1 + N_CLASSES - 1] = counts[:, 1:] / bytes_[:, None]
        letters = np.maximum(counts[:, 1] + counts[:, 2] + counts[:, 8], 1)
        out[i:j, 9] = counts[:, 2] / letters
        n = np.diff(w.at)
        out[i:j, 10] = np.log1p(n)
        long = (w.ends - w.starts).astype(np.float64)
        first = CLASSES[raw[w.starts]] if len(w.starts) else np.zeros(0, np.uint8)
        last = CLASSES[raw[w.ends - 1]] if len(w.ends) else np.zeros(0, np.uint8)
        lines = np.flatnonzero(raw == 10)
        for d in range(j - i):
            a, b = w.at[d], w.at[d + 1]
            if a == b:
                continue
            m, h, x, k = b - a, w.hashes[a:b], long[a:b], i + d
            distinct, times = np.unique(h, return_counts=True)
            pairs = np.unique(h[:-1] * np.uint64(31) + h[1:]) if m > 1 else h
            out[k, 11:23] = (
                x.mean(), x.std(), x.max(), (x <= 2).mean(), (x > 15).mean(), len(distinct) / m, times.max() / m,
                len(pairs) / max(m - 1, 1), (first[a:b] == 2).mean(), (first[a:b] >= 6).mean(), (last[a:b] == 7).mean(), (last[a:b] == 6).mean(),
            )
            lo, hi = offsets[i + d] - offsets[i], offsets[i + d + 1] - offsets[i]
            cut = lines[np.searchsorted(lines, lo) : np.searchsorted(lines, hi)]
            at = np.searchsorted(w.starts[a:b], cut)  # words before each line end
            sums = np.zeros(m + 1, np.uint64)
            np.cumsum(h * (np.arange(m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) if len(cut) == 0 else h, out=sums[1:])
            edges = np.concatenate([[0], at, [m]])
            line = (sums[edges[1:]] - sums[edges[:-1]])[np.diff(edges) > 0]
            out[k, 23] = 1 - len(np.unique(line)) / max(len(line), 1)
            out[k, 24] = m / max(len(line), 1)
            out[k, 25] = np.log1p(len(line))
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth: inner nodes by level, x > threshold goes right; leaves hold what is added to the log-odds."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += leaf[at - inner] if len(at) else 0
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted log-loss with histograms over quantile bins. Without rows, or with one label only, the trees are constant."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, leaf = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves))
    if not len(y) or y.min() == y.max():
        return Trees(feature[:0], threshold[:0], leaf[:0], base)
    n, p = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)).astype(np.float32) for f in range(p)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(p)], 1)
    flat = binned + np.arange(p) * BINS
    total = np.full(n, base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-total))
        g, h = y - prob, prob * (1 - prob)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            key = ((at - first)[:, None] * (p * BINS) + flat).ravel()
            sums = [np.bincount(key, np.repeat(v, p), nodes * p * BINS).reshape(nodes, p, BINS) for v in (g, h)]
            gl, hl = np.cumsum(sums[0], 2)[:, :, :-1], np.cumsum(sums[1], 2)[:, :, :-1]
            gt, ht = sums[0].sum(2)[:, :, None], sums[1].sum(2)[:, :, None]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hl < LEAST) | (ht - hl < LEAST)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), BINS - 1)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t][at]] > threshold[t][at])
        at -= inner
        leaf[t] = RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + RIDGE)
        total += leaf[t][at]
    return Trees(feature, threshold, leaf, base)


def with_statistics(batches):
    for batch in batches:
        x = statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, learnable: Column, train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees from docs (doc_id, text) and labels (doc_id, quality 0 or 1; the mean where an id has several), of ids that are learnable.

    At most about train_rows labelled ids are used, by a hash of the id; of rows with one id, one. Null ids and labels teach nothing.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("y")).where(learnable)
    n = known.count()
    some = known.where(fraction("doc_id", seed=10) < train_rows / max(n, 1))
    rows = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi").mapInArrow(with_statistics, "doc_id long, x array<float>")
    rows = rows.groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(some), "doc_id").select("doc_id", "x", "y").toArrow().sort_by("doc_id")
    x = np.array(rows.column("x").to_pylist(), np.float32).reshape(rows.num_rows, N_FEATURES)
    return fit_trees(x, (rows.column("y").to_numpy() >= 0.5).astype(np.float64))


def scored(docs: DataFrame, trees: Trees, text: str = "text", least: float | None = None) -> DataFrame:
    """Adds score to every row, a column that is named so already stays with underscores before its name; with `least`, keeps the rows that score so much and
    leaves the columns as they are.

    Nulls and empty texts have the score of their statistics, all zero.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    mine = [c for c in docs.columns if c.lower() == "score"] if least is None else []
    docs = docs.withColumnRenamed(mine[0], free(docs.columns, "score")[0]) if mine else docs

    def score(batches):
        for batch in batches:
            s = sent.value.score(statistics(batch.column(text)))
            yield batch.append_column("score", pa.array(s)) if least is None else batch.filter(pa.array(s >= least))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, kinds if least is not None else f"{kinds}, score double")


def held_out() -> Column:
    """Whether a row's id is held out: its CRC as text, mod 3, is 1."""
    return F.expr("crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)) % 3 = 1")


def op10_quality(spark, sf_dir):
    """All documents; labels of held-out ids are not learned."""
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out())
    out = scored(docs, trees)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
