"""Benchmark decontamination by a prefix-filtered set join on item-sized windows."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written
from .words import ALNUM, Words, sequence_hash, words

#: Words of a window, and of the shingles by whose rarity windows are looked up.
WINDOW, SHINGLE = 10, 3
#: Bytes of benchmark text that one pass over the documents may carry to all executors: an index takes about 6 times as much (51 MB for 8.1 MB, as
#: measured), its making on the driver about 60 times (482 MB and 2.4 s). A larger benchmark takes more passes; an item alone is never cut.
PASS_BYTES = 4 << 20


@dataclass
class Index:
    """Windows of all items by their rarest shingle. Of window k: size words from word first[k] of the items' words on, its key at offset at[k], and its item.
    data, starts and ends: the items' bytes, and where their words are."""

    keys: np.ndarray
    at: np.ndarray
    size: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    names: list[str]
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def text(self, k: int) -> bytes:
        a, n = int(self.first[k]), int(self.size[k])
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[a : a + n], self.ends[a : a + n], strict=True))


def window_bytes(w: Words, first: int, size: int) -> bytes:
    return b" ".join(w.data[s:e].tobytes() for s, e in zip(w.starts[first : first + size], w.ends[first : first + size], strict=True))


def build_index(names: list[str], texts: list[str | None], window: int = WINDOW) -> Index:
    """Windows of all items: runs of `window` words, or an item's whole text if it has fewer, but some.

    Shingles (SHINGLE words, or all of a shorter window) are ordered by how many items hold them, then by hash: containment of a whole
    window asks for all of its shingles, so the prefix to look up is one, its rarest.
    """
    parts = list(words(pa.array(texts, pa.string()), ALNUM))
    bytes_before = np.cumsum([0, *[len(w.data) for w in parts]])
    joined = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
    hashes, data = joined([w.hashes for w in parts], np.uint64), joined([w.data for w in parts], np.uint8)
    starts = joined([w.starts + b for w, b in zip(parts, bytes_before, strict=False)], np.int64)
    ends = joined([w.ends + b for w, b in zip(parts, bytes_before, strict=False)], np.int64)
    n_words = joined([np.diff(w.at) for w in parts], np.int64).astype(np.int64)
    begin = np.cumsum(n_words) - n_words
    found = []
    # how rare a shingle is, by sizes of shingles: full ones, and those of items with fewer words
    for k in range(1, SHINGLE + 1):
        sizes = [k] if k < SHINGLE else range(SHINGLE, window + 1)
        mine = np.flatnonzero(np.isin(np.minimum(n_words, window), list(sizes)))
        if not len(mine):
            continue
        runs = sequence_hash(hashes, k)
        count = n_words[mine] - k + 1
        item = np.repeat(mine, count)
        place = np.repeat(begin[mine] - (np.cumsum(count) - count), count) + np.arange(len(item))
        names_, code = np.unique(runs[place], return_inverse=True)
        pairs = np.unique(np.stack([code, item]), axis=1)
        held = np.bincount(pairs[0], minlength=len(names_))
        rank = np.empty(len(names_), np.int64)
        rank[np.lexsort((names_, held))] = np.arange(len(names_))
        rank = rank[code]  # of the shingle at each place of these items
        first_of = np.cumsum(count) - count
        for size in sizes:
            own = np.flatnonzero(np.minimum(n_words[mine], window) == size)
            n = n_words[mine[own]] - size + 1
            of = np.repeat(own, n)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            at = first_of[of] + nth
            best, where = rank[at], np.zeros(len(at), np.int64)
            for j in range(1, size - k + 1):
                other = rank[at + j]
                where[other < best] = j
                best = np.minimum(best, other)
            start = begin[mine[of]] + nth
            found.append((runs[start + where], where, np.full(len(at), size), sequence_hash(hashes, size)[start], start, mine[of]))
    keys, at, size, full, first, item = (joined([f[i] for f in found], kind) for i, kind in enumerate((np.uint64, np.int64, np.int64, np.uint64, np.int64, np.int64)))
    order = np.lexsort((full, keys))
    return Index(keys[order], at[order].astype(np.int16), size[order].astype(np.int16), full[order], first[order].astype(np.int32), item[order].astype(np.int32), names, data, starts.astype(np.int32), ends.astype(np.int32))


def matches(w: Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of windows in texts: the first word of each, and the window. Bounds of position and length go first, then the exact words."""
    starts, which = [], []
    for k in np.unique(np.minimum(index.size, SHINGLE)).tolist():
        mine = np.flatnonzero(np.minimum(index.size, SHINGLE) == k)
        keys = index.keys[mine]
        own = sequence_hash(w.hashes, int(k))
        lo = np.searchsorted(keys, own, "left")
        hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == own) if len(own) else np.zeros(0, np.int64)
        n = np.searchsorted(keys, own[hit], "right") - lo[hit]
        place = np.repeat(hit, n)
        win = mine[np.repeat(lo[hit], n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)] if len(place) else np.zeros(0, np.int64)
        first = place - index.at[win]
        # the window lies within one text
        text = np.searchsorted(w.at, place, "right") - 1
        ok = (first >= w.at[text]) & (first + index.size[win] <= w.at[text + 1])
        first, win = first[ok], win[ok]
        for size in np.unique(index.size[win]):
            part = np.flatnonzero(index.size[win] == size)
            full = sequence_hash(w.hashes, int(size))[first[part]]
            part = part[full == index.hashes[win[part]]]
            same = [j for j in part if window_bytes(w, int(first[j]), int(size)) == index.text(int(win[j]))]
            starts.append(first[same])
            which.append(win[same])
    return (np.concatenate(starts), np.concatenate(which)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def scan(texts: pa.Array, index: Index) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Of each text: words, words in any occurrence of a window, and the names of items with one, sorted."""
    n_words, n_hit, items = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [[] for _ in range(len(texts))]
    for w in words(texts, ALNUM):
        n_words[w.first : w.first + w.n] = np.diff(w.at)
        first, win = matches(w, index)
        if not len(first):
            continue
        edge = np.zeros(len(w.hashes) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + index.size[win], -1)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        n_hit[w.first : w.first + w.n] = hit[w.at[1:]] - hit[w.at[:-1]]
        text = np.searchsorted(w.at, first, "right") - 1
        for d in np.unique(text):
            items[w.first + int(d)] = sorted({index.names[i] for i in np.unique(index.item[win[text == d]])})
    return n_words, n_hit, items


def item_batches(benchmark: DataFrame, pass_bytes: int) -> list[DataFrame]:
    """The items in so many parts that each is about pass_bytes at most."""
    total = benchmark.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // pass_bytes) or 1
    return [benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def read_items(items: DataFrame, window: int) -> Index:
    got = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").toArrow()
    return build_index(got.column("i").to_pylist(), got.column("text").to_pylist(), window)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs (text, and the columns `keep`), benchmark (item_id, text). Adds n_words, n_hit and items (array of item ids as strings, sorted).

    Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. Null and empty texts have no words and no
    windows; equal items are each named; a null item_id is named as the empty string. The items go to all executors in parts of a
    bounded size, a pass over the documents for each part; with more than one part a row's hits are joined as sets of word positions.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    head = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    parts = item_batches(benchmark, pass_bytes)
    narrow = docs.select(*dict.fromkeys([*keep, "text"]))
    if len(parts) == 1:
        sent = spark.sparkContext.broadcast(read_items(parts[0], window))

        def find(batches):
            for batch in batches:
                n, hit, items = scan(batch.column("text"), sent.value)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n), pa.array(hit), pa.array(items, pa.list_(pa.string()))], names=[*keep, "n_words", "n_hit", "items"])

        return narrow.mapInArrow(find, head + "n_words long, n_hit long, items array<string>")
    numbered = written(narrow.withColumn("_row", F.monotonically_increasing_id()), "numbered")  # a row has one number in all passes
    found = None
    for part in parts:
        sent = spark.sparkContext.broadcast(read_items(part, window))

        def spans(batches, sent=sent):
            for batch in batches:
                index = sent.value
                for w in words(batch.column("text"), ALNUM):
                    first, win = matches(w, index)
                    text = np.searchsorted(w.at, first, "right") - 1
                    rows = [(w.first + int(d), int(f - w.at[d]), int(index.size[k]), [index.names[index.item[k]]]) for d, f, k in zip(text, first, win, strict=True)]
                    ids = batch.column("_row").to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.string()))], names=["_row", "first", "size", "names"])

        one = numbered.select("_row", "text").mapInArrow(spans, "_row long, first long, size long, names array<string>")
        found = one if found is None else found.union(one)
    at = found.select("_row", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("p")).distinct().groupBy("_row").agg(F.count("*").alias("n_hit"))
    items = found.select("_row", F.explode("names").alias("i")).distinct().groupBy("_row").agg(F.sort_array(F.collect_set("i")).alias("items"))

    def count(batches):
        for batch in batches:
            n = np.concatenate([np.zeros(0, np.int64)] + [np.diff(w.at) for w in words(batch.column("text"), ALNUM)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("_row"), pa.array(n)], names=[*keep, "_row", "n_words"])

    counted = numbered.mapInArrow(count, head + "_row long, n_words long")
    out = counted.join(at, "_row", "left").join(items, "_row", "left")
    return out.select(*keep, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows without any occurrence of a window, all columns as they are."""
    spark = docs.sparkSession
    small_batches(spark)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for part in item_batches(benchmark, pass_bytes):
        sent = spark.sparkContext.broadcast(read_items(part, window))

        def untouched(batches, sent=sent):
            for batch in batches:
                yield batch.filter(pa.array(scan(batch.column("text"), sent.value)[1] == 0))

        docs = docs.mapInArrow(untouched, kinds)
    return docs


def op6_decontamination(spark, sf_dir):
    """All documents against all items."""
    from .shared import table

    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP6_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
        FROM iw, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, s.n, i, array_to_string(w[i : i + s.n - 1], ' ') AS t FROM dw, sizes s, unnest(range(1, len(w) - s.n + 2)) AS r(i)),
m AS (SELECT dp.doc_id, dp.i, dp.n, win.item_id FROM dp JOIN win ON dp.n = win.n AND dp.t = win.t),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m), unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
