"""What each of several filters removes, in every order in which they can be applied."""

from functools import reduce
from itertools import permutations
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distinct import numbered, words_of
from .shared import small_batches, written
from .words import ByteTable, byte_table, chunks, text_bytes

#: Filters beyond which the orders are too many to list.
MOST_FILTERS = 7
#: Words are runs of anything but ASCII white space, told by case.
CASED = ByteTable(np.arange(256, dtype=np.uint8), byte_table(lambda c: c != 32 and not 9 <= c <= 13).inside)
SIGNS = np.zeros(256, bool)
SIGNS[list(b"#$%&*|")] = True


def text_failures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Which whole texts fail the filters on words, capitals and signs; null is empty."""
    _, numbers, at = numbered(texts, words_of(CASED))
    n, distinct = np.diff(at), np.array([len(np.unique(r)) for r in np.split(numbers, at[1:-1])])
    data, offsets = text_bytes(texts)
    capitals, points, signs = (np.zeros(len(texts), np.int64) for _ in range(3))
    for i, j in chunks(offsets):
        for out, what in ((capitals, lambda x: (x >= 65) & (x <= 90)), (points, lambda x: (x & 0xC0) != 0x80), (signs, lambda x: SIGNS[x])):
            sums = np.concatenate([[0], np.cumsum(what(data[offsets[i] : offsets[j]]), dtype=np.int64)])
            out[i:j] = np.diff(sums[offsets[i : j + 1] - offsets[i]])
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * points, "D": signs > 0}


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang), labels (doc_id, quality, toxic). A written table with a row for each document: part, whether it fails each of A to E, good, toxic.

    Texts are read once; E is told from their SHA-256. A null lang is an empty one. A document is good or toxic if any label of its id says 1. Rows without
    an id have no labels, are no copies of a smaller id and make none; a text's rows with its smallest id all stay.
    """
    small_batches(docs.sparkSession)

    def decide(batches):
        for batch in batches:
            failed = text_failures(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("key"), *(pa.array(x) for x in failed.values())], names=["doc_id", "part", "key", *failed])

    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), text.alias("text"))
    told = written(slim.mapInArrow(decide, "doc_id long, part string, key binary, A boolean, B boolean, C boolean, D boolean"), "failures")
    first = told.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("x"))
    out = told.join(first, "key", "left").join(marks, "doc_id", "left")
    mark = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return written(out.select("part", "A", "B", "C", "D", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("E"), mark("q").alias("good"), mark("x").alias("toxic")), "failing")


def walked(rows: DataFrame, filters: list[str], part: str, marks: list[str]) -> DataFrame:
    """Depth-first through the trie of all orders. Returns (part, state, filter, kept, removed, lost_<mark>...): what each filter removes of what a state keeps.

    rows: a written table with a boolean column for each filter (true: a row fails) and each mark, none null. A state is a set of filters that have been applied, in whatever
    order; its survivors are those of the state before, from which it was first reached, less what the filter removes, persisted while states beyond it are visited.
    Other orders that reach it share its counts. So 2^k - 1 survivor tables are made for k! orders, at most k of them at a time; a lost one is
    made again from rows. Each state's edges are counted in one aggregation and written.
    """
    edges: dict[str, DataFrame] = {}
    many = lambda c: F.sum(c.cast("long"))

    def visit(state: str, survivors: DataFrame) -> None:
        left = [f for f in filters if f not in state]
        if state in edges or not left:
            return
        survivors = survivors.persist()
        fails = {f: F.col(f) for f in left}
        counts = survivors.groupBy(part).agg(
            F.count("*").alias("alive"), *[many(x).alias(f"{f}_removed") for f, x in fails.items()], *[many(x & F.col(m)).alias(f"{f}_lost_{m}") for f, x in fails.items() for m in marks]
        )
        step = lambda f: F.struct(F.lit(f).alias("filter"), (F.col("alive") - F.col(f"{f}_removed")).alias("kept"), F.col(f"{f}_removed").alias("removed"), *[F.col(f"{f}_lost_{m}").alias(f"lost_{m}") for m in marks])
        edges[state] = written(counts.select(part, F.lit(state).alias("state"), F.explode(F.array(*[step(f) for f in left])).alias("e")).select(part, "state", "e.*"), "edges")
        for f in left:
            visit("".join(x for x in filters if x in state or x == f), survivors.where(~F.col(f)))
        survivors.unpersist()

    visit("", rows)
    out = None
    for e in edges.values():
        out = e if out is None else out.union(e)
    return out


def audited(rows: DataFrame, filters: list[str], part: str, marks: list[str]) -> DataFrame:
    """One row for each part, order of all filters and step: (part, filter_order, step, kept, removed, redundant, unique_fails, lost_<mark>..., shapley).

    rows: see walked(); filters: names of one letter. Every part has all its rows, zeros included; no rows: no parts. A part without survivors keeps and removes 0.
    redundant: rows that fail the step's filter but were removed before; unique_fails: rows that fail it alone; shapley: what it removes, summed over all orders.
    """
    if len(filters) > MOST_FILTERS or any(len(f) != 1 for f in filters):
        raise ValueError(f"at most {MOST_FILTERS} filters, each of one letter")
    steps = [("".join(p), i + 1, f, "".join(x for x in filters if x in p[:i])) for p in permutations(filters) for i, f in enumerate(p)]
    orders = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, state string")
    alone = lambda f: ~reduce(or_, [F.col(x) for x in filters if x != f], F.lit(False))
    sums = [F.sum(F.col(f).cast("long")).alias(f"{f}_all") for f in filters] + [F.sum((F.col(f) & alone(f)).cast("long")).alias(f"{f}_only") for f in filters]
    whole = rows.groupBy(part).agg(*sums)
    whole = written(whole.select(part, F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f"{f}_all").alias("all"), F.col(f"{f}_only").alias("only")) for f in filters])).alias("x")).select(part, "x.*"), "whole")
    edges = written(walked(rows, filters, part, marks), "edges")
    counts = ["kept", "removed", *(f"lost_{m}" for m in marks)]
    # a state that a part doesn't reach, as nothing of it is left, has no edge: its counts are 0. orders: k! times k rows, whatever the data
    every = whole.join(F.broadcast(orders), "filter").join(edges, [part, "state", "filter"], "left").fillna(0, counts)
    every = every.withColumn("shapley", F.sum("removed").over(Window.partitionBy(part, "filter")))  # k! rows each
    return every.select(part, "filter_order", "step", *counts[:2], (F.col("all") - F.col("removed")).alias("redundant"), F.col("only").alias("unique_fails"), *counts[2:], "shapley")


def op13_audit(spark, sf_dir):
    """Five filters on all documents, by language."""
    from .shared import table

    rows = failures(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    out = audited(rows, list("ABCDE"), "part", ["good", "toxic"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", F.col("lost_good").alias("good_lost"), F.col("lost_toxic").alias("toxic_lost"), "shapley")


OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(q, 0) AS q, coalesce(x, 0) AS x, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
             regexp_matches(t, '[#$%&*|]'), coalesce(min(w.doc_id) OVER (PARTITION BY t) < w.doc_id, false)] AS fails FROM w LEFT JOIN m ON w.doc_id = m.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(q) AS q, sum(x) AS x FROM f GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, k AS step, o[k] AS own, o[1:k - 1] AS earlier FROM o, unnest([1, 2, 3, 4, 5]) u(k)),
r AS (SELECT part, o, step, own,
        sum(CASE WHEN fails[own] OR len(list_filter(earlier, lambda i: fails[i])) > 0 THEN 0 ELSE n END) AS kept,
        sum(CASE WHEN fails[own] AND len(list_filter(earlier, lambda i: fails[i])) = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN fails[own] AND len(list_filter(earlier, lambda i: fails[i])) > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails[own] AND len(list_filter(fails, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN fails[own] AND len(list_filter(earlier, lambda i: fails[i])) = 0 THEN q ELSE 0 END) AS good_lost,
        sum(CASE WHEN fails[own] AND len(list_filter(earlier, lambda i: fails[i])) = 0 THEN x ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, o, step, own)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
