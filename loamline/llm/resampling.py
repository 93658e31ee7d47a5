"""Importance resampling towards a target's distribution of hashed n-grams, by a dictionary of distinct features."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distinct import blocks, joined_back, numbered, packed, unpacked, words_of
from .shared import free, written
from .words import ALNUM

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Buckets up to which a gain for each may be sent to every task.
MOST_BUCKETS = 1 << 22


def grams(names: list[str], rows: list[np.ndarray], longest: int) -> tuple[list[str], list[np.ndarray]]:
    """Words as numbers in names, made features: all runs of 1 to `longest` words, joined by one space; the names of all features, and each row's, repeats kept."""
    every, out = list(names), [[r] for r in rows]
    before, last = [*rows], list(names)  # each row's runs of one word less, numbered among themselves
    for n in range(2, longest + 1):
        keys = [b[:-1].astype(np.int64) * max(1, len(names)) + r[n - 1 :] if len(r) >= n else np.zeros(0, np.int64) for b, r in zip(before, rows, strict=True)]
        told, at = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
        last = [f"{last[k // len(names)]} {names[k % len(names)]}" for k in told.tolist()]
        before = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
        for o, b in zip(out, before, strict=True):
            o.append(b + len(every))
        every += last
    return every, [np.concatenate(o) if len(o) > 1 else o[0] for o in out]


def features(docs: DataFrame, keep: list[str], longest: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their words' number and their features, as numbers in a block's list and counts, and the lists: (_block, k, string, n)."""

    def describe(texts):
        listed, numbers, at = numbered(texts, words_of(ALNUM))
        names, rows = listed.to_pylist(), np.split(numbers, at[1:-1])
        every, own = grams(names, rows, longest)
        total, out = np.zeros(len(every), np.int64), []
        for r, x in zip(rows, own, strict=True):
            at, n = np.unique(x, return_counts=True)
            total[at] += n
            out.append({"_words": len(r), "_features": packed(at, len(every)), "_counts": packed(n, int(n.max(initial=0)))})
        return every, total.tolist(), out

    return blocks(docs, keep, describe, "_words long, _features binary, _counts binary")


def bucket_of(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def importance(docs: DataFrame, target: DataFrame, keep: list[str], longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """docs (text, and the columns `keep`), target (text). Returns the columns kept with n_words, n_features and weight.

    A text's features are all runs of 1 to `longest` of its words (ASCII letters, digits and what is beyond ASCII; A-Z lower-cased), repeats counted. Each distinct
    feature of the corpus is counted and hashed to a bucket once; a bucket's gain is floor(1000 ln of its smoothed share of the target's features over that
    of the corpus'), and joined back to the features of each text. weight is the floored mean of a text's gains, 0 without features. Null is an empty
    text. An empty target gives all buckets their share of nothing, smoothed. Repeated rows count each. Kept columns of the added names are an error.
    """
    if buckets > MOST_BUCKETS:
        raise ValueError(f"more than {MOST_BUCKETS} buckets")
    if {"n_words", "n_features", "weight"} & {c.lower() for c in keep}:
        raise ValueError("columns are named as what is added")
    spark, kinds = docs.sparkSession, {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    rows, strings = features(docs, keep, longest)
    _, wanted = features(target.select("text"), [], longest)
    count = lambda s: s.groupBy("string").agg(F.sum("n").alias("n"))
    table = written(count(strings).select("string", "n", bucket_of(F.col("string"), buckets).alias("bucket")), "features")
    held = table.groupBy("bucket").agg(F.sum("n").alias("s"))
    sought = count(wanted).groupBy(bucket_of(F.col("string"), buckets).alias("bucket")).agg(F.sum("n").alias("t"))
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(held, "bucket", "left").join(sought, "bucket", "left").fillna(0, ["s", "t"])
    all_of = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))  # one row
    share = ((F.col("t") + 1.0) * (F.col("all_s") + float(buckets))) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    gains = written(both.crossJoin(F.broadcast(all_of)).select("bucket", F.floor(F.log(share) * 1000.0).cast("long").alias("gain")), "gains")
    told = table.join(F.broadcast(gains), "bucket").select("string", "gain")  # gains: one row for each of at most MOST_BUCKETS buckets

    def finish(rows, values):
        gain, out = values.column("gain").to_numpy(), []
        for f, c in zip(rows.column("_features").to_pylist(), rows.column("_counts").to_pylist(), strict=True):
            n = unpacked(c)
            total = int(n.sum())
            out.append((total, int((gain[unpacked(f)] * n).sum()) // total if total else 0))
        return pa.table([*(rows.column(c) for c in keep), rows.column("_words"), pa.array([n for n, _ in out], pa.int64()), pa.array([w for _, w in out], pa.int64())], names=[*keep, "n_words", "n_features", "weight"])

    values = strings.select("_block", "k", "string").join(told, "string").select("_block", "k", "gain")
    return joined_back(rows, values, finish, "".join(f"`{c}` {kinds[c]}, " for c in keep) + "n_words long, n_features long, weight long")


def noise(identity: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from a hash of a row's identity: largest sums with log weights are a draw without replacement by weight."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity, F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0).cast("long")


def ranked(scored: DataFrame, eligible: Column, score: str, tie: str, percent: int) -> DataFrame:
    """Adds rank (1, 2, 3...) of the floor(percent / 100 of the eligible rows) highest scores, ties by the smaller `tie`, null last; null for all others.

    scored: a written table. Scores are whole numbers of a bounded range (noise spans some 25,000, and a mean of gains no more than the logarithms of counts), so how many
    rows have each is a small table whatever the rows; prefix sums over it say where each score's ranks begin, and only rows that can be drawn are sorted,
    each score by itself. No score has more than a 2,700th part of rows that weigh the same, as its noise is spread.
    """
    (rank,) = free(scored.columns, "rank")
    marked = scored.withColumn("_in", F.coalesce(eligible, F.lit(False)))
    counts = marked.where("_in").groupBy(score).agg(F.count("*").alias("_n"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(score).alias("_of"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before"), F.floor(F.sum("_n").over(whole) * percent / 100).cast("long").alias("_take"))
    starts = written(starts.where("_before < _take"), "ranks")
    drawn = marked.join(F.broadcast(starts), (F.col(score) == F.col("_of")) & F.col("_in"), "left")
    far = drawn.where(F.col("_of").isNull()).withColumn(rank, F.lit(None).cast("long"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(score).orderBy(F.col(tie).asc_nulls_last()))
    near = drawn.where(F.col("_of").isNotNull()).withColumn(rank, place).withColumn(rank, F.when(F.col(rank) <= F.col("_take"), F.col(rank)).cast("long"))
    return near.unionByName(far).select(*scored.columns, rank)


def resampled(docs: DataFrame, target: DataFrame, identity: str, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every row's identity with n_words, n_features, weight, score and rank; rank is null but for the rows that are drawn.

    Of rows with at least `least_words` words, `percent` percent are drawn without replacement, the likelier the more their features are the target's: score is the
    weight plus Gumbel noise from the identity, and the highest scores are drawn. A null identity counts as an empty one and comes last in ties. The
    same identity has the same noise.
    """
    weighed = importance(docs, target, [identity], longest, buckets)
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col(identity).cast("string"), seed)), "scores")
    return ranked(scored, F.col("n_words") >= least_words, "score", identity, percent)


def op12_resampling(spark, sf_dir):
    """All documents against all benchmark texts."""
    from .shared import table

    out = resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"), "doc_id")
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 of a word, byte by byte, from a table of its 256 remainders; each distinct word once.
OP12_SQL = r"""
WITH RECURSIVE crc(i, j, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, j + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc WHERE j < 8),
t AS (SELECT list(c ORDER BY i) AS tab FROM crc WHERE j = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
n AS (SELECT row_number() OVER () AS r, doc_id, ws FROM d),
e AS (SELECT r, unnest(ws) AS w FROM n),
dist AS (SELECT DISTINCT w FROM (SELECT w FROM e UNION ALL SELECT w FROM b)),
h AS (SELECT w, hex(encode(w)) AS x FROM dist),
k AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, i * 2 + 1, 2))::BIGINT)),
                   lambda c, y: xor(c // 256, tab[(xor(c, y) & 255) + 1]))) % 10000 AS bucket FROM h, t),
s AS (SELECT bucket, count(*) AS s FROM e JOIN k USING (w) GROUP BY bucket),
u AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (w) GROUP BY bucket),
g AS (SELECT s.bucket, floor(1000 * ln(((coalesce(u.t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000)::DOUBLE)
                   / ((s.s + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN u USING (bucket)),
f AS (SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM e JOIN k USING (w) JOIN g USING (bucket) GROUP BY r),
p AS (SELECT n.doc_id, coalesce(f.n_features, 0) AS n_features, coalesce(f.weight, 0) AS weight,
             coalesce(f.weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(n.doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM n LEFT JOIN f USING (r)),
q AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS nth FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= floor(10 * (SELECT count(*) FROM p WHERE n_features >= 20) / 100) THEN nth END AS rank FROM q
"""
