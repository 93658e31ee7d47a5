"""Streams and files that are written in steps: queries that write the driver's tables as files, read them as streams and give the rows that came out."""

from pyspark.sql import functions as F

from ..sources import hashtree as H
from ..sources import ordered
from ..streaming import replace, resume
from ..tables import load, scratch, spread

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


@query("SELECT user_id, event_type AS kind, event_id AS pos, 'item' || (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 3 AS item, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 3 + 1)::BIGINT AS used FROM events")
def q_replacement_stream(spark, d):
    """Events as requests that come in three micro-batches, the last after a restart, each answered from its type's queue, whose cursor is in the state store."""
    e = load(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("pos"))
    line = e.select("kind").distinct().select("kind", F.posexplode(F.array(*[F.lit(f"item{i}") for i in range(3)])).alias("o", "item"))
    top = scratch(spark, "replacements")
    third = e.agg(F.expr("percentile_disc(0.33) WITHIN GROUP (ORDER BY pos)").alias("a"), F.expr("percentile_disc(0.67) WITHIN GROUP (ORDER BY pos)").alias("b")).first()

    def go():
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
        out = replace.replaced(stream, "kind", "pos", line, "item", "o").writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/check")
        out.trigger(availableNow=True).start().awaitTermination()

    for part in (F.col("pos") <= third.a, (F.col("pos") > third.a) & (F.col("pos") <= third.b)):
        e.where(part).coalesce(1).write.mode("append").parquet(f"{top}/in")  # a file a batch
    go()
    e.where(F.col("pos") > third.b).coalesce(1).write.mode("append").parquet(f"{top}/in")
    go()
    return spark.read.parquet(f"{top}/out").select("user_id", "kind", "pos", "item", "used")


@query("SELECT conv_id || ':' || turn AS custom_id, (SELECT bool_and(turn % 3 <> 2) FROM conversations WHERE text IS NOT NULL) AS complete, sha256(text) AS h FROM conversations WHERE turn % 3 <> 2 AND text IS NOT NULL")
def q_resumed_results(spark, d):
    """Turns as results that runners append; every third failed. The last success of each, as far as they have come, and whether none is missing."""
    top = scratch(spark, "results")
    c = load(spark, d, "conversations").where("text IS NOT NULL")
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    row = F.struct(key.alias("custom_id"), F.when(F.col("turn") % 3 == 2, "errored").otherwise("succeeded").alias("result_type"), F.lit("sha").alias("requests_sha256"), "text")
    c.select(F.to_json(row).alias("value")).write.text(f"{top}/in")
    resume.collected(resume.appended(spark, f"{top}/in", "sha", suffix=".txt"), f"{top}/out", f"{top}/check")
    done = resume.succeeded(spark, f"{top}/out")
    complete = resume.finished(spark, c.select(key.alias("custom_id")), f"{top}/out", f"{top}/final")
    return done.select("custom_id", F.lit(complete).alias("complete"), F.sha2(F.get_json_object("line", "$.text").cast("binary"), 256).alias("h"))


@query("SELECT doc_id, sha256(text) AS h, true AS equal_bytes FROM documents WHERE text IS NOT NULL")
def q_ordered_gzip(spark, d):
    """Documents written twice, from different partitions, as ordered lines in gzip, and read again; whether all bytes are equal."""
    docs = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.to_json(F.struct("doc_id", "text")).alias("line"))
    paths = [scratch(spark, "ordered") for _ in range(2)]
    for path, rows in zip(paths, (docs, spread(docs, "doc_id")), strict=True):  # as they are read, and dealt by hash
        ordered.write_lines(rows, "line", ["doc_id"], path, 500)
    a, b = (ordered.file_hashes(spark, p) for p in paths)
    same = a.join(b.select("file", F.col("sha256").alias("other")), "file", "full_outer").agg(F.coalesce(F.bool_and(F.coalesce(F.col("sha256") == F.col("other"), F.lit(False))), F.lit(True)).alias("equal_bytes"))
    back = spark.read.schema("doc_id long, text string").json(paths[0])
    return back.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).crossJoin(F.broadcast(same))


@query("SELECT doc_id, CASE WHEN doc_id % 89 = 1 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 89 = 1 OR (doc_id % 97 = 0 AND text IS NOT NULL) UNION ALL SELECT -1 - doc_id, 'added' FROM documents WHERE doc_id % 101 = 3")
def q_changed_rows(spark, d):
    """Two versions of documents, in the second of which some are longer, some gone and some new: which, from the differing leaves of their trees."""
    docs = load(spark, d, "documents").select("doc_id", "text", "lang")
    later = docs.where("doc_id % 89 <> 1").withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    later = later.union(docs.where("doc_id % 101 = 3").select((-1 - F.col("doc_id")).alias("doc_id"), "text", "lang"))
    a, b = (scratch(spark, "version") for _ in range(2))
    H.freeze(docs, "doc_id", a, 3)
    H.freeze(later, "doc_id", b, 3)
    return H.changed_rows(spark, a, b, "doc_id", 3)
