"""Yearly feeds with checksums, and XML taxonomies."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import VECTOR, canonical_vector, parse_vector
from ..operators.ledger import latest_wins

NAME = r"/nvdcve-2\.0-(\d{4})\.json(\.gz)?$"


def feed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, year, content): the yearly feeds, and only these; none at all is an error."""
    found = spark.read.format("binaryFile").load(folder).where(F.col("path").rlike(NAME)).select("path", F.regexp_extract("path", NAME, 1).cast("int").alias("year"), "content")
    if found.select("path").isEmpty():
        raise ValueError("no yearly feed")
    return found


def read_feeds(spark: SparkSession, folder: str, record: T.StructType) -> DataFrame:
    """(feed, timestamp, n_records, record): every record of the yearly feeds, with their feed's time and number of records. A body whose SHA-256 isn't the one
    in its .meta, if it has one, is an error."""
    def unpack(batches):
        import gzip
        import hashlib

        import pyarrow as pa

        for batch in batches:
            raw = [gzip.decompress(b) if p.endswith(".gz") else b for p, b in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([hashlib.sha256(b).hexdigest() for b in raw]), pa.array([b.decode() for b in raw])], names=["path", "sha", "body"])

    bodies = feed_files(spark, folder).select("path", "content").mapInArrow(unpack, "path string, sha string, body string")
    metas = spark.read.text(folder, wholetext=True).where(F.col("_metadata.file_path").endswith(".meta"))
    metas = metas.select(F.regexp_extract(F.element_at(F.split("_metadata.file_path", "/"), -1), r"^(.*)\.meta$", 1).alias("m"), F.lower(F.regexp_extract("value", r"sha256:([0-9A-Fa-f]{64})", 1)).alias("said"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json(\.gz)?$", "")
    both = bodies.join(F.broadcast(metas), stem == F.col("m"), "left")  # a row for each year
    checked = F.when(F.col("said").isNull() | (F.col("said") == F.col("sha")), F.col("body")).otherwise(F.raise_error(F.lit("a feed doesn't have the checksum in its .meta")))
    schema = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("vulnerabilities", T.ArrayType(T.StructType([T.StructField("cve", record)])))])
    read = both.select(F.element_at(F.split("path", "/"), -1).alias("feed"), F.from_json(checked, schema).alias("f"))
    return read.select("feed", "f.timestamp", F.size("f.vulnerabilities").alias("n_records"), F.explode("f.vulnerabilities.cve").alias("record"))


def extract(feeds: DataFrame, needed: DataFrame, key: str = "id") -> DataFrame:
    """Records that are needed, one of each id: the latest lastModified; with a tie, the earlier feed's."""
    rows = feeds.select("feed", "record.*").join(needed.select(key).distinct(), key, "left_semi")
    return latest_wins(rows, key, "lastModified", "feed")


def extract_statistics(feeds: DataFrame, needed: DataFrame, key: str = "id") -> DataFrame:
    """(needed, found, missing, duplicates): distinct ids asked for, those that feeds have and lack, and records beyond the first of an id."""
    asked = needed.select(key).distinct()
    n = feeds.select(F.col(f"record.{key}").alias(key)).groupBy(key).agg(F.count("*").alias("n"))
    return asked.join(n, key, "left").agg(F.count("*").alias("needed"), F.count("n").alias("found"), (F.count("*") - F.count("n")).alias("missing"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def english(descriptions):
    """The first English description that isn't blank, trimmed."""
    found = F.filter(descriptions, lambda d: (d["lang"] == "en") & (F.regexp_replace(d["value"], r"(?U)\s", "") != ""))
    return F.regexp_replace(F.try_element_at(found, F.lit(1))["value"], r"(?U)\A\s+|\s+\z", "")


def label_values(weaknesses, source: str):
    """Distinct English values of a source's blocks that aren't blank, trimmed and sorted; null if the source has no block."""
    mine = F.filter(F.coalesce(weaknesses, F.array()), lambda w: w["source"] == source)
    strip = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    values = F.flatten(F.transform(mine, lambda w: F.transform(F.filter(F.coalesce(w["description"], F.array()), lambda d: (d["lang"] == "en") & d["value"].isNotNull()), lambda d: strip(d["value"]))))
    return F.when(F.size(mine) > 0, F.array_sort(F.array_distinct(F.filter(values, lambda v: v != ""))))


def read_taxonomy(spark: SparkSession, path: str, view: str = "1000", release: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, abstraction, status, kind, description) and ChildOf edges (child, parent) of a view.

    kind is weakness, category or view; description is that of deprecated weaknesses, white space made single. A catalog of another release than the one asked
    for is an error.
    """
    text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    if release is not None:
        head = spark.read.text(path).where(F.col("value").contains("<Weakness_Catalog")).select(F.regexp_extract("value", r'<Weakness_Catalog[^>]*\bVersion="([^"]*)"', 1).alias("v"))
        if [r.v for r in head.collect()] != [release]:
            raise ValueError(f"the taxonomy isn't release {release}")
    related = T.StructType(text("_Nature", "_CWE_ID", "_View_ID"))
    schema = T.StructType([*text("_ID", "_Name", "_Abstraction", "_Status", "Description"), T.StructField("Related_Weaknesses", T.StructType([T.StructField("Related_Weakness", T.ArrayType(related))]))])
    rows = read("Weakness", schema)
    note = F.trim(F.regexp_replace("Description", r"(?U)\s+", " "))
    nodes = rows.select(F.col("_ID").alias("id"), F.col("_Name").alias("name"), F.col("_Abstraction").alias("abstraction"), F.col("_Status").alias("status"), F.lit("weakness").alias("kind"), F.when(F.col("_Status") == "Deprecated", note).alias("description"))
    for tag in ("Category", "View"):
        more = read(tag, T.StructType(text("_ID", "_Name", "_Status")))
        nodes = nodes.union(more.select(F.col("_ID").alias("id"), F.col("_Name").alias("name"), F.lit(None).cast("string").alias("abstraction"), F.col("_Status").alias("status"), F.lit(tag.lower()).alias("kind"), F.lit(None).cast("string").alias("description")))
    edges = rows.select(F.col("_ID").alias("child"), F.explode("Related_Weaknesses.Related_Weakness").alias("r")).where((F.col("r._Nature") == "ChildOf") & (F.col("r._View_ID") == view))
    return nodes, edges.select("child", F.col("r._CWE_ID").alias("parent")).distinct()


# The fields that repeat a vector's components in words.
WORDS = {"AV": "attackVector", "AC": "attackComplexity", "PR": "privilegesRequired", "UI": "userInteraction", "S": "scope", "C": "confidentialityImpact", "I": "integrityImpact", "A": "availabilityImpact"}


def select_vector(metrics, source: str):
    """(reason, version, vector, both_versions) of a record's metrics: a source's own v3.1 vector, else its v3.0 one.

    metrics: a struct of cvssMetricV31, cvssMetricV30, cvssMetricV2 and cvssMetricV40, arrays or null; an entry has source and cvssData with
    version, vectorString and the words. reason is ok, or why there is no vector: cna_only_v3, v2_only, v4_only, no_cvss,
    conflicting_nvd_vectors, invalid_vector, version_mismatch or decomposed_mismatch.
    """
    own = {v: F.filter(F.coalesce(metrics[k], F.array()), lambda m: m["source"] == source) for v, k in (("3.1", "cvssMetricV31"), ("3.0", "cvssMetricV30"))}
    some = lambda k: F.size(F.coalesce(metrics[k], F.array())) > 0
    has = {v: F.size(e) > 0 for v, e in own.items()}
    version = F.when(has["3.1"], "3.1").when(has["3.0"], "3.0")
    entries = F.when(has["3.1"], own["3.1"]).otherwise(own["3.0"])
    data = F.try_element_at(entries, F.lit(1))["cvssData"]
    once = F.struct(
        version.alias("version"), F.transform(entries, lambda m: m["cvssData"]["vectorString"]).alias("vectors"), data.alias("data"), parse_vector(data["vectorString"], VECTOR).alias("parts"),
        F.regexp_extract(F.upper(F.trim(data["vectorString"])), r"\ACVSS:(3\.[01])/", 1).alias("declared"), (some("cvssMetricV31") | some("cvssMetricV30")).alias("v3"), some("cvssMetricV2").alias("v2"), some("cvssMetricV40").alias("v4"),
        (has["3.1"] & has["3.0"]).alias("both"),
    )

    def chosen(t):
        differs = F.lit(False)
        for k, field in WORDS.items():
            differs = differs | F.coalesce(F.upper(F.substring(t["data"][field], 1, 1)) != F.try_element_at(t["parts"], F.lit(k)), F.lit(False))
        none, said = t["version"].isNull(), F.coalesce(t["data"]["version"], t["version"])
        reason = (
            F.when(none & t["v3"], "cna_only_v3").when(none & t["v2"], "v2_only").when(none & t["v4"], "v4_only").when(none, "no_cvss")
            .when(F.size(F.array_distinct(t["vectors"])) > 1, "conflicting_nvd_vectors").when(t["parts"].isNull(), "invalid_vector")
            .when((t["declared"] != t["version"]) | (said != t["version"]), "version_mismatch").when(differs, "decomposed_mismatch").otherwise("ok")
        )
        return F.struct(reason.alias("reason"), t.alias("t"))

    def shown(x):
        keep = lambda c: F.when(x["reason"] == "ok", c)
        return F.struct(x["reason"].alias("reason"), keep(x["t"]["version"]).alias("version"), keep(canonical_vector(x["t"]["parts"], tuple(VECTOR))).alias("vector"), keep(x["t"]["both"]).alias("both_versions"))

    # each step is a function of one value, so that what it is made of is computed once
    return F.element_at(F.transform(F.transform(F.array(once), chosen), shown), 1)
