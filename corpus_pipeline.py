"""A training corpus from raw documents: five stages, each an operator of loamline.llm on all that the stage before kept."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import decontamination, mixing, quality, sharding, signatures
from loamline.llm.shared import dropped, noting, table, written

#: SQL can express neither the classifier's nor the sharding's rows.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go. It learns from labels of ids that aren't held out."""
    trees = quality.fit_quality(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    return quality.scored(docs, trees, least=0.5)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a similarity of 0.8 or more) the document with the smallest id stays; of its repeated rows, one.

    Documents without words are no copies of anything and all stay. Without an id, one of each set of equal shingles stays, unless
    a document with an id is in its group.
    """
    return signatures.one_of_each(docs, signatures.jaccard_classes(docs, k=5, share=80), k=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares, in whole documents; a document comes once for each epoch that takes it.

    Documents are ordered by a hash of id and text, so rows that share an id, or have none, are told apart the same way in each run.
    """
    identity = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    key, size = mixing.mix_key(identity), mixing.n_words(F.col("text"))
    sizes = written(docs.select("source", size.alias("size"), key.alias("key")), "mix")
    out = mixing.taken(docs, mixing.mix_cuts(sizes), F.col("source"), size, key)
    return mixing.mixed_rows(out, docs.columns, mixing.names_of(docs, "taken"))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with shard (0 to 7) and slot."""
    return sharding.hypergeometric_shards(docs, 8, F.struct("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on documents, each written as Parquet in the shared folder and reread.

    What a stage has made on its way, and what it has read, is deleted once its result is written; other runs have tables of their own.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        made: list[DataFrame] = []
        with noting(made):
            result = stage(spark, docs, sf_dir)
        docs = written(result, name.replace(" ", "-"))
        for t in [*made, *([before] if before is not None else [])]:
            dropped(t)
        before = docs
    return docs
