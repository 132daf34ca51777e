"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recfeat.llm import decontam, langid, mixing, neardup, sharding
from recfeat.llm.common import fresh_name, new_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of which one learned language makes up half or more; texts without letters go."""
    model = langid.fit(docs.filter(~langid.held_out()).select("doc_id", "text", "lang"))
    return langid.reject(docs, *model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return neardup.deduplicate(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item, or all words of a shorter one."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order that holds each source to its target weight (rows ** 0.7): the written files, read in
    the order of their names, are the mixture."""
    return mixing.mixed(docs, alpha=0.7)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``documents`` with shard and slot: the mixture, whose order the files of the stage before hold, is
    cut into 24 runs of equal row counts, a shard each, so that every shard has the proportions of its part of the
    mixture.  Inside a shard rows stand along the Hilbert curve, and inside a cell in the order of the mixture."""
    shards = 24
    if not _has_places(docs):
        return sharding.sharded(docs, shards)
    file, row, at, run = (fresh_name(docs.columns, stem) for stem in ("mix_file", "mix_row", "mix_at", "mix_run"))
    docs = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    # Part files are numbered; the number, not the name, is in the order of the mixture beyond 100,000 of them.
    number = F.regexp_extract(file, r"part-(\d+)", 1).try_cast("long")
    before = Window.orderBy(number, file).rowsBetween(Window.unboundedPreceding, -1)
    sizes = docs.groupBy(file).agg(F.count(F.lit(1)).alias("n"))  # one row a file
    starts = sizes.select(file, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(at))
    total = max(1, docs.count())
    docs = docs.join(F.broadcast(starts), file).withColumn(at, F.col(at) + F.col(row)).drop(file, row)
    return sharding.sharded(docs.withColumn(run, F.floor(F.col(at) * shards / total)), shards, first=(run,), then=(at,))


def _has_places(docs: DataFrame) -> bool:
    """Whether rows know their file and place in it: not so for tables that aren't read from files."""
    try:
        docs.select("_metadata.file_name")
    except AnalysisException:
        return False
    return True


STAGES = [
    ("language ID", language_id),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Expectation-maximisation and the mixing schedule have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are stored before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            path = new_path(spark, f"stage-{at}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
