"""The tag dictionary's files: one JSON document with tags, rules and relations, read into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = "struct<tag: string, name: string, dimension: string, category: string, parent: string, weight: double, keywords: array<string>, low: double, high: double>"
SCHEMA = f"tags array<{_TAG}>, exclusive array<array<string>>, implies array<struct<tag: string, implied: array<string>>>, requires array<struct<tag: string, needs: array<string>>>, version string"


def read_dictionary(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a dictionary file (JSON over many lines).

    ``tags`` (tag, name, dimension, category, parent, weight, low, high), ``keywords`` (tag, keyword), ``exclusive``
    (tag1, tag2), ``implies`` (tag, implied) and ``requires`` (tag, needs).  A part that the file lacks gives an empty
    table, a missing weight counts as 1, tags without a name of their own are passed over, and repeated rows count once.
    """
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    tags = raw.select(F.inline("tags")).filter("tag is not null").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    pair = F.col("p")
    exclusive = raw.select(F.explode("exclusive").alias("p")).filter(F.size("p") == 2)
    return {
        "tags": tags.drop("keywords").distinct(),
        "keywords": tags.select("tag", F.explode("keywords").alias("keyword")).distinct(),
        "exclusive": exclusive.select(F.least(pair[0], pair[1]).alias("tag1"), F.greatest(pair[0], pair[1]).alias("tag2")).distinct(),
        "implies": raw.select(F.inline("implies")).select("tag", F.explode("implied").alias("implied")).distinct(),
        "requires": raw.select(F.inline("requires")).select("tag", F.explode("needs").alias("needs")).distinct(),
    }
