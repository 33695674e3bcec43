"""A corpus pipeline: quality, line dedup, near-duplicate join, mixing and packing, each stage on all that the one before kept.

All stages take nulls in any column, repeated rows, texts of any length, columns beyond those of documents (also with names that an operator
uses inside) and empty tables, which give no rows. Null and empty texts are scored as empty ones, lose no lines and are linked with nothing; mixing
takes them as of size 0, and packing gives each its end mark. Null ids are kept; null sources are one source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankpulse.llm import jaccard, line_dedup, mixing, packing, quality_model
from rankpulse.llm.common import cut, table
from rankpulse.llm.queries import byte_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier takes for good."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = quality_model.classify(docs, labels)
    return scored.filter("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stood before; those that have no words left go, as their text stays in its first copy."""
    cleaned = line_dedup.dedup(docs)
    kept = cleaned.filter((F.col("n_removed") == 0) | ~line_dedup.blank(F.col("text")))
    return kept.select(*docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: that of the smallest id, null ids last, then of the smallest hash of its text. Those without words stay."""
    linked = cut(jaccard.linked_texts(docs.select("doc_id", "text")))
    triple = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    best = linked.filter("component is not null").groupBy("component").agg(F.min(triple).alias("_f")).select("_f._id", "_f._hash")
    rows = linked.groupBy(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).agg(F.count(F.lit(1)).alias("_rows"))
    best = best.join(rows, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))).select("_id", "_hash", "_rows")
    blank = linked.filter("component is null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct().withColumn("_rows", F.lit(1).cast("long"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    kept = docs.join(best.unionByName(blank), on)
    # of equal rows one; others need no order
    one = Window.partitionBy("_id", "_hash").orderBy(F.xxhash64(*docs.columns))
    several = kept.filter("_rows > 1").withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    return kept.filter("_rows = 1").select(*docs.columns).unionByName(several.select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, each as often as its source's weight asks for."""
    return mixing.mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: the place of every piece."""
    return packing.pack(packing.tokenise(docs, byte_bpe()))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: Stages with a fitted model, components and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
