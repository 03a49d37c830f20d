"""From documents to packed training sequences, in five stages.

Each stage is (name, function of (spark, docs, sf_dir)); a stage reads what the
stage before it wrote. All but the last return the columns of documents. Null
ids and repeated rows pass like others. Near duplicates are told apart by row:
whatever ids repeat or lack, a group of near copies keeps one row. Documents
without words are copies of nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.llm import mixing, neardup, packing, quality, secrets
from fluxgrid.llm.shared import materialise
from fluxgrid.llm.tokens import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.filter_quality(docs, "text", "doc_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: of the smallest id (none last), of rows that repeat id and text one. Rows without words all stay."""
    rows = docs.withColumn("_k", F.xxhash64("doc_id", "text"))
    found = neardup.near_duplicates(rows.select("_k", "text"), "_k", "text")
    found = found.groupBy(F.col("id").alias("_k")).agg(F.min("component_id").alias("component_id"), F.max("n_shingles").alias("n"), F.count("*").alias("rows"))
    ids = rows.select("_k", "doc_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k", "rows")).alias("first")
    keep = found.join(ids, "_k").groupBy("component_id").agg(least, F.max("n").alias("n"))
    keep = materialise(keep.select("first._k", ((F.col("first.rows") > 1) & (F.col("n") > 0)).alias("repeated")), "keep")
    kept = rows.join(keep.where("NOT repeated").select("_k"), "_k", "left_semi").select(*docs.columns)
    one = rows.join(keep.where("repeated").select("_k"), "_k", "left_semi")
    one = one.groupBy("_k").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.unionByName(one)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars counted anew."""
    out = secrets.redact(docs, "text", secrets.train(docs, "text", "doc_id"))
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind)).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    narrow = docs.select("doc_id", "source", F.xxhash64("text").alias("_h"), mixing.word_count("text").alias("n_words"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "_h").orderBy("source"))
    taken = mixing.mix(narrow, "source", F.col("n_words")).where("copies > 0").select("doc_id", "source", "_h", "copies")
    taken = taken.withColumn("_n", nth).select(F.col("doc_id").alias("_d"), F.col("_h").alias("_g"), F.col("_n").alias("_m"), "copies")
    rows = docs.withColumn("_h", F.xxhash64("text")).withColumn("_n", nth)
    rows = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g")) & (F.col("_n") == F.col("_m")))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 1024 tokens."""
    return packing.pack(packing.pieces(docs, "doc_id", "text", tokenizer_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]
#: Shingle components, models and packing have no SQL; tests hold the stages against versions in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
