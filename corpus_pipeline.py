"""Training-data pipeline: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes
every stage's rows to the shared folder and hands the next stage what it reads
back. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacunar.llm import linededup, mixing, packing, quality, queries, tgm
from lacunar.llm.common import crc_mod, materialize, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below 0.3."""
    labels = read(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    return quality.keep_good(docs, quality.train(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops later copies of lines, and documents of which nothing is left."""
    out = linededup.dedup(docs)
    out = out.where("n_removed = 0 or trim(text) <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, 0.8)."""
    return tgm.one_of_each(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents to the sources' target weights; a row for each copy taken."""
    keep = tuple(c for c in docs.columns if c != "doc_id")
    named = [F.col(c).alias(f"kept_{c}") for c in keep]  # apart from mix's own columns, such as size
    mixed = mixing.mix(docs.select("doc_id", "text", "source", *named), keep=tuple(f"kept_{c}" for c in keep)).where("copies > 0")
    rows = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*(F.col("doc_id") if c == "doc_id" else F.col(f"kept_{c}").alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs, queries.tokenizer()))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot tokenise or fit a field; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
