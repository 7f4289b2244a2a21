"""One query for each corpus operator, over whole tables.

Keys are ``opN_<name>``; ``pipeline`` runs the stages of corpus_pipeline.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, langid, linededup, lpf, media, mixing, packing, quality, tgm, urlfilter
from .common import crc_mod, read


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    return langid.predict(docs, langid.train(docs.where(~held)), held)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    field = quality.train(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return quality.score(docs, field, crc_mod("doc_id", 5) == 0)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf.cut(read(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tgm.join(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def tokenizer() -> str:
    """Path of the public word tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents"), tokenizer()))


RULES = [
    urlfilter.Rule("org", "/", True),
    urlfilter.Rule("example.org", "/es/", False),
    urlfilter.Rule("example.org", "/en/1", False),
    urlfilter.Rule("com", "/fr/", True),
    urlfilter.Rule("com", "/de/", False),
]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"), RULES)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.summary(read(spark, sf_dir, "documents"))


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed clip rows of every document's AVI file."""
    return media.clips(media.store(read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"media_clips": media_clips}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": linededup.SQL, "op10_mixing": mixing.SQL}
