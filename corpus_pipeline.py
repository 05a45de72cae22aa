"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all that the stage before kept; its rows
are written as Parquet and read again as the next one's documents. Stages keep the columns of
documents; `n_chars` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontamination, language, lines, minhash, packing
from tracewright.llm.contract import tokenizer_path
from tracewright.plans.storage import new_path, store

LEAST_BELIEF = 0.5  # of the language


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, where there is that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some certainty; the rest, such as text without letters, goes."""
    model = language.train(language.sample_labelled(docs))
    found = language.predict(docs, model)
    sure = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_BELIEF)
    return found.where(sure).select(*docs.columns)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat another one go; documents of which nothing is left go too."""
    left = lines.dedup_lines(docs)
    return _measured(left.where("size(removed) = 0 or text rlike '[^ \\\\t\\\\n\\\\r]'").select(*docs.columns))


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of which nothing is left go."""
    # in one stage, two Python workers a core would run, and packing would load its tokenizer into all of them
    found = store(decontamination.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "found")
    clean = decontamination.remove(found)
    return _measured(clean.where("size(spans) = 0 or text rlike '[\\\\p{L}\\\\p{N}]'").select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece of a document with its place."""
    pieces = store(packing.cut_pieces(docs, tokenizer_path("word_bpe_49k.json"), end_id=1), "pieces")
    return packing.pack(pieces).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", known_language),
    ("line dedup", unique_lines),
    ("MinHash near-dedup", unique_documents),
    ("benchmark decontamination", without_benchmarks),
    ("best-fit packing", packed),
]

#: None: trained models, hash tables and packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
