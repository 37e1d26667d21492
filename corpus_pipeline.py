"""A training corpus from raw documents: five stages, each on all that the one before it kept.

Every stage but the last returns the columns of its input, whatever they are called, and rows that it keeps are
unchanged. A stage is ``(spark, docs, sf_dir) -> DataFrame``; what it returns is written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import contamination, langid, queries, simhash, toxicity
from lakeloom.llm.common import read_table, written
from lakeloom.session import tune


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the input does not use, whatever the case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold stay. Null and empty texts are scored like texts without words."""
    model = queries.toxicity_model(spark, sf_dir)
    score = _free(docs, "toxicity_score")
    return toxicity.with_score(docs, model, name=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def unreadable_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language stay. Texts without any letter have none (``und``), and so have null and empty ones."""
    labelled = langid.kept_for_learning(read_table(spark, sf_dir, "documents")).select("lang", "text")
    found = _free(docs, "language_found")
    rows = docs.withColumn(found, langid.predict(F.col("text"), langid.learn(labelled)))
    return rows.where(F.col(f"{found}.lang") != langid.UNKNOWN).drop(found)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the least id, and one row of it if it is repeated.

    Rows without an id have no place in that order; they are kept when no row of their group has one, one of each group.
    """
    key = _free(docs, "row_key")
    docs = written(docs.withColumn(key, F.monotonically_increasing_id()), "corpus-rows")
    groups = simhash.near_duplicates(docs.select(F.col(key).alias("row"), F.struct("doc_id", "text").alias("doc")).select("row", "doc.*"), id_col="row")
    placed = groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    ids = docs.select(F.col(key).alias("row"), F.col("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    first = placed.join(ids, "row").groupBy("group").agg(F.min(order).alias("first"))
    return docs.join(first.select(F.col("first.row").alias(key)), key, "left_semi").drop(key)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than one benchmark word in twenty stay."""
    key = _free(docs, "row_key")
    docs = written(docs.withColumn(key, F.monotonically_increasing_id()), "corpus-rows")
    found = contamination.contamination(docs, read_table(spark, sf_dir, "benchmark"), id_col=key)
    bad = found.where(contamination.contaminated()).select(F.col("doc_id").alias(key))
    return docs.join(bad, key, "left_anti").drop(key)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, by the byte-level vocabulary."""
    return queries.tokenized(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("language", unreadable_out),
    ("near_duplicates", near_copies_out),
    ("decontamination", contaminated_out),
    ("tokens", tokens),
]

# Trees, code lengths and merges are no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    tune(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
