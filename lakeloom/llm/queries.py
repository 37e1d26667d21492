"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lakeloom.llm import bpe, contamination, embeddings, extraction, langid, lexical, licenses, oracles, periodicity, sharding, simhash, suffixes, toxicity, warc
from lakeloom.llm.common import read_table, short_batches, texts
from lakeloom.session import scratch_path, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return register


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled documents outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.learn(toxicity.labelled_sample(docs, read_table(spark, sf_dir, "labels")))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    model = toxicity_model(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.with_score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document, near copies that share most of their words included."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), resemblance=simhash.RESEMBLANCE)


@query("op3_warc", oracles.OP3)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back: responses with their payloads, revisits by their headers."""
    path = scratch_path(spark, "warc")
    warc.archive(read_table(spark, sf_dir, "pages"), path)
    responses = warc.read(spark, path).where("record_type = 'response'")
    revisits = warc.read(spark, path, payload=False).where("record_type = 'revisit'")
    responses = responses.select(
        F.col("row_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        warc.payload_digest(F.col("payload")).alias("payload_digest"),
        "record_type",
        F.col("refers_to_row").alias("refers_to"),
    )
    revisits = revisits.select(
        F.col("row_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to_row").alias("refers_to"),
    )
    return responses.unionByName(revisits)


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and licenses of every document."""
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    every = F.array_sort(F.array_distinct(F.concat(F.col("base.label"), F.col("found.label"))))
    # Base phrases say a license's name outright; a rule adds what it is sure of.
    score = F.greatest(
        F.coalesce(F.array_max("found.score"), F.lit(0.0)),
        F.when(F.size("base") > 0, F.lit(0.8)).otherwise(0.0),
    )
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        score.alias("score"),
    )


@query("op5_embedding_near_dedup", oracles.OP5)
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every embedding."""
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extraction.extract(read_table(spark, sf_dir, "pages"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled folds."""
    docs = read_table(spark, sf_dir, "documents")
    model = langid.learn(langid.kept_for_learning(docs).select("lang", "text"))
    return langid.identify(docs, model).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits"
    )


def _round_trips(vocabulary: bpe.Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, ids, offsets in bpe.encoded_chunks(batches, vocabulary, bpe.CHUNK_CHARS):
            ids, counts, of_ids, of_text = ids.astype("<u4"), np.diff(offsets), [], []
            for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                of_ids.append(sha256(ids[start:end].tobytes()).hexdigest())
                of_text.append(sha256(bpe.decode_ids(ids[start:end].tolist(), vocabulary).encode()).hexdigest())
            yield pa.record_batch(
                [pa.array(names, pa.int64()), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the text they are decoded to, one row per input row.

    Encoding, decoding and both digests are made where the text is: ids go through no second worker.
    Null and empty texts have no ids. Repeated rows give equal rows, no rows none; other columns are not read.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_round_trips(bpe.Vocabulary(path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text decoded from them, as digests."""
    return tokenized(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_decontamination", oracles.OP9)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found = contamination.contamination(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contamination.contaminated().alias("contaminated"),
    )


@query("op10_sharding", oracles.OP10)
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 40 shards."""
    return sharding.interleave(read_table(spark, sf_dir, "documents"))


@query("op11_ranked_search", oracles.OP11)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.rank(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def with_tail(name: int | None, text: bytes) -> bytes:
    """The words of one text in ten, by the CRC-32 of its id, with a period from some word on; other texts as they are."""
    drawn = zlib.crc32(b"" if name is None else str(name).encode())
    words = text.split()
    if drawn % 10 or not words:
        return text
    g, n = drawn // 10, len(words)
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    tail = words[first : first + period]
    return b" ".join(words[:first] + (tail * (1 + (n - first) // period))[: n - first])


def tailed(name: F.Column, text: F.Column) -> F.Column:
    @arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, column in batches:
            made = [with_tail(one, words) for one, words in zip(names.to_pylist(), texts(column), strict=True)]
            yield pa.array(made, pa.binary()).cast(pa.string())

    return run(name, text)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, the longest of them by exponent, and the text without their repeats."""
    short_batches(spark)
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = periodicity.runs(docs.select("doc_id", tailed(F.col("doc_id"), F.col("text")).alias("text")))
    # Runs come by start and period, so of equal exponents the first one stays.
    best = F.aggregate(
        "runs",
        F.col("runs")[0],
        lambda top, run: F.when(run["length"] * top["period"] > top["length"] * run["period"], run).otherwise(top),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op13_suffix_array_dedup", oracles.OP13)
def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 200 bytes that it shares with any other place, as digests."""
    found = suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
