"""The pipeline on rows with everything that may be odd, stage by stage."""

from __future__ import annotations

from hashlib import sha256

import pytest
from conftest import SMALL
from odd_tables import nothing, odd, odd_rows  # noqa: F401

from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm.common import written

MEDIUM = SMALL.replace("sf0.001", "sf0.01")
STAGES = dict(corpus_pipeline.STAGES)


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_return_their_columns(spark, odd, nothing, name):
    got = STAGES[name](spark, odd, MEDIUM)
    assert got.columns == odd.columns
    assert got.count() <= odd.count() and got.exceptAll(odd).count() == 0
    assert STAGES[name](spark, nothing, MEDIUM).count() == 0


def test_one_of_each_group_stays(spark, odd):
    got = STAGES["near_duplicates"](spark, odd, MEDIUM).collect()
    ids = [r.doc_id for r in got]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(3) == 1
    # Empty texts are one group, and the smallest id of theirs stays.
    assert 4 in ids and not {5, 6} & set(ids)


def test_toxic_documents_go(spark):
    """Most documents labelled toxic leave, learned from the few of a small table, and nearly all others stay."""
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{name}.parquet") for name in ("documents", "labels"))
    kept = STAGES["toxicity"](spark, docs, MEDIUM).select("doc_id").distinct()
    marked = labels.where("toxic in (0, 1)").join(kept.selectExpr("doc_id", "true AS stays"), "doc_id", "left")
    share = {r.toxic: r.share for r in marked.groupBy("toxic").agg(F.avg(F.col("stays").isNotNull().cast("double")).alias("share")).collect()}
    assert share[1] < 0.5 and share[0] > 0.95


def test_tokens_of_odd_rows(spark, odd, odd_rows, nothing):
    """One row per document, empty and null texts without ids, equal texts alike, columns of any name beside them."""
    got = STAGES["tokens"](spark, odd, MEDIUM)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and STAGES["tokens"](spark, nothing, MEDIUM).count() == 0
    want = sorted((str(r[0]), sha256((r[1] or "").encode()).hexdigest()) for r in odd_rows)
    rows = got.collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in rows) == want
    assert {r.n_tokens for r in rows if r.doc_id in (4, 5)} == {0}


def test_unreadable_texts_go(spark, odd):
    ids = {r.doc_id for r in STAGES["language"](spark, odd, MEDIUM).collect()}
    assert {1, 2, 3, 8, 10, 12} <= ids and not {4, 5, 6, 7} & ids


def test_contaminated_documents_go(spark):
    item = spark.read.parquet(f"{MEDIUM}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(1, item), (2, "word " * 2000 + item), (3, "nothing of it"), (3, item), (None, None)], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in STAGES["decontamination"](spark, docs, MEDIUM).collect()]
    assert sorted(got, key=str) == sorted([(2, "word " * 2000 + item), (3, "nothing of it"), (None, None)], key=str)


def test_whole_pipeline(spark):
    got = corpus_pipeline.run(spark, MEDIUM)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    total = spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    assert 0.6 * total < got.count() < total
    assert written(got, "pipeline-test").count() == got.count()
