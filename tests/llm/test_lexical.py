"""Ranked lexical search against plain scoring of every document for every item."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from odd_tables import nothing, odd, odd_rows  # noqa: F401

from lakeloom.llm import lexical
from lakeloom.llm.common import words_of

ITEMS = "item_id long, text string, score double, rank string"


def plain(docs, items, k=10):
    """Scores by the formula, one document after another."""
    held = [(i, Counter(words_of((t or "").encode()))) for i, t in docs]
    n = sum(1 for _, c in held if c)
    total = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words_of((t or "").encode()))
    out = []
    for item, terms in asked.items():
        rows = []
        for doc, counts in held:
            score = 0
            for t in terms & set(counts):
                m = 100 - 90 + (90 * counts.total() * n) // total
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                rows.append((-score, doc is None, doc if doc is not None else 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def rows_of(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_odd_documents_and_items(spark, odd, odd_rows):
    asked = [(1, "the of Ges 12"), (1, "lun; ONE"), (2, None), (3, ""), (4, "!!"), (None, "two ünïcode éàç"), (5, "nowhere else"), (6, "x" * 50_000), (7, "the " * 9000)]
    items = spark.createDataFrame([(*r, 1.0, "r") for r in asked], ITEMS)
    got = lexical.rank(odd, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == plain([r[:2] for r in odd_rows], asked)
    assert rows_of(lexical.rank(odd, items, k=2, shard_docs=2)) == plain([r[:2] for r in odd_rows], asked, 2)
    # One item a block.
    assert rows_of(lexical.rank(odd, items, block_words=20_000)) == plain([r[:2] for r in odd_rows], asked)


def test_no_documents_or_items(spark, odd, nothing):
    items = spark.createDataFrame([(1, "the of", 1.0, "r")], ITEMS)
    assert lexical.rank(nothing, items).count() == 0
    assert lexical.rank(odd, items.where("item_id > 1")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_shards_and_ties(spark, seed):
    """Few words and many copies, so that scores tie at the k-th place and most items stop early."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(400):
        text = " ".join(draw.choices(words, [1 / (j + 1) for j in range(60)], k=draw.randint(1, 40)))
        docs += [(1000 - 2 * i, text)] + ([(2 * i + 1, text)] if i % 5 == 0 else [])
    items = [(i, " ".join(draw.sample(words, draw.randint(1, 12)))) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = lexical.rank(frame, spark.createDataFrame(items, "item_id long, text string"), k=5, shard_docs=64, shard_postings=300)
    assert rows_of(got) == plain(docs, items, 5)


def shard_of(texts, terms):
    """A shard of texts, and its scoring, by hand."""
    items = lexical.Items.of([(0, " ".join(terms))])
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    [postings] = lexical._index(items.vocabulary)(iter([batch]))
    held = np.bincount(postings["terms"].flatten().to_numpy(), minlength=len(items.vocabulary))
    weights = np.array([lexical.weight(len(texts), int(x)) for x in held], np.int64)
    items.rarest_first(held)
    scoring = lexical.Scoring(len(texts), sum(len(t.split()) for t in texts), weights)
    return lexical.Shard([postings], scoring), items.terms[0]


def test_no_accumulators_after_the_bounds_are_low():
    """Documents that hold only the frequent term are never given an accumulator, those that exist get their whole score."""
    texts = ["rare rare odd common"] * 3 + ["common " * 4] * 500 + ["other"] * 600
    shard, terms = shard_of(texts, ["common", "rare", "odd"])
    docs, scores = shard.search(terms, 3, 0)
    assert docs.tolist() == [0, 1, 2]
    every, exact = shard.search(terms, 2000, 0)
    assert len(every) == 503 and exact[:3].tolist() == scores.tolist()
    # A bar that others have reached closes the search at once.
    assert shard.search(terms, 3, int(exact.max()) * 2)[0].tolist() == []
