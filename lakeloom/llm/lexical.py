"""Ranked lexical search: term at a time, with a limited number of accumulators.

1. Index. Every document becomes one row: how many terms it has, and for each term that an item asks for how often
   it stands there. The rows are written to the shared folder once for a block of items; a document's entries stay together,
   so the list of a frequent term is never gathered.
2. Statistics. Documents, terms and the documents of each term are counted over all rows.
3. Search. A task takes its rows in shards and turns each into lists by term. For an item the lists are read
   rarest first, and each document met gets an accumulator. Before a list is read, the most that all lists left can
   give is held against the k-th partial score, or against the k-th score of earlier shards: once it is lower, a document
   without an accumulator can no longer enter, and no more are made. Those that exist take the rest of their scores exactly.
4. A task returns k documents for each item at most, and the k best of all tasks are ranked.

All figures but the weights are 64-bit integers, so the order of additions does not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import short_batches, utf8, words_of, written

# Words of the items that are searched at once: what a task holds of them.
BLOCK_WORDS = 1_000_000
# Documents and postings of a shard: what a task holds of the corpus.
SHARD_DOCS = 8192
SHARD_POSTINGS = 1_000_000

POSTINGS = "doc_id long, n_terms long, terms array<int>, counts array<int>"
FOUND = "item_id long, doc_id long, score long"


@dataclass
class Items:
    """A block of items: their ids, their terms by number, and the numbers of the terms."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    names: list[int | None] = field(default_factory=list)
    terms: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]]) -> Items:
        """Rows of one id are one item; items without terms are left out."""
        items, by_name = cls(), {}
        for name, text in rows:
            by_name.setdefault(name, {}).update(dict.fromkeys(words_of(text.encode())))
        for name, words in by_name.items():
            if words:
                items.names.append(name)
                items.terms.append(np.array([items.vocabulary.setdefault(w, len(items.vocabulary)) for w in words], np.int64))
        return items

    def rarest_first(self, documents: np.ndarray) -> None:
        """Order the terms of each item by the number of documents that hold them."""
        self.terms = [t[np.argsort(documents[t], kind="stable")] for t in self.terms]


@dataclass
class Scoring:
    """The figures of the whole corpus: documents with terms, their terms with repeats, the weight of each term."""

    documents: int
    terms: int
    weights: np.ndarray

    def impacts(self, term: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a posting adds to a score."""
        norm = 10 + (90 * length * self.documents) // max(self.terms, 1)
        return self.weights[term] * ((1_000_000_000 * count) // (1000 * count + 8 * norm))


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _index(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(len(vocabulary), 1)
        for batch in batches:
            data, offsets = utf8(batch[1])
            raw, offsets = data.tobytes(), offsets.tolist()
            lengths, parts = [], []
            for doc, (start, end) in enumerate(zip(offsets, offsets[1:], strict=False)):
                words = words_of(raw[start:end])
                lengths.append(len(words))
                terms = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))
                parts.append(terms[terms >= 0] + doc * size)
            keys, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
            ends = np.r_[0, np.searchsorted(keys, np.arange(1, len(lengths) + 1) * size)].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (keys % size, counts)]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(lengths, pa.int64()), *lists], ["doc_id", "n_terms", "terms", "counts"])

    return run


class Shard:
    """Documents turned into lists by term: who holds it, and what it adds to their scores."""

    def __init__(self, batches: list[pa.RecordBatch], scoring: Scoring):
        rows = pa.Table.from_batches(batches).combine_chunks()
        ids = rows["doc_id"].combine_chunks()
        self.unnamed = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        terms, counts = rows["terms"].combine_chunks(), rows["counts"].combine_chunks()
        term = terms.flatten().to_numpy().astype(np.int64)
        count = counts.flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(self.ids)), np.diff(terms.offsets.to_numpy()))
        gain = scoring.impacts(term, count, rows["n_terms"].to_numpy()[doc])
        order = np.argsort(term, kind="stable")
        self.docs, self.gains = doc[order], gain[order]
        sizes = np.bincount(term, minlength=len(scoring.weights))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.most = np.zeros(len(sizes), np.int64)
        held = np.flatnonzero(sizes)
        if len(held):
            self.most[held] = np.maximum.reduceat(self.gains, self.starts[held])

    def search(self, terms: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best, with their exact scores; ``bar`` is a score that k others have."""
        terms = terms[self.most[terms] > 0]
        left = np.r_[np.cumsum(self.most[terms][::-1])[::-1], 0].tolist()
        partial = np.zeros(len(self.ids), np.int64)
        read = 0
        for term in terms.tolist():
            # What was read so far can give no more than this, so a look at the scores would be in vain.
            if left[read] < max(bar, left[0] - left[read]):
                if len(partial) >= k:
                    bar = max(bar, int(np.partition(partial, -k)[-k]))
                if left[read] < bar:
                    break
            part = slice(self.starts[term], self.ends[term])
            partial[self.docs[part]] += self.gains[part]
            read += 1
        held = np.flatnonzero(partial)
        scores = partial[held]
        for term in terms[read:].tolist():
            part = slice(self.starts[term], self.ends[term])
            docs = self.docs[part]
            at = np.minimum(np.searchsorted(docs, held), len(docs) - 1)
            scores += np.where(docs[at] == held, self.gains[part][at], 0)
        stays = scores >= max(bar, 1)
        return held[stays], scores[stays]


class Best:
    """The k best documents of one item so far: higher scores first, then smaller ids, rows without an id last."""

    def __init__(self, k: int):
        self.k = k
        self.rows = np.zeros((3, 0), np.int64)

    @property
    def bar(self) -> int:
        return int(self.rows[0, -1]) if self.rows.shape[1] == self.k else 0

    def add(self, scores: np.ndarray, unnamed: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([scores, unnamed.astype(np.int64), ids])], axis=1)
        if rows.shape[1] > self.k:
            rows = rows[:, rows[0] >= np.partition(rows[0], -self.k)[-self.k]]
        self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]]


def _search(items: Items, scoring: Scoring, k: int, shard_docs: int, shard_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items.terms]

        def search(held: list[pa.RecordBatch]) -> None:
            shard = Shard(held, scoring)
            for top, terms in zip(best, items.terms, strict=True):
                docs, scores = shard.search(terms, k, top.bar)
                if len(docs):
                    top.add(scores, shard.unnamed[docs], shard.ids[docs])

        held, docs, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            docs += len(batch)
            postings += len(batch["terms"].flatten())
            if docs >= shard_docs or postings >= shard_postings:
                search(held)
                held, docs, postings = [], 0, 0
        if docs:
            search(held)
        rows = [(name, None if unnamed else doc, score) for name, top in zip(items.names, best, strict=True) for score, unnamed, doc in top.rows.T.tolist()]
        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 3, ["item_id", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[Items]:
    """The items part by part; how many parts follows from their bytes, and a hash of the id deals them out."""
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + held // (2 * block_words)
    for block in range(blocks):
        yield Items.of([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()])


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
    shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: item_id, rank (from 1), doc_id, score.

    Equal scores go by ascending doc_id, a null id last; each row of ``docs`` is a document of its own, so repeated rows
    are ranked one after another. A null or empty text has no terms: such a document is never found and counts in no
    figure, such an item finds nothing. Rows of one item id (null included) are one item with the terms of all. No documents or no items give no
    rows. Other columns of either table are not read. The items come to the driver in blocks of bounded size;
    more of them means more passes over the documents.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for block in _blocks(items, item_col, item_text_col, block_words):
        postings = written(rows.mapInArrow(_index(block.vocabulary), POSTINGS), "term-counts")
        total = postings.agg(F.count_if(F.col("n_terms") > 0).alias("n"), F.sum("n_terms").alias("terms")).first()
        documents = np.zeros(len(block.vocabulary), np.int64)
        for term, count in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            documents[term] = count
        block.rarest_first(documents)
        weights = np.array([weight(total.n, int(n)) for n in documents], np.int64)
        search = _search(block, Scoring(total.n, total.terms or 0, weights), k, shard_docs, shard_postings)
        part = postings.where(F.size("terms") > 0).mapInArrow(search, FOUND)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
