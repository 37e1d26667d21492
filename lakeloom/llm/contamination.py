"""Benchmark decontamination by a stored positional inverted index.

1. Index. Every document becomes one row of postings: for each term that the benchmark has, the positions
   where it stands, ordered by term and position. The rows are written to the shared folder; a document and
   its postings stay together, so no list of a frequent term is ever gathered.
2. Statistics. The number of documents of each term is counted over all postings.
3. Search. Each window of an item starts from its rarest term: the list of that term, moved by the term's offset, gives the
   candidate places, and the lists of the other terms, rarest first and moved alike, are intersected with them. A
   window with a term that no document of a batch holds is left out at once. With ``slop`` the terms may stand
   further apart, in order, within that many words more.

The benchmark is read in blocks of bounded size, each taken to all tasks; a larger benchmark means more blocks.
Any number of equal passages costs one row per document, since hits leave a task as merged spans and item ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import short_batches, utf8, words_of, written

WINDOW = 13
# Words of the benchmark that are searched at once: what a task holds of it.
BLOCK_WORDS = 1_000_000
# Candidate places that are intersected at once.
PLACES = 2_000_000

POSTINGS = "doc_id long, text_key string, n_words long, terms array<int>, positions array<int>"
FOUND = "doc_id long, text_key string, items array<string>, starts array<int>, ends array<int>"


class Windows:
    """The windows of a block of items: their terms, their items, and the terms' numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        for _, words in items:
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary))
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        by_size: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for name, words in items:
            terms = [self.vocabulary[w] for w in words]
            width = min(size, len(terms))
            for i in range(len(terms) - width + 1 if width else 0):
                by_size.setdefault(width, {}).setdefault(tuple(terms[i : i + width]), set()).add(number[name])
        # For each length: the terms of each window, and the item of each (window, item).
        self.tables = [
            (
                np.array(list(found), np.int64).reshape(-1, width),
                np.repeat(np.arange(len(found)), [len(x) for x in found.values()]),
                np.array([i for x in found.values() for i in sorted(x)], np.int64),
            )
            for width, found in sorted(by_size.items())
        ]

    def rarest_first(self, documents: np.ndarray) -> None:
        """Order the offsets of each window by the number of documents that hold their terms."""
        self.orders = [np.argsort(documents[terms], axis=1, kind="stable") for terms, _, _ in self.tables]


def _index(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch[1])
            raw, offsets = data.tobytes(), offsets.tolist()
            split = [words_of(raw[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            counts = np.fromiter(map(len, split), np.int64, len(split))
            total = int(counts.sum())
            terms = np.fromiter(
                (t for words in split for t in map(vocabulary.get, words, repeat(-1))), np.int32, total
            )
            doc = np.repeat(np.arange(len(split)), counts)
            at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
            known = np.flatnonzero(terms >= 0)
            order = known[np.argsort(doc[known] * max(len(vocabulary), 1) + terms[known], kind="stable")]
            ends = np.r_[0, np.cumsum(np.bincount(doc[known], minlength=len(split)))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (terms[order], at[order])]
            yield pa.RecordBatch.from_arrays(
                [batch[0], batch[2], pa.array(counts), *lists],
                ["doc_id", "text_key", "n_words", "terms", "positions"],
            )

    return run


class Postings:
    """The postings of a batch of documents, laid out as one line of words with a gap behind each document."""

    def __init__(self, batch: pa.RecordBatch, terms: int, margin: int):
        room = batch["n_words"].to_numpy() + margin
        self.first = margin + np.cumsum(room) - room
        lists = batch["terms"]
        term, place = lists.flatten().to_numpy(), batch["positions"].flatten().to_numpy()
        place = place + np.repeat(self.first, np.diff(lists.offsets.to_numpy()))
        self.term_at = np.full(2 * margin + int(room.sum()), -1, np.int32)
        self.term_at[place] = term
        self.counts = np.bincount(term, minlength=terms)
        self.starts = np.cumsum(self.counts) - self.counts
        self.places = place[np.argsort(term, kind="stable")]

    def of(self, term: int) -> np.ndarray:
        return self.places[self.starts[term] : self.starts[term] + self.counts[term]]


def exact_places(index: Postings, terms: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (window, first place) where all terms of a window stand in a row."""
    windows = np.flatnonzero((index.counts[terms] > 0).all(axis=1)) if len(terms) else np.zeros(0, np.int64)
    rarest = terms[windows, order[windows, 0]]
    sizes = index.counts[rarest]
    for part in np.split(np.arange(len(windows)), np.flatnonzero(np.diff(np.cumsum(sizes) // PLACES)) + 1):
        window, size = windows[part], sizes[part]
        which = np.repeat(np.arange(len(part)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        window = window[which]
        start = index.places[index.starts[rarest[part]][which] + at] - order[window, 0]
        for k in range(1, terms.shape[1]):
            offset = order[window, k]
            stays = index.term_at[start + offset] == terms[window, offset]
            window, start = window[stays], start[stays]
        yield window, start


def near_places(index: Postings, terms: np.ndarray, order: np.ndarray, slop: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window: first and last place of its terms in order, at most ``slop`` words longer than the window.

    From every place of the rarest term the nearest places of the terms after and before it are followed.
    """
    width = terms.shape[1]
    for window in np.flatnonzero((index.counts[terms] > 0).all(axis=1)) if len(terms) else ():
        middle = int(order[window, 0])
        low = high = index.of(terms[window, middle])
        for k in range(middle + 1, width):
            places = index.of(terms[window, k])
            at = np.searchsorted(places, high, side="right")
            stays = at < len(places)
            low, high = low[stays], places[at[stays]]
            stays = high - low < width + slop
            low, high = low[stays], high[stays]
        for k in range(middle - 1, -1, -1):
            places = index.of(terms[window, k])
            at = np.searchsorted(places, low, side="left") - 1
            stays = at >= 0
            low, high = places[at[stays]], high[stays]
            stays = high - low < width + slop
            low, high = low[stays], high[stays]
        yield int(window), low, high


def _search(windows: Windows, slop: int):
    margin = WINDOW + slop + max((t.shape[1] for t, _, _ in windows.tables), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = Postings(batch, len(windows.vocabulary), margin)
            doc_items, low, high = [], [], []
            for (terms, of_window, item), order in zip(windows.tables, windows.orders, strict=True):
                first = np.searchsorted(of_window, np.arange(len(terms) + 1))
                if slop:
                    found = ((np.full(len(a), w), a, b) for w, a, b in near_places(index, terms, order, slop))
                else:
                    found = ((w, a, a + terms.shape[1] - 1) for w, a in exact_places(index, terms, order))
                for window, a, b in found:
                    low.append(a)
                    high.append(b)
                    doc = np.searchsorted(index.first, a, side="right") - 1
                    size = first[window + 1] - first[window]
                    which = np.repeat(first[window] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    doc_items.append(np.unique(np.repeat(doc, size) * len(windows.names) + item[which]))
            yield _found(batch, index, windows.names, doc_items, low, high)

    return run


def _found(batch: pa.RecordBatch, index: Postings, names: list[str], doc_items: list, low: list, high: list) -> pa.RecordBatch:
    """One row per document with matches: its items, and its hit words as spans that do not touch."""
    none = np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate([none, *doc_items]))
    low, high = np.concatenate([none, *low]), np.concatenate([none, *high])
    change = np.zeros(len(index.term_at) + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, high + 1, -1)
    hit = np.diff(np.r_[0, (np.cumsum(change) > 0).astype(np.int8), 0])
    starts, ends = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
    doc, item = pairs // max(len(names), 1), pairs % max(len(names), 1)
    docs = np.unique(doc)
    of = np.searchsorted(index.first, starts, side="right") - 1
    bounds = [np.r_[np.searchsorted(x, docs), len(x)].astype(np.int32) for x in (doc, of)]
    lists = (
        (bounds[0], pa.array([names[i] for i in item.tolist()], pa.string())),
        (bounds[1], pa.array((starts - index.first[of]).astype(np.int32))),
        (bounds[1], pa.array((ends - index.first[of]).astype(np.int32))),
    )
    rows = pa.array(docs)
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"].take(rows), batch["text_key"].take(rows), *(pa.ListArray.from_arrays(pa.array(b), x) for b, x in lists)],
        ["doc_id", "text_key", "items", "starts", "ends"],
    )


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int, block_words: int) -> Iterator[Windows]:
    """The benchmark part by part; how many follows from its bytes, and a hash deals the items out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text.alias("text"))
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + held // (2 * block_words)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        yield Windows([(r.item, words_of(r.text.encode())) for r in rows], size)


def _no_spans(name: str) -> F.Column:
    return F.coalesce(F.col(name), F.array().cast("array<int>"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    slop: int = 0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, items (sorted names), starts and ends of hit spans (ends exclusive).

    A null or empty text has no words and no hits; an item without words has no windows; a null item id is named
    by the empty string, rows of one id are one item. Repeated documents get equal rows. An empty benchmark hits nothing,
    no documents give no rows. Other columns of either table are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.sha1(F.coalesce(text, F.lit("")).cast("binary")).alias("text_key"))
    every, found = None, None
    for block in _blocks(benchmark, item_col, item_text_col, window, block_words):
        postings = written(rows.mapInArrow(_index(block.vocabulary), POSTINGS), "postings")
        documents = np.zeros(len(block.vocabulary), np.int64)
        held = postings.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count()
        for term, count in held.collect():
            documents[term] = count
        block.rarest_first(documents)
        part = postings.where(F.size("terms") > 0).mapInArrow(_search(block, slop), FOUND)
        every = every if every is not None else postings.select("doc_id", "text_key", "n_words")
        found = part if found is None else found.union(part)
    found = written(found, "hits").groupBy("doc_id", "text_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("starts", "ends"))))).alias("spans"),
    )
    # Spans of several blocks may overlap: each adds the words past the furthest end so far.
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["ends"] - F.greatest(s["starts"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], s["ends"]).alias("end"),
        ),
    )
    found = found.select(
        F.col("doc_id").alias("_id"),
        F.col("text_key").alias("_key"),
        "items",
        F.col("spans.starts").alias("starts"),
        F.col("spans.ends").alias("ends"),
        merged["n"].cast("long").alias("n_hit"),
    )
    joined = every.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        _no_spans("starts").alias("starts"),
        _no_spans("ends").alias("ends"),
    )


def contaminated(share: int = 20) -> F.Column:
    """Whether hit words are at least one in ``share``."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
