"""Periodic runs of words: maximal pairs in LCP-interval trees.

A run is a stretch of words that equals itself moved by its period and that no neighbouring word extends. Its first
and second period start a maximal pair: equal words that differ to the left and to the right, at a distance of one period.
Run and pair are the same thing where the pair's words are at least as long as its distance, so no match is ever extended.

1. The texts of a chunk are laid out as one line of word numbers with a gap behind each. Suffixes are ordered by doubling;
   those that are alone leave, and so do all without a partner over the fewest words that a pair of a run can share.
2. Neighbours' common lengths follow from the ranks of each doubling, longest first.
3. The tree of LCP intervals is walked bottom-up. An interval holds the places of its words in text order, each in the class
   of its left word. Where two children meet, the smaller list is laid into the larger one, and each place is held against the
   places before and after it: of different classes and close enough, they are a maximal pair. A nearer place of
   the interval would be a shorter period of the same stretch, so places further away need no look.
4. A stretch that is found at several multiples of its period keeps the smallest.

A text is one row and its words are never parted; texts share no suffixes, so any number of copies costs each its own share.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import short_batches, texts

MIN_LENGTH = 24
MIN_EXPONENT = 3
# Words that are ordered together, besides those of the last text of a chunk.
CHUNK_WORDS = 300_000

FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"


def fewest_shared(min_length: int, min_exponent: int) -> int:
    """The fewest words that the pair of a run shares: its length less its period."""
    return min(max(min_length - p, (min_exponent - 1) * p) for p in range(1, max(min_length, 1) + 1))


def _starts(changed: np.ndarray) -> np.ndarray:
    """For each place in a sorted line, where its group starts; ``changed`` marks the first of each group."""
    return np.maximum.accumulate(np.where(changed, np.arange(len(changed)), 0))


def _changed(*keys: np.ndarray) -> np.ndarray:
    marks = np.ones(len(keys[0]), bool)
    marks[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return marks


def _shared(marks: np.ndarray) -> np.ndarray:
    """Places whose group has more than one member."""
    return ~marks | ~np.r_[marks[1:], True]


class Suffixes:
    """Suffixes of a line in order, those that share at least ``least`` words with another, and the common
    lengths of neighbours. ``line`` holds a number for each word; numbers of gaps and of different texts are never equal."""

    def __init__(self, line: np.ndarray, least: int):
        order = np.argsort(line, kind="stable")
        marks = _changed(line[order])
        rank = np.empty(len(line), np.int32)
        rank[order] = _starts(marks)
        alive = order[_shared(marks)]
        ranks, width, kept = [rank.copy()], 1, alive
        while len(alive):
            first, second = rank[alive], rank[alive + width]
            order = np.lexsort((second, first))
            alive, first, second = alive[order], first[order], second[order]
            marks = _changed(first, second)
            rank[alive] = first + _starts(marks) - _starts(_changed(first))
            alive = alive[_shared(marks)]
            width *= 2
            ranks.append(rank.copy())
            if width <= least:
                kept = alive
        self.places = kept[np.argsort(rank[kept])]
        one, two = self.places[:-1].copy(), self.places[1:].copy()
        for k in range(len(ranks) - 2, -1, -1):
            step = (ranks[k][one] == ranks[k][two]).astype(np.int64) << k
            one += step
            two += step
        self.common = one - self.places[:-1]


def maximal_pairs(places: list[int], common: list[int], left: list[int], least: int, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs, some of them again at multiples of their period.

    ``left`` has the class of each place: the number of the word before it.
    """
    found, times = [], min_exponent - 1

    def hold(first: int, second: int, shared: int) -> None:
        period = second - first
        if period * times <= shared and period + shared >= min_length and left[first] != left[second]:
            found.append((first, period + shared, period))

    def joined(one: list[int], two: list[int], shared: int) -> list[int]:
        """The list of an interval from those of two children."""
        if len(one) < len(two):
            one, two = two, one
        for place in two:
            at = bisect_left(one, place)
            if at < len(one):
                hold(place, one[at], shared)
            if at:
                hold(one[at - 1], place, shared)
        if len(two) * 8 > len(one):
            one += two
            one.sort()
        else:
            for place in two:
                insort(one, place)
        return one

    # Open intervals from the root down: common length and list of the children that are closed.
    depths, lists = [], []
    for place, shared in zip(places, [*common, 0][: len(places)], strict=True):
        closed = [place]
        while depths and depths[-1] > shared:
            closed = joined(lists.pop(), closed, depths.pop())
        if shared < least:
            continue
        if depths and depths[-1] == shared:
            lists[-1] = joined(lists[-1], closed, shared)
        else:
            depths.append(shared)
            lists.append(closed)
    return found


def find_runs(docs: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """For each list of words its runs as rows ``start, length, period``, ordered by start and period."""
    numbers: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for d in docs for w in d), np.int64, int(sizes.sum()))
    firsts = np.cumsum(sizes + 1) - sizes - 1
    line = np.full(int(sizes.sum()) + len(docs), -1, np.int64)
    owner = np.repeat(np.arange(len(docs)), sizes)
    line[np.arange(len(words)) + owner] = words
    left = np.r_[-1, line[:-1]]
    keys = line + np.repeat(np.arange(len(docs)), sizes + 1) * len(numbers)
    gaps = np.flatnonzero(line < 0)
    keys[gaps] = len(docs) * len(numbers) + np.arange(len(gaps))
    least = fewest_shared(min_length, min_exponent)
    suffixes = Suffixes(keys, least)
    places = suffixes.places
    # Lists by word number serve the walk, so only what it reads is turned into one.
    classes = dict(zip(places.tolist(), left[places].tolist(), strict=True))
    rows = maximal_pairs(places.tolist(), suffixes.common.tolist(), classes, least, min_length, min_exponent)
    runs = np.array(rows, np.int64).reshape(-1, 3)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[_changed(runs[:, 0], runs[:, 1])] if len(runs) else runs
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    of = np.searchsorted(firsts, runs[:, 0], side="right") - 1
    runs[:, 0] -= firsts[of]
    cuts = np.searchsorted(of, np.arange(len(docs) + 1))
    return [runs[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that stand in no run behind its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def _chunks(min_length: int, min_exponent: int, chunk_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, docs, size = [], [], 0

        def chunk() -> pa.RecordBatch:
            found = find_runs(docs, min_length, min_exponent)
            rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
            spans = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["start", "length", "period"])
            ends = pa.array(np.r_[0, np.cumsum([len(r) for r in found])], pa.int32())
            kept = [b" ".join(kept_words(d, r)) for d, r in zip(docs, found, strict=True)]
            columns = [pa.array(names, pa.int64()), pa.array([len(d) for d in docs], pa.int64()), pa.ListArray.from_arrays(ends, spans)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "text"])

        for batch in batches:
            for name, text in zip(batch[0].to_pylist(), texts(batch[1]), strict=True):
                names.append(name)
                docs.append(text.split())
                size += len(docs[-1])
                if size >= chunk_words:
                    yield chunk()
                    names, docs, size = [], [], 0
        if names:
            yield chunk()

    return run


def runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start and length in words, smallest period) and the collapsed text.

    Words are parted by ASCII white space. Runs have at least ``min_length`` words and ``min_exponent`` (2 or more) periods and
    are ordered by start and period. The collapsed text joins by one space the words that stand in no run behind its
    first period. Null and empty texts have no words and an empty collapsed text. Repeated rows give equal rows, a null id
    stays null, no rows give none. Other columns are not read.
    """
    if min_exponent < 2:
        raise ValueError("a run repeats its period at least once")
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_chunks(min_length, min_exponent, chunk_words), FOUND)
