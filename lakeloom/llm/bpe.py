"""Byte-level BPE by an index of pair occurrences.

The words of a chunk of texts are laid out once as one array of symbols, linked to their neighbours. An index
maps each rank to the positions where its pair stands. Active ranks are applied in ascending order, each to all
its positions at once, and only the lists of the pairs that arise beside a merge are updated. A pair's rank is
above the rank that made its parts, so this gives every word the merges it would get alone.

A word is merged once per task: its ids are kept until the store is full, then the store starts anew.
A chunk is closed by size, so a task holds a bounded part of its texts besides the longest one.

Nulls count as empty texts; an empty text has no ids. Repeated rows are encoded alike, an empty table
gives no rows, and columns other than the id and the text are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import short_batches

# Characters of text that are indexed together, and ids that are kept for words met again.
CHUNK_CHARS = 4_000_000
KEPT_IDS = 1_200_000
# Lists below this length are applied one position after another.
SHORT = 48


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The arrays of a tokenizer file: pair to rank and merged id, id to bytes, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = not spec["normalizer"] and before["type"] == "ByteLevel" and not before["add_prefix_space"]
        if model["type"] != "BPE" or not plain or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normalizer or prefix space is known")
        letters, ids = byte_letters(), model["vocab"]
        self.size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes = [b""] * self.size
        for token, number in ids.items():
            self.bytes[number] = bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, number in self.added.items():
            self.bytes[number] = content.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_ids[byte] = ids[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = self.left * self.size + self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.pairs = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.by_key[at], -1)


def _first_of_runs(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of pairs of one symbol with itself that overlap, every second one from the left."""
    starts = np.ones(len(at), bool)
    starts[1:] = following[:-1] != at[1:]
    run = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
    return (np.arange(len(at)) - run) % 2 == 0


class PairIndex:
    """Words as linked symbols, and for each active rank the positions where its pair may stand.

    Positions are entered when a pair arises and checked when its rank is applied. Long lists are applied as
    arrays, short ones one position after another.
    """

    def __init__(self, words: list[bytes], vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.symbol = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n, ends = len(self.symbol), np.cumsum(self.lengths)
        self.starts = ends - self.lengths
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.after[ends[self.lengths > 0] - 1] = -1
        self.before[self.starts[self.lengths > 0]] = -1
        self.long: dict[int, list[np.ndarray]] = {}
        self.short: dict[int, list[int]] = {}
        self.active: list[int] = []

    def _open(self, rank: int) -> list[int]:
        self.long[rank] = []
        heapq.heappush(self.active, rank)
        return self.short.setdefault(rank, [])

    def enter(self, at: np.ndarray) -> None:
        """Enter the pairs that start at these positions."""
        rank = self.vocabulary.ranks(self.symbol[at], self.symbol[self.after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(rank)) + 1, len(at)].tolist()
        for start, end, r in zip(cuts, cuts[1:], rank[cuts[:-1]].tolist(), strict=False):
            few = self.short[r] if r in self.short else self._open(r)
            if end - start < SHORT:
                few.extend(at[start:end].tolist())
            else:
                self.long[r].append(at[start:end])

    def _apply_long(self, rank: int, at: np.ndarray) -> None:
        v, symbol, after, before = self.vocabulary, self.symbol, self.after, self.before
        at = at[(symbol[at] == v.left[rank]) & (after[at] >= 0)]
        at = at[symbol[after[at]] == v.right[rank]]
        if v.left[rank] == v.right[rank]:
            at = at[_first_of_runs(at, after[at])]
        gone = after[at]
        symbol[at], symbol[gone] = v.merged[rank], -1
        after[at] = after[gone]
        follows = at[after[at] >= 0]
        before[after[follows]] = follows
        self.enter(np.unique(np.concatenate([before[at][before[at] >= 0], follows])))

    def apply(self) -> None:
        """Apply the active ranks in ascending order until none is left."""
        v, pairs = self.vocabulary, self.vocabulary.pairs
        symbol, after, before = map(memoryview, (self.symbol, self.after, self.before))
        short, size = self.short, v.size
        left, right, merged = v.left.tolist(), v.right.tolist(), v.merged.tolist()
        while self.active:
            rank = heapq.heappop(self.active)
            few, many = short.pop(rank), self.long.pop(rank)
            if many or len(few) >= SHORT:
                self._apply_long(rank, np.unique(np.concatenate([*many, np.array(few, np.int64)])))
                continue
            a, b, whole = left[rank], right[rank], merged[rank]
            for at in sorted(few):
                if symbol[at] != a or (gone := after[at]) < 0 or symbol[gone] != b:
                    continue
                symbol[at], symbol[gone] = whole, -1
                after[at] = follows = after[gone]
                if follows >= 0:
                    before[follows] = at
                    if (r := pairs.get(whole * size + symbol[follows])) is not None:
                        (short[r] if r in short else self._open(r)).append(at)
                if (first := before[at]) >= 0 and (r := pairs.get(symbol[first] * size + whole)) is not None:
                    (short[r] if r in short else self._open(r)).append(first)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of all words one after another, and their number for each word."""
        stays = self.symbol >= 0
        before = np.r_[0, np.cumsum(stays)]
        return self.symbol[stays].astype(np.int32), before[self.starts + self.lengths] - before[self.starts]


def merge_words(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and the number of ids of each."""
    index = PairIndex(words, vocabulary)
    index.enter(np.flatnonzero(index.after >= 0))
    index.apply()
    return index.ids()


def letter_kinds() -> np.ndarray:
    """For each character: 0 white space, 1 letter, 2 number, 3 any other."""
    everything = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    kinds = np.full(0x110000, 3, np.uint8)
    for kind, pattern in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for found in regex.finditer(pattern, everything):
            kinds[found.start() : found.end()] = kind
    return kinds


def word_starts(text: str, heads: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the words of joined texts start that begin at ``heads``: what the pattern WORD finds in each.

    A word is a run of one kind. The last white space before a word is parted from the run; a plain space goes
    to the word. An apostrophe that starts a word takes the letters of an English ending with it.
    """
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(letters)
    kind = kinds[letters]
    starts = np.ones(n + 4, bool)
    starts[1:n] = kind[1:] != kind[:-1]
    head = np.zeros(n + 4, bool)
    head[heads] = True
    head[n:] = True
    starts[head] = True
    words = np.flatnonzero((kind[1:] != 0) & (kind[:-1] == 0)) + 1
    words = words[~head[words]]
    starts[words - 1] = True
    starts[words[letters[words - 1] == 32]] = False
    quotes = np.flatnonzero(letters == 39)
    quotes = quotes[starts[quotes] & ~head[quotes + 1]]
    one = quotes[np.isin(letters[quotes + 1], [ord(c) for c in "stmd"])]
    starts[one + 1] = False
    starts[one + 2] = True
    quotes = quotes[~head[quotes + 2]]
    pair = letters[quotes + 1].astype(np.int64) << 32 | letters[quotes + 2]
    two = quotes[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
    starts[two + 1] = False
    starts[two + 3] = True
    return np.flatnonzero(starts[:n])


class Encoder:
    """Texts to ids, chunk by chunk."""

    def __init__(self, vocabulary: Vocabulary, kept_ids: int = KEPT_IDS):
        self.vocabulary, self.kept_ids, self.kinds = vocabulary, kept_ids, letter_kinds()
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.clear()

    def clear(self) -> None:
        self.slots: dict = {}
        self.ids = np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int64)

    def split(self, batch: list[str]) -> tuple[list, np.ndarray]:
        """The words of all texts and the number of each. An added token is a word of its own, put into a tuple."""
        joined = "".join(batch)
        if self.added is None or not self.added.search(joined):
            lengths = np.fromiter(map(len, batch), np.int64, len(batch))
            ends = np.cumsum(lengths)
            heads = (ends - lengths)[lengths > 0]
            starts = word_starts(joined, heads, self.kinds)
            cuts = starts.tolist() + [len(joined)]
            words = [joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            return words, np.searchsorted(starts, ends) - np.searchsorted(starts, ends - lengths)
        words, counts = [], []
        for text in batch:
            before = len(words)
            for i, piece in enumerate(self.added.split(text)):
                words.extend([(piece,)] if i % 2 else self.split_plain(piece))
            counts.append(len(words) - before)
        return words, np.array(counts, np.int64)

    def split_plain(self, text: str) -> list[str]:
        cuts = word_starts(text, np.zeros(min(len(text), 1), np.int64), self.kinds).tolist() + [len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, words: list) -> None:
        """Merge the words that are not known yet."""
        if len(self.ids) > self.kept_ids:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.slots]
        plain = [w for w in new if isinstance(w, str)]
        whole = [w for w in new if not isinstance(w, str)]
        ids, counts = merge_words([w.encode() for w in plain], self.vocabulary)
        first = len(self.slots)
        self.slots.update((w, first + i) for i, w in enumerate([*plain, *whole]))
        self.ids = np.r_[self.ids, ids, np.array([self.vocabulary.added[w[0]] for w in whole], np.int32)]
        self.counts = np.r_[self.counts, counts, np.ones(len(whole), np.int64)]

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of the texts."""
        words, number = self.split(batch)
        self.learn(words)
        slots = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        starts = np.cumsum(self.counts) - self.counts
        counts = self.counts[slots]
        ends = np.r_[0, np.cumsum(counts)]
        ids = self.ids[np.repeat(starts[slots] - ends[:-1], counts) + np.arange(ends[-1])]
        return ids, ends[np.r_[0, np.cumsum(number)]]


def encoded_chunks(
    batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, chunk_chars: int
) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Of batches of id and text: the ids of the rows of a chunk, all their token ids, and the n + 1 offsets.

    A chunk runs over as many batches as it takes to fill it, so the index is laid out for many texts at once.
    """
    encoder = Encoder(vocabulary)
    names, texts, size = [], [], 0
    for batch in batches:
        for name, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
            names.append(name)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= chunk_chars:
                yield names, *encoder.encode(texts)
                names, texts, size = [], [], 0
    if names:
        yield names, *encoder.encode(texts)


def _encode_batches(vocabulary: Vocabulary, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, ids, offsets in encoded_chunks(batches, vocabulary, chunk_chars):
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), lists], ["doc_id", "ids"])

    return run


def encode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """One row per text: ``doc_id`` and ``ids`` (array of int), as the vocabulary file at ``path`` has them."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode_batches(Vocabulary(path), chunk_chars), "doc_id long, ids array<int>")


def decode_ids(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
    return b"".join(map(vocabulary.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _decode_batches(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (decode_ids(ids.as_py() or [], vocabulary) for ids in batch[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` with the decoded ``text``. Null ids count as none."""
    schema = "doc_id long, ids array<int>, text string"
    return encoded.select("doc_id", "ids").mapInArrow(_decode_batches(Vocabulary(path)), schema)
