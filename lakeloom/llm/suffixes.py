"""Repeated strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too. Two suffixes share that many bytes
exactly if their neighbours in suffix order do, so the suffixes are sorted, bucket by bucket.

1. Buckets. A suffix belongs to the bucket named by the least hash among the grams of its first ``LENGTH`` bytes, so suffixes
   that share them share a bucket. Suffixes in a row that take the same gram are a piece: its bytes serve them all.
2. Buckets that hold one piece in one place have nothing to compare and go. Equal pieces are sorted once, with their number; pieces of one
   shape in several places repeat as a whole. Only what is left has its bytes fetched.
3. A bucket with more than ``CROWD`` shapes is parted: its pieces become texts whose suffixes go to buckets by other
   hashes, in the end by the hash of all their bytes. Strings around a frequent line so spread over many buckets.
4. A task sorts its buckets one batch after another. Positions of a difference cover are ranked first: of any two suffixes,
   some pair of such positions lies at an equal distance of less than ``PERIOD`` bytes behind both. Suffixes are sorted by
   their first bytes up to there, and what ties goes by the ranks of that pair. Neighbours are compared in full.

A task holds one batch of buckets and their ranks. Bytes travel once per distinct open piece and, with their text, once to be cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import short_batches
from lakeloom.operators.joins import shuffled_again
from lakeloom.session import scratch_path

LENGTH = 200
# Bytes of a gram, for each time that crowded buckets are parted; the last one is the string as a whole.
GRAMS = (32, 32, 32)
# Buckets with more distinct pieces are parted.
CROWD = 512
# Bytes of text that are hashed at once, and bytes of pieces that are sorted at once.
HASHED_BYTES = 1_000_000
SORTED_BYTES = 1_500_000

# The powers of two modulo 73 differ by every number modulo 73.
PERIOD = 73
COVER = sorted({pow(2, i, PERIOD) for i in range(9)})

PIECES = "row long, doc_id long, body binary, starts array<int>, windows array<int>, buckets array<long>, pieces array<long>"
SPANS = "bucket long, piece long, spans array<struct<start: int, end: int>>"

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers."""
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def words_at(data: np.ndarray) -> np.ndarray:
    """For each byte the eight bytes from there on as a number that orders like them; behind the end are zeros."""
    words = data.astype(np.uint64)
    for step in (1, 2, 4):
        following = np.zeros_like(words)
        following[:-step] = words[step:]
        words = (words << _U(8 * step)) | following
    return words


def _least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each value and the ``width - 1`` behind it."""
    if width == 1:
        return values
    fill = np.full((-len(values)) % width + width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([values, fill]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(values)], before[width - 1 : len(values) + width - 1])


class Pieces:
    """Texts to pieces: where each starts, how many suffixes it serves, its bucket, and a hash of its bytes."""

    FACTOR = _U(0xD6E8FEB86659FD93)
    INVERSE = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

    def __init__(self, length: int, level: int):
        self.length, self.level = length, level
        self.gram = min(GRAMS[level], length) if level < len(GRAMS) else length
        self.factors = self.inverses = np.ones(1, np.uint64)

    def _powers(self, size: int) -> None:
        if len(self.factors) < size:
            self.factors, self.inverses = (np.cumprod(np.r_[_U(1), np.full(size, x)], dtype=np.uint64) for x in (self.FACTOR, self.INVERSE))

    def find(self, parts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each part (of ``length`` bytes at least): starts, numbers of suffixes, buckets and hashes of its pieces."""
        ends = np.cumsum([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
        n = len(data) - 8
        self._powers(n + self.gram)
        hashed = _mix(words_at(data) + _U(self.level))
        grams = hashed[:n].copy()
        # The last word of a gram may overlap the one before it.
        for i, offset in enumerate([*range(8, self.gram - 8, 8), self.gram - 8], 1):
            grams[: n - offset] += hashed[offset:n] * self.factors[i]
        grams = _mix(grams)
        # Of equal hashes the first place is taken; the bits below are enough for a place.
        keys = (grams >> _U(24) << _U(24)) | np.arange(n, dtype=np.uint64)
        chosen = (_least_of_windows(keys, self.length - self.gram + 1) & _U(0xFFFFFF)).astype(np.int64)
        part = np.repeat(np.arange(len(parts)), np.diff(np.r_[0, ends]))
        whole = np.arange(n) + self.length <= ends[part]
        marks = np.ones(n, bool)
        marks[1:] = (chosen[1:] != chosen[:-1]) | (part[1:] != part[:-1]) | (whole[1:] != whole[:-1])
        starts = np.flatnonzero(marks)
        windows = np.diff(np.r_[starts, n])
        starts, windows = starts[whole[starts]], windows[whole[starts]]
        sums = np.r_[_U(0), np.cumsum(hashed[:n] * self.factors[:n], dtype=np.uint64)]
        last = starts + windows + self.length - 8
        digest = _mix((sums[last] - sums[starts]) * self.inverses[starts] + windows.astype(np.uint64))
        first = np.r_[0, ends[:-1]]
        cuts = np.searchsorted(starts, np.r_[first, n])
        columns = (starts - first[part[starts]], windows, grams[chosen[starts]], digest)
        return [tuple(c[a:b] for c in columns) for a, b in zip(cuts, cuts[1:], strict=False)]


def _cut(length: int, level: int, hashed_bytes: int):
    """Rows of row, doc_id and body with the pieces of the body. Long texts are hashed part by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Pieces(length, level)
        for batch in batches:
            bodies = [body or b"" for body in batch[2].cast(pa.large_binary()).to_pylist()]
            found: list[list] = [[] for _ in bodies]
            held, owners, size = [], [], 0

            def hash_held(held=held, owners=owners, found=found) -> None:
                for (row, moved), (starts, *others) in zip(owners, finder.find(held), strict=True):
                    found[row].append((starts + moved, *others))
                held.clear()
                owners.clear()

            for row, body in enumerate(bodies):
                for at in range(0, len(body) - length + 1, hashed_bytes):
                    held.append(body[at : at + hashed_bytes + length - 1])
                    owners.append((row, at))
                    size += len(held[-1])
                    if size >= hashed_bytes:
                        hash_held()
                        size = 0
            if held:
                hash_held()
            counts = [sum(len(p[0]) for p in parts) for parts in found]
            ends = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
            kinds = (np.int32, np.int32, np.uint64, np.uint64)
            lists = [np.concatenate([np.zeros(0, kind), *(p[i] for parts in found for p in parts)]) for i, kind in enumerate(kinds)]
            lists = [x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int32) for x in lists]
            columns = [batch[0], batch[1], pa.array(bodies, pa.binary()), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "body", "starts", "windows", "buckets", "pieces"])

    return run


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


def by_words(at: np.ndarray, group: np.ndarray, words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered inside their groups by ``depth`` bytes, a multiple of eight, and where the group of equals starts.

    Only groups in which a word differs are sorted anew; positions that are alone are not looked at again.
    """
    order = np.lexsort((words[at], group))
    at = at[order]
    marks = _changed(group[order], words[at])
    start, live = _starts(marks), np.flatnonzero(_shared(marks))
    for offset in range(8, depth, 8):
        if not len(live):
            break
        word, of = words[at[live] + offset], start[live]
        first = _starts(_changed(of))
        differs = word != word[first]
        if not differs.any():
            continue
        mixed = np.zeros(len(live), bool)
        mixed[first[differs]] = True
        chosen = np.flatnonzero(mixed[first])
        order = chosen[np.lexsort((word[chosen], of[chosen]))]
        at[live[chosen]], word[chosen] = at[live[order]], word[order]
        marks = _changed(of, word)
        start[live] = of + _starts(marks) - first
        live = live[_shared(marks)]
    return at, start


def cover_shifts() -> np.ndarray:
    """For the residue of a position and the distance to another one: how far behind both lies a pair in the cover."""
    held = np.zeros(PERIOD, bool)
    held[COVER] = True
    shifts = np.arange(PERIOD)
    one = held[(np.arange(PERIOD)[:, None, None] + shifts) % PERIOD]
    two = held[(np.arange(PERIOD)[:, None, None] + np.arange(PERIOD)[None, :, None] + shifts) % PERIOD]
    return np.argmax(one & two, axis=2)


SHIFTS = cover_shifts()


def cover_ranks(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Ranks, by ``depth`` bytes, of the positions of the cover that suffixes starting at ``at`` may ask for."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + PERIOD, -1)
    asked = np.cumsum(change[:-1]) > 0
    held = np.zeros(PERIOD, bool)
    held[COVER] = True
    sample = np.flatnonzero(asked)
    sample = sample[held[sample % PERIOD]]
    ranks = np.zeros(len(words), np.int64)
    order, start = by_words(sample, np.zeros(len(sample), np.int64), words, depth)
    ranks[order] = start
    return ranks


def resolve_ties(at: np.ndarray, start: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Order the positions of each group of ties by the ranks of the cover.

    All groups are parted around a member each at once; those equal to it are done.
    """
    at, start = at.copy(), start.copy()
    live = np.flatnonzero(_shared(_changed(start)))
    if not len(live):
        return at
    ranks = cover_ranks(at[live], words, depth)
    while len(live):
        of = start[live]
        first = _starts(_changed(of))
        size = np.diff(np.r_[np.flatnonzero(_changed(of)), len(of)])
        middle = np.repeat(np.flatnonzero(_changed(of)) + size // 2, size)
        position, pivot = at[live], at[live][middle]
        shift = SHIFTS[pivot % PERIOD, (position - pivot) % PERIOD]
        side = np.sign(ranks[position + shift] - ranks[pivot + shift])
        order = np.lexsort((side, of))
        at[live], side = position[order], side[order]
        marks = _changed(of, side)
        start[live] = of + _starts(marks) - first
        live = live[_shared(marks) & (side != 0)]
    return at


def repeated_suffixes(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Of the positions ``at`` those whose ``length`` bytes start at another one of the same bucket, too."""
    # Behind the end are zeros; what lies behind the first bytes decides between equal strings only.
    words = words_at(np.r_[data, np.zeros(2 * (length + PERIOD) + 16, np.uint8)])
    first = PERIOD - 1
    at, start = by_words(at, bucket, words, first)
    shared = np.flatnonzero(_shared(_changed(start)))
    at, start = at[shared], _starts(_changed(start[shared]))
    at = resolve_ties(at, start, words, (length + 7) // 8 * 8)
    pairs = np.flatnonzero(start[1:] == start[:-1])
    for offset in [*range(first, length - 7, 8), length - 8]:
        pairs = pairs[words[at[pairs] + offset] == words[at[pairs + 1] + offset]]
    return np.unique(np.concatenate([at[pairs], at[pairs + 1]]))


def _sort(length: int, sorted_bytes: int):
    """Pieces, ordered by bucket, to the spans of their repeated strings."""

    def batch_of(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(p[2]) for p in held], np.int64)
        firsts = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        piece = np.repeat(np.arange(len(held)), windows)
        at = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows) + firsts[piece]
        names = np.array([p[0] for p in held], np.int64)
        found = repeated_suffixes(np.frombuffer(b"".join(p[2] for p in held), np.uint8), at, names[piece], length)
        of = np.searchsorted(firsts, found, side="right") - 1
        marks = np.ones(len(found), bool)
        marks[1:] = (found[1:] != found[:-1] + 1) | (of[1:] != of[:-1])
        begin, end = found[marks], found[np.r_[marks[1:], True]] if len(found) else found
        of = of[marks]
        rows, counts = np.unique(of, return_counts=True)
        spans = pa.StructArray.from_arrays([pa.array((x - firsts[of]).astype(np.int32)) for x in (begin, end + length)], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), spans)
        digests = np.array([p[1] for p in held], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names[rows]), pa.array(digests[rows]), lists], ["bucket", "piece", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= sorted_bytes and row[0] != held[-1][0]:
                    yield batch_of(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield batch_of(held)

    return run


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Let Spark delete the shuffle files of a query when it ends; what is used again is written as a table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A written table that takes little room."""
    path = scratch_path(df.sparkSession, name)
    with _shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _repeats(table: DataFrame, length: int, level: int, crowd: int, sorted_bytes: int, hashed_bytes: int) -> DataFrame:
    """``row, spans`` of the texts in a table of pieces: where they hold strings that start elsewhere, too."""
    places = table.select("row", F.explode(F.arrays_zip("starts", "windows", "buckets", "pieces")).alias("p"))
    places = places.select("row", F.col("p.starts").alias("start"), F.col("p.windows").alias("windows"), F.col("p.buckets").alias("bucket"), F.col("p.pieces").alias("piece"))
    live = places.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    places = _stored(places.join(shuffled_again(live, "bucket"), "bucket"), "places")
    shapes = places.groupBy("bucket", "piece").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "windows")).alias("one"))
    shapes = _stored(shapes, "shapes")
    kinds = shapes.groupBy("bucket").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest"))
    shapes = shapes.join(shuffled_again(kinds, "bucket"), "bucket")
    whole = F.array(F.struct(F.lit(0).alias("start"), (F.col("one.windows") + (length - 1)).alias("end")))
    found = shapes.where("n > 1").select("bucket", "piece", whole.alias("spans"))
    # Suffixes that are met in one place only are open; their buckets are sorted.
    asked = shapes.where("kinds > 1 and fewest = 1").groupBy("one.row").agg(
        F.collect_list(F.struct("bucket", "piece", "kinds", "one.start", "one.windows")).alias("asked")
    )
    opened = table.select("row", "body").join(asked, "row").select("body", F.explode("asked").alias("p"))
    opened = _stored(
        opened.select("p.bucket", "p.piece", "p.kinds", F.expr(f"substring(body, p.start + 1, p.windows + {length - 1})").alias("body")), "open-pieces"
    )
    last = level >= len(GRAMS)
    few = opened if last else opened.where(F.col("kinds") <= crowd)
    dealt = few.select("bucket", "piece", "body").repartition("bucket").sortWithinPartitions("bucket")
    parts = [dealt.mapInArrow(_sort(length, sorted_bytes), SPANS)]
    crowded = opened.where(F.col("kinds") > crowd)
    if not last and not crowded.isEmpty():
        named = crowded.select(F.monotonically_increasing_id().alias("row"), "bucket", "piece", "body")
        named = _stored(named, "crowded-pieces")
        cut = _stored(named.select("row", F.lit(None).cast("long").alias("doc_id"), "body").mapInArrow(_cut(length, level + 1, hashed_bytes), PIECES), "crowded-texts")
        inner = _repeats(cut, length, level + 1, crowd, sorted_bytes, hashed_bytes)
        parts.append(named.select("row", "bucket", "piece").join(inner, "row").select("bucket", "piece", "spans"))
    for part in parts:
        found = found.unionByName(part)
    # Equal pieces are listed by their number and by the sort: one list will do.
    found = _stored(found.groupBy("bucket", "piece").agg(F.flatten(F.collect_list("spans")).alias("spans")), "piece-spans")
    met = places.select("bucket", "piece", "row", "start").join(found, ["bucket", "piece"])
    moved = F.transform("spans", lambda s: F.struct((F.col("start") + s["start"]).alias("start"), (F.col("start") + s["end"]).alias("end")))
    met = met.select("row", F.explode(moved).alias("span")).groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    return _stored(met, "spans")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans that do not touch, from spans ordered by their starts."""
    out: list[list[int]] = []
    for span in spans:
        if out and span["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], span["end"])
        else:
            out.append([span["start"], span["end"]])
    return [tuple(s) for s in out]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, spans = [], []
        for body, found in zip(batch["body"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            gone = merged(found or [])
            spans.append([{"start": a, "end": b} for a, b in gone])
            edges = [0, *(x for span in gone for x in span), len(body)]
            kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if gone else body)
        sizes = pa.array([len(b) for b in batch["body"].to_pylist()], pa.int64())
        lists = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], sizes, lists, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    crowd: int = CROWD,
    sorted_bytes: int = SORTED_BYTES,
    hashed_bytes: int = HASHED_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (maximal removed runs, ends exclusive) and the kept bytes.

    A byte of the UTF-8 text is removed if it stands in a string of ``length`` bytes (73 or more) that also starts anywhere else, in
    this row or another. Repeated rows are copies of each other, so texts of ``length`` bytes or more vanish from all of them. Null counts as empty, an empty or
    shorter text keeps all of its bytes, a null id stays null. No rows give none. Other columns are not read. Kept bytes need
    not be UTF-8, since a span may part a letter.
    """
    if length < PERIOD:
        raise ValueError(f"strings must have {PERIOD} bytes or more")
    short_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    table = _stored(rows.mapInArrow(_cut(length, 0, hashed_bytes), PIECES), "pieces")
    spans = _repeats(table, length, 0, crowd, sorted_bytes, hashed_bytes)
    joined = table.select("row", "doc_id", "body").join(spans, "row", "left").select("doc_id", "body", "spans")
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
