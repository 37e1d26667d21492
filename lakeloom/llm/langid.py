"""Language identification by prediction with partial matching over byte context trees.

Each language has a tree of contexts of up to ``ORDER`` bytes with counts of the bytes that follow. The statistics are frozen:
a byte's probability is taken at the longest context known to the language, and where the byte was never seen there,
an escape is paid (distinct followers against all, method C) and the next shorter context is asked, down to all bytes alike. The
sum of the negative logarithms is the exact length of the text's code, and the language with the shortest code wins.

The trees are learned from the whole texts of a bounded sample of labelled rows (``SAMPLE_ROWS`` rows per language); counting is
a Spark job, and grams seen fewer than ``LEAST_COUNT`` times are cut from the deepest level. Scoring reads whole texts. The nodes of all trees are numbered together level by level, so a batch of texts walks down all trees
at once: one table lookup per byte and level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lakeloom.llm.common import draw_bound, short_batches, utf8, written

# Bytes of context.
ORDER = 4
SAMPLE_ROWS = 1000
# Grams of full depth below this count are left to the shorter contexts.
LEAST_COUNT = 2
# Bytes that are scored at once.
CHUNK = 1_000_000
UNKNOWN = "und"


@dataclass
class Model:
    """Code lengths in bits. ``grams[n]``: sorted grams of n + 1 bytes; ``cost[n]``: their bits per language in a context of n bytes,
    NaN where that language has not seen them; ``escape[n]``: bits to leave a context of n bytes, 0 where the language lacks the context."""

    languages: list[str]
    grams: list[np.ndarray]
    cost: list[np.ndarray]
    escape: list[np.ndarray]

    @property
    def order(self) -> int:
        return len(self.grams) - 1


def _gram_values(data: np.ndarray, size: int) -> np.ndarray:
    """Every run of ``size`` bytes as one integer, first byte highest."""
    values = np.zeros(max(len(data) - size + 1, 0), np.int64)
    for i in range(size):
        values = values << 8 | data[i : i + len(values)]
    return values


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _count_grams(order: int):
    """Counts of grams per language and batch. Grams never reach over two texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            data, offsets = _lower(data), offsets.tolist()
            languages = batch["lang"].to_pylist()
            for language in sorted(set(languages)):
                parts = [data[a:b] for a, b, x in zip(offsets, offsets[1:], languages, strict=False) if x == language]
                for size in range(1, order + 2):
                    grams, counts = np.unique(np.concatenate([_gram_values(p, size) for p in parts]), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([language] * len(grams), pa.string()), pa.array(np.full(len(grams), size, np.int32)), pa.array(grams), pa.array(counts.astype(np.int64))],
                        ["lang", "size", "gram", "n"],
                    )

    return run


def sample(labelled: DataFrame, rows: int) -> DataFrame:
    """At most about ``rows`` distinct texts of each language, drawn by a hash of the text: ``lang, text``. Copies count once."""
    known = labelled.where("lang is not null").select("lang", F.coalesce("text", F.lit("")).alias("text"))
    known = known.withColumn("draw", F.xxhash64(F.lit(7), "text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count_distinct("draw").alias("n")).collect()}
    if not counts:
        return known.select("lang", "text")
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, draw_bound(rows, n))])
    return known.where(F.col("draw") <= share[F.col("lang")].cast("long")).select("lang", "text").distinct()


def learn(labelled: DataFrame, order: int = ORDER, rows: int = SAMPLE_ROWS, least: int = LEAST_COUNT) -> Model:
    """Frozen trees from ``lang, text`` rows; rows without a language are ignored. The counts that come to the driver are
    those of the sample's distinct grams: for each language and level no more than ``rows`` times the bytes of its longest sampled
    text, and no more than 256 to the power of the level."""
    short_batches(labelled.sparkSession)
    counted = sample(labelled, rows).mapInArrow(_count_grams(order), "lang string, size int, gram long, n long")
    counted = counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    table = counted.where((F.col("n") >= least) | (F.col("size") <= order)).toArrow()
    lang, size, gram, n = (table[c].to_numpy() for c in ("lang", "size", "gram", "n"))
    languages = sorted(set(lang.tolist()))
    which = np.searchsorted(np.array(languages, dtype=object), lang) if languages else np.zeros(0, np.int64)
    model = Model(languages, [], [], [])
    for level in range(order + 1):
        here = size == level + 1
        grams = np.unique(gram[here])
        seen = np.zeros((len(grams), len(languages)))
        seen[np.searchsorted(grams, gram[here]), which[here]] = n[here]
        contexts, of = np.unique(grams >> 8, return_inverse=True)
        total, kinds = (np.zeros((len(contexts), len(languages))) for _ in range(2))
        np.add.at(total, of, seen)
        np.add.at(kinds, of, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            whole = total + kinds
            bits = np.where(seen > 0, np.log2(whole[of] / seen), np.nan)
            leave = np.where(total > 0, np.log2(whole / kinds), 0.0)
        if level:
            # A context is a gram of the level above; contexts that were never followed cost nothing to leave.
            padded = np.zeros((len(model.grams[-1]), len(languages)))
            padded[np.searchsorted(model.grams[-1], contexts)] = leave
            leave = padded
        model.grams.append(grams)
        model.cost.append(bits.astype(np.float32))
        model.escape.append(leave.astype(np.float32))
    return model


class Trees:
    """The model with its grams numbered for lookups: a gram is found from the number of its first bytes and its last byte.

    The code length of a gram that any language has seen is worked out once for all of them, escapes included. Per byte there
    remain one lookup per level and one sum; only for a gram no language has seen are escapes paid byte by byte.
    """

    def __init__(self, model: Model):
        self.model = model
        letters = model.grams[0].astype(np.int64)
        self.kinds = len(letters) + 1
        self.kind = np.full(256, len(letters), np.int32)
        self.kind[letters] = np.arange(len(letters))
        self.tables, self.whole = [], []
        none = np.zeros((1, len(model.languages)), np.float32)
        self.leave = [np.concatenate([e, none]) for e in model.escape]
        for level, grams in enumerate(model.grams):
            above = model.grams[level - 1] if level else np.zeros(1, np.int64)
            parent = np.searchsorted(above, grams >> 8)
            # The last row is for first bytes that are not known.
            table = np.full((len(above) + 1) * self.kinds, len(grams), np.int32)
            table[parent * self.kinds + self.kind[grams & 255]] = np.arange(len(grams))
            self.tables.append(table)
            if level:
                shorter = np.searchsorted(above, grams & ((1 << 8 * level) - 1))
                otherwise = self.leave[level][parent] + self.whole[-1][shorter]
            else:
                otherwise = self.leave[0][:1] + np.float32(8)
            bits = np.where(np.isnan(model.cost[level]), otherwise, model.cost[level])
            self.whole.append(np.concatenate([bits, none]).astype(np.float32))

    def bits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each byte (rows) in each language (columns). ``starts``: where texts begin; a text's first bytes have the contexts there are."""
        order, kind = self.model.order, self.kind[data]
        unknown = [len(g) for g in self.model.grams]
        numbers = [self.tables[0][kind]]
        for level in range(1, order + 1):
            row = np.empty(len(data), np.int32)
            row[1:] = numbers[-1][:-1]
            row[:1] = row[starts] = unknown[level - 1]
            numbers.append(np.take(self.tables[level], row * self.kinds + kind))
        out = np.take(self.whole[order], numbers[order], axis=0)
        at_start = np.zeros(len(data), bool)
        at_start[:1] = at_start[starts] = True
        rest = np.flatnonzero(numbers[order] == unknown[order])
        for level in range(order, 0, -1):
            context = np.where(at_start[rest], unknown[level - 1], numbers[level - 1][rest - 1])
            shorter = numbers[level - 1][rest]
            out[rest] += self.leave[level][context] + self.whole[level - 1][shorter]
            rest = rest[shorter == unknown[level - 1]]
        out[rest] += self.leave[0][:1] + np.float32(8)
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language. Texts lie one after another; they are read in pieces, each with the bytes
        before it that are its context."""
        total = np.zeros((len(offsets) - 1, len(self.model.languages)))
        filled = np.flatnonzero(np.diff(offsets))
        begins = offsets[filled]
        for at in range(0, len(data), CHUNK):
            lead = min(at, self.model.order)
            low, high = np.searchsorted(begins, [at - lead, at + CHUNK])
            bits = self.bits(data[at - lead : at + CHUNK], begins[low:high] - (at - lead))[lead:]
            # The text that runs into this piece, and those that begin in it.
            here = np.arange(max(np.searchsorted(begins, at, side="right") - 1, 0), high)
            cuts = np.maximum(begins[here] - at, 0)
            total[filled[here]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)
        return total


# Letters: anything that is neither space, digit, ASCII sign nor control.
_LETTER = r"\p{L}"


def predict(text: F.Column, model: Model) -> F.Column:
    """A struct of ``lang``, ``score`` and ``bits`` (per byte, in the language that wins).

    ``score`` is that language's share when each code of L bits has weight 2^-L: near 1 where one language is far ahead.
    A null text, an empty one or one without any letter is ``und`` with score 0, and so is every text if no language was
    learned. Equal code lengths go to the first language by name.
    """
    trees = Trees(model)

    @arrow_udf("struct<lang string, score double, bits double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            data, offsets = utf8(batch)
            bits = trees.lengths(_lower(data), offsets)
            if model.languages:
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), best]
                score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                names = np.array(model.languages, dtype=object)[best]
            else:
                names, score, least = np.full(len(bits), UNKNOWN, object), np.zeros(len(bits)), np.zeros(len(bits))
            per_byte = least / np.maximum(np.diff(offsets), 1)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(per_byte)], ["lang", "score", "bits"])

    readable = F.coalesce(text.rlike(_LETTER), F.lit(False))
    found = run(text)
    return F.struct(
        F.when(readable, found["lang"]).otherwise(UNKNOWN).alias("lang"),
        F.when(readable, found["score"]).otherwise(0.0).alias("score"),
        F.when(readable, found["bits"]).otherwise(0.0).alias("bits"),
    )


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, bits. Other columns are not read; repeated rows get equal answers."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), predict(F.col(text_col), model).alias("p"))
    return rows.select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.bits").alias("bits"))


def kept_for_learning(docs: DataFrame, id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """The rows whose fold (CRC-32 of the id as text) is not 0."""
    return docs.where(~held_out(F.col(id_col), folds))


def held_out(name: F.Column, folds: int = 5, fold: int = 0) -> F.Column:
    """Whether a row is in the fold that is left out of learning. A null id counts as the empty text."""
    text = F.coalesce(name.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold
