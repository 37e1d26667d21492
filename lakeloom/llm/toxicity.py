"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of lexicon words (a fixed list, and one learned from labels), how close they stand to a word of
second person, and rates of capitals, punctuation and obfuscation. Only the text goes in.

Learning uses a bounded sample of the labelled rows (``SAMPLE_ROWS``, drawn by a hash). Near copies in it count once: of rows whose
least shingle hash is equal, one stays, so a copied toxic text does not make its chance words toxic. The learned lexicon holds
words and word beginnings that are far more frequent in toxic rows. The trees are Spark's; their scores on rows left out of
training are what the calibration is fitted to.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lakeloom.llm.common import draw_bound, short_batches, utf8, written

# Labelled rows that are learned from, at most about.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
# A learned entry stands in this many toxic rows at least, and is this many times as frequent in them.
LEAST_ROWS = 8
LEAST_ODDS = 12.0
LEXICON_SIZE = 4000
STEMS = (4, 5, 6)
NEAR = 5

# Insults that count without being learned, and words of second person in the four languages.
INSULTS = frozenset(
    """
    idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile cretin fool fools loser losers pathetic worthless
    scum trash garbage clown clowns disgusting filthy vermin parasite parasites coward cowards liar liars bastard bastards
    bitch bitches asshole assholes dickhead jerk jerks creep creeps freak freaks pig pigs rat rats subhuman savage savages
    retard retarded whore slut crap shit bullshit fuck fucking fucker damn hate kill die ugly fat lazy useless hopeless
    idiota idiotas imbecil estupido estupida tonto tonta basura asqueroso inutil mierda puta cabron pendejo payaso
    imbécil estúpido estúpida inútil cabrón
    idiote idiotes imbécile crétin crétine stupide débile ordure ordures salaud salope connard connasse merde pute minable nul
    dummkopf idioten blöd blödmann trottel arschloch scheiße abschaum dreck müll versager widerlich schwein schlampe hure
    """.split()
)
SECOND_PERSON = frozenset(
    """
    you your yours yourself yourselves u ur youre thou thy
    tu te toi ton ta tes vous votre vos
    du dich dir dein deine deinen deiner ihr euch euer eure
    tú ti tus usted ustedes vosotros vuestro vuestra
    """.split()
)
# Signs that stand for a letter.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "|": "l"})

# A token may hold signs between its letters, or be spelled out with dots.
TOKEN = re.compile(r"(?:[^\W_]\.){2,}[^\W_]|[^\W_]+(?:[@$!*#_'-]+[^\W_]+)*")
PLAIN = re.compile(r"[^\W\d_]+")

FEATURES = [
    "log_words", "insults", "insult_density", "learned", "learned_density", "learned_weight", "near_person", "person_density",
    "closest", "hidden", "hidden_density", "capitals", "exclamations", "questions", "signs", "runs", "digits", "mixed",
]


@dataclass
class Lexicon:
    """Learned entries: whole words, and beginnings of words by length, each with its logarithm of odds."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[int, dict[str, float]] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for size, stems in self.stems.items():
            if len(word) >= size:
                best = max(best, stems.get(word[:size], 0.0))
        return best


def plain_form(token: str) -> str:
    """A token without the signs that hide a word: ``1d-i0t`` is ``idiot``, ``stuuupid`` is ``stupid``."""
    letters = "".join(c for c in token.translate(LEET) if c.isalpha())
    return re.sub(r"(.)\1{2,}", r"\1", letters)


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    for kind, letters in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!", b"?", b"*@$#%&|", b"0123456789", b"abcdefghijklmnopqrstuvwxyz"), 1):
        kinds[list(letters)] = kind
    kinds[0x80:] = 6
    return kinds


def _byte_rates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts per text: capitals, exclamation marks, question marks, signs, digits, letters, runs of marks, digits or signs inside words."""
    kinds = _kinds()[data]
    starts = offsets[:-1]

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return sums[offsets[1:]] - sums[starts]

    letter = (kinds == 1) | (kinds == 6)
    odd = (kinds == 4) | (kinds == 5) | (kinds == 2)
    mixed = np.zeros(len(data), bool)
    mixed[1:-1] = odd[1:-1] & letter[:-2] & letter[2:]
    run = np.zeros(len(data), bool)
    run[1:] = (kinds[1:] == kinds[:-1]) & ((kinds[1:] == 2) | (kinds[1:] == 3))
    # The texts lie one behind another: the first and last byte of one has no neighbour in the next.
    full = offsets[1:] > starts
    run[starts[full]] = mixed[starts[full]] = mixed[offsets[1:][full] - 1] = False
    counts = [per_text(kinds == k) for k in range(1, 7)]
    return np.stack([*counts, per_text(run), per_text(mixed)], axis=1).astype(np.float64)


def features(column: pa.Array, lexicon: Lexicon, known: dict[str, tuple[float, float, float, bool]]) -> np.ndarray:
    """The features of each text, in the order of FEATURES. ``known``: what was found for each token so far."""
    counts = _byte_rates(*utf8(column))
    rows = np.zeros((len(column), len(FEATURES)))
    for i, text in enumerate(column.to_pylist()):
        tokens = TOKEN.findall((text or "").lower())
        n = max(len(tokens), 1)
        for token in set(tokens):
            if token not in known:
                shown = PLAIN.fullmatch(token) is not None
                word = token if shown else plain_form(token)
                insult = 1.0 if word in INSULTS else 0.0
                weight = lexicon.weight(word)
                known[token] = (insult, weight, 0.0 if shown else max(insult, weight > 0), token in SECOND_PERSON)
        hits, persons, insults, learned, weight, hidden = [], [], 0.0, 0, 0.0, 0.0
        for at, token in enumerate(tokens):
            insult, heavy, veiled, person = known[token]
            if person:
                persons.append(at)
            if insult or heavy:
                hits.append(at)
                insults += insult
                learned += heavy > 0
                weight += heavy
                hidden += veiled
        near, closest = 0, 0.0
        if hits and persons:
            spots = np.array(persons)
            after = np.searchsorted(spots, hits)
            gap = np.minimum(
                np.where(after < len(spots), spots[np.minimum(after, len(spots) - 1)] - hits, n),
                np.where(after > 0, np.array(hits) - spots[np.maximum(after - 1, 0)], n),
            )
            near, closest = int((gap <= NEAR).sum()), 1 / (1 + float(gap.min()))
        capitals, marks, asks, signs, digits, small, run, mixed = counts[i]
        size = max(len(text or ""), 1)
        rows[i] = [
            np.log1p(len(tokens)), min(insults, 20), insults / n, min(learned, 20), learned / n, weight / n, min(near, 20), len(persons) / n,
            closest, min(hidden, 20), hidden / n, capitals / max(capitals + small, 1), marks / size, asks / size, signs / size, run / size, digits / size, mixed / n,
        ]
    return rows


def feature_column(text: F.Column, lexicon: Lexicon) -> F.Column:
    """The features of a text column as an array of doubles. A null text has those of an empty one."""

    @arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict = {}
        for batch in batches:
            rows = features(batch, lexicon, known)
            if len(known) > 400_000:
                known.clear()
            offsets = np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))

    return run(text)


def copy_key(text: F.Column) -> F.Column:
    """The least hash of the five-word shingles of a text: near copies mostly share it."""

    @arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            keys = []
            for text in batch.to_pylist():
                words = (text or "").lower().encode().split()
                shingles = map(b" ".join, zip(*[words[i:] for i in range(5)], strict=False)) if len(words) > 5 else [b" ".join(words)]
                keys.append(min(map(digest, shingles)) >> 1)
            yield pa.array(keys, pa.int64())

    return run(text)


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word and beginning: toxic and other rows that hold it, per batch."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            words = set(PLAIN.findall((text or "").lower()))
            entries = {f"0{w}" for w in words}
            for size in STEMS:
                entries.update(f"{size}{w[:size]}" for w in words if len(w) >= size)
            counts[toxic].update(entries)
        entries = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(entries, pa.string()), *(pa.array([c[e] for e in entries], pa.int64()) for c in (counts[1], counts[0]))],
            ["entry", "toxic", "other"],
        )


def learn_lexicon(rows: DataFrame, least_rows: int = LEAST_ROWS, least_odds: float = LEAST_ODDS, size: int = LEXICON_SIZE) -> Lexicon:
    """Entries of ``text, toxic`` rows; at most ``size`` come to the driver, those in most toxic rows first."""
    total = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = rows.select("text", "toxic").mapInArrow(_count_entries, "entry string, toxic long, other long")
    counts = counts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = ((F.col("toxic") + 0.5) / (total.get(1, 0) + 1)) / ((F.col("other") + 0.5) / (total.get(0, 0) + 1))
    counts = counts.where(F.col("toxic") >= least_rows).withColumn("odds", odds).where(F.col("odds") >= least_odds)
    lexicon = Lexicon(stems={s: {} for s in STEMS})
    for row in counts.orderBy(F.desc("toxic"), "entry").limit(size).collect():
        kind, entry = int(row.entry[0]), row.entry[1:]
        (lexicon.stems[kind] if kind else lexicon.words)[entry] = float(np.log(row.odds))
    return lexicon


@dataclass
class Model:
    """``trees`` and ``scale`` are None where the sample had one class only; then every text scores ``share``."""

    lexicon: Lexicon
    trees: object
    scale: object
    share: float


def _trees(rows: DataFrame, seed: int):
    return GBTClassifier(featuresCol="x", labelCol="label", maxIter=15, maxDepth=3, stepSize=0.3, seed=seed, maxBins=64).fit(rows)


def _raw(rows: DataFrame, trees, name: str) -> DataFrame:
    """The trees' probability of label 1 as column ``name``."""
    own = trees.copy().setProbabilityCol(f"{name}_p").setRawPredictionCol(f"{name}_r").setPredictionCol(f"{name}_l")
    rows = own.transform(rows)
    return rows.withColumn(name, vector_to_array(f"{name}_p")[1]).drop(f"{name}_p", f"{name}_r", f"{name}_l")


def learn(labelled: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 11) -> Model:
    """A model from ``text, toxic`` rows. Rows without a label are ignored; a null text counts as empty."""
    spark = labelled.sparkSession
    short_batches(spark)
    known = labelled.where("toxic in (0, 1)").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    # Of copies the least text stays, whatever the partitions are.
    once = known.withColumn("key", copy_key(F.col("text"))).groupBy("key", "toxic").agg(F.min("text").alias("text"))
    sampled = written(once.select("text", "toxic"), "toxicity-sample")
    total = {r.toxic: r.n for r in sampled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = total.get(1, 0) / max(sum(total.values()), 1)
    lexicon = learn_lexicon(sampled)
    if len(total) < 2:
        return Model(lexicon, None, None, share)
    vectors = sampled.select(
        array_to_vector(feature_column(F.col("text"), lexicon)).alias("x"),
        F.col("toxic").cast("double").alias("label"),
        F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(2)).alias("fold"),
    )
    # The sample is bounded, and so are its features: in one order, sums and splits do not depend on partitions.
    vectors = vectors.select(vector_to_array("x").alias("x"), "label", "fold").repartition(1).sortWithinPartitions("label", "x", "fold")
    vectors = written(vectors, "toxicity-features")
    vectors = vectors.withColumn("x", array_to_vector("x"))
    # Each half is scored by trees of the other one.
    halves = [vectors.where(F.col("fold") == i) for i in (0, 1)]
    parts = []
    for learned_from, scored in (halves, halves[::-1]):
        if learned_from.select("label").distinct().count() == 2:
            parts.append(_raw(scored, _trees(learned_from, seed), "raw").select("raw", "label"))
    trees = _trees(vectors, seed)
    if not parts:
        parts = [_raw(vectors, trees, "raw").select("raw", "label")]
    fitted = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    scale = IsotonicRegression(featuresCol="raw", labelCol="label").fit(fitted)
    return Model(lexicon, trees, scale, share)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``text, toxic`` of at most about ``rows`` labelled documents, drawn by a hash of the id; ids that are labelled twice
    with different labels take the larger one. The sample's ids are few enough to go to all tasks."""
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    marks = marks.groupBy(F.col(id_col).cast("long").alias("mark_id")).agg(F.max(label_col).alias("toxic"))
    held = marks.count()
    marks = marks.where(F.xxhash64(F.lit(3), "mark_id") <= draw_bound(rows, held))
    texts = docs.select(F.col(id_col).cast("long").alias("mark_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(marks), "mark_id").select("text", "toxic")


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns and rows of ``docs`` and a score from 0 to 1 (higher: label 1 likelier) under a name of your choice.

    Null and empty texts get the score of a text without words. Repeated rows get equal scores; no rows give none.
    """
    short_batches(docs.sparkSession)
    if model.trees is None:
        return docs.withColumn(name, F.lit(model.share))
    own = f"{name}_features"
    while own in docs.columns:
        own += "_"
    rows = docs.withColumn(own, array_to_vector(feature_column(F.col(text_col), model.lexicon)))
    rows = _raw(rows, model.trees.copy().setFeaturesCol(own), f"{own}_raw").drop(own)
    rows = model.scale.copy().setFeaturesCol(f"{own}_raw").setPredictionCol(name).transform(rows)
    return rows.withColumn(name, F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(1.0))).drop(f"{own}_raw")


def held_out(name: F.Column, folds: int = 4, fold: int = 2) -> F.Column:
    """Whether a row is in the fold that is left out of learning (CRC-32 of the id as text). A null id counts as the empty text."""
    return F.crc32(F.coalesce(name.cast("string"), F.lit("")).cast("binary")) % folds == fold
