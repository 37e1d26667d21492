"""Proportional stratified interleaving: shards of equal counts, each with the mixture of the whole.

Rows of each stratum are shuffled by a seeded hash and ranked. Rank r of n (from 0) gets the fraction
(r + u) / n, where u is the stratum's own seeded offset between 0 and 1, so the fractions of every stratum are spread
evenly over 0 to 1, and those of many small strata as well. All rows are then
ordered by fraction and cut into shards: any stretch of that order holds each stratum in proportion.

Ranks are taken without gathering a stratum: rows are first counted per (stratum, bucket of the hash),
a running sum over the buckets gives each bucket its first rank, and only rows of one bucket are
ordered together. The order by fraction is numbered the same way; fractions are even by construction,
so a stratum that holds a third of all rows fills no bucket more than its share.

Nulls: a null text counts as empty, null strata are one stratum of their own, a null id is hashed as the
empty string. The hash takes the text's CRC and size in, so rows that share an id, or have none, are spread like others.
Repeated rows each get their own slot; which of two equal rows comes first does not show.
An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import written
from lakeloom.operators.joins import shuffled_again

# Bits of the hash that are used; buckets per stratum and over all rows, at least, and rows of a bucket, at most about.
HASH_BITS = 60
BUCKETS = 4096
BUCKET_ROWS = 250_000
# Added to the bytes of each text.
ROW_BYTES = 16


def _hash(text: F.Column) -> F.Column:
    """The first 60 bits of an MD5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _numbered(rows: DataFrame, group: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """Number rows from 0 in the order of bucket, then ``order``; and count them, per group."""
    keys = [*group, bucket]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    counts = counts.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        (F.sum("_n").over(over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_first"),
        F.sum("_n").over(over).alias(f"{name}_of"),
    )
    counts = shuffled_again(counts, f"_{bucket}")
    within = Window.partitionBy(*keys).orderBy(*order)
    joined = rows.join(counts, [F.col(k) == F.col(f"_{k}") for k in keys])
    number = F.col("_first") + F.row_number().over(within) - 1
    return joined.withColumn(name, number).drop("_first", *[f"_{k}" for k in keys])


def interleave(
    docs: DataFrame,
    shards: int = 40,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "source",
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    Counts of shards are at most one apart (law ``rows``); slots run from 0 without gaps.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    stratum = F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        stratum.alias("stratum"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"),
    )
    drawn = _hash(F.concat_ws(":", F.lit(str(seed)), "name", "text_crc32", "size"))
    mixed = _hash(F.concat(F.lit(f"{seed}|"), F.col("stratum")))
    rows = written(rows.withColumns({"drawn": drawn, "mixed": mixed}).drop("name"), "shard-rows")
    # A power of two, so that a bucket is a stretch of the hashes.
    buckets = 1 << (max(buckets, -(-rows.count() // BUCKET_ROWS)) - 1).bit_length()
    rows = rows.withColumn("part", F.shiftright("drawn", HASH_BITS - buckets.bit_length() + 1))
    tie = ["doc_id", "text_crc32", "size"]
    ranked = _numbered(rows, ["stratum"], "part", ["drawn", *tie], "rank")
    fraction = (F.col("rank") + F.col("mixed") / F.lit(float(1 << HASH_BITS))) / F.col("rank_of")
    ranked = ranked.drop("part").withColumn("fraction", fraction)
    ranked = ranked.withColumn("band", F.floor(F.col("fraction") * buckets))
    ranked = written(ranked, "shard-ranks")
    placed = _numbered(ranked, [], "band", ["fraction", "mixed", "stratum", "drawn", *tie], "place")
    placed = placed.withColumn("shard", F.expr(f"int(place * {shards} div place_of)"))
    first = F.expr(f"(shard * place_of + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("place") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("stratum"),
    )
