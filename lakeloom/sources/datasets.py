"""Plain Parquet folders: append, overwrite, replace partitions, upsert.

Spark writes and reads the folders; nothing but the declared schema is kept beside the data. A folder without
partition fields has one sub-folder per load (``_batch=name``): a load that is run again replaces its own. A folder
with partition fields has their values as sub-folders, replaced by Spark's dynamic partition overwrite. Atomic
commits, history and file maintenance are a table format's work in the catalog and not rebuilt here.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakeloom.functions.clean import dedupe_latest
from lakeloom.operators.joins import shuffled_again
from lakeloom.session import materialize, scratch_path
from lakeloom.sources.layout import TIME_FORMATS, PartitionField, align, folders_for, merged_schema, with_partitions
from lakeloom.sources.scan import in_partition, key_range, scan

BATCH = "_batch"


def _nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields])


class Dataset:
    def __init__(self, spark: SparkSession, path: str, partition_by: Sequence[PartitionField] = ()):
        self.spark = spark
        self.path = path.rstrip("/")
        self.partition_by = list(partition_by)

    # --- reading -----------------------------------------------------------

    def schema(self) -> StructType | None:
        """The declared schema of the data, or none if nothing was written yet."""
        try:
            row = self.spark.read.text(f"{self.path}/_schema", wholetext=True).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return StructType.fromJson(json.loads(row.value)) if row else None

    def exists(self) -> bool:
        return self.schema() is not None

    @property
    def folders(self) -> list[str]:
        return [f.name for f in self.partition_by] or [BATCH]

    def rows(self) -> DataFrame:
        """All rows with the columns that name their folders."""
        schema = self.schema()
        if schema is None:
            raise ValueError(f"{self.path} does not exist")
        own = [StructField(name, StringType()) for name in self.folders]
        return self.spark.read.schema(StructType(schema.fields + own)).parquet(self.path)

    def scan(
        self,
        columns: Sequence[str] | None = None,
        row_filter: str | None = None,
        limit: int | None = None,
        partition_key: str | None = None,
    ) -> DataFrame:
        rows = self.rows()
        if partition_key is not None:
            rows = self._prune(rows, partition_key)
        if row_filter is not None:
            for folders in folders_for(row_filter, self.partition_by, rows.schema):
                rows = rows.where(folders)
        return scan(rows.drop(*self.folders), columns, row_filter, limit)

    def _prune(self, rows: DataFrame, key: str) -> DataFrame:
        """The key's range on the time column, plus the folders that can hold it."""
        start, end = key_range(key)
        for field in self.partition_by:
            if field.transform in TIME_FORMATS:
                width = {"year": 4, "month": 7, "day": 10, "hour": 13}[field.transform]
                first, beyond = start.strftime("%Y-%m-%d-%H")[:width], end.strftime("%Y-%m-%d-%H")
                rows = rows.where((F.col(field.name) >= first) & (F.col(field.name) < beyond))
                return in_partition(rows, field.column, key)
        raise ValueError(f"{self.path} has no time partition")

    def partitions(self) -> DataFrame:
        """Rows per folder; no data column is read."""
        return self.rows().groupBy(*self.folders).agg(F.count("*").alias("n_rows"))

    # --- writing -----------------------------------------------------------

    def _declare(self, df: DataFrame, fresh: bool = False) -> tuple[DataFrame, bool]:
        """The frame in the schema of the folder, which grows by new columns and wider types."""
        before = self.schema()
        schema = _nullable(df.schema)
        if before is not None and not fresh:
            schema = merged_schema(before, schema)
        if before is None or fresh or schema != before:
            text = self.spark.range(0, 1, 1, 1).select(F.lit(schema.json()).alias("value"))
            text.write.mode("overwrite").option("lineSep", "\n").text(f"{self.path}/_schema")
        return align(df, schema), before is not None and schema != before

    def _write(self, df: DataFrame, target: str, mode: str, how: str) -> int:
        names = [f.name for f in self.partition_by]
        if names:
            # Rebalancing splits a partition value that is too big for one task.
            df = with_partitions(df, self.partition_by).hint("rebalance", *names)
        # Counted last: adaptive execution drops what lies below the shuffle of an empty frame.
        counted = Observation()
        df = df.observe(counted, F.count(F.lit(1)).alias("n"))
        writer = df.write.mode(mode).option("partitionOverwriteMode", how)
        writer.partitionBy(*names).parquet(target)
        return counted.get["n"]

    def append(self, df: DataFrame, batch: str | None = None) -> Row:
        """Add rows. A named batch takes its own folder, which a second run of it replaces."""
        df, evolved = self._declare(df)
        if self.partition_by:
            if batch is not None:
                raise ValueError("batches are named in folders without partitions")
            return Row(n_rows=self._write(df, self.path, "append", "static"), schema_evolved=evolved)
        folder = f"{self.path}/{BATCH}={batch or uuid.uuid4().hex}"
        return Row(n_rows=self._write(df, folder, "overwrite", "static"), schema_evolved=evolved)

    def overwrite(self, df: DataFrame) -> Row:
        before = self.schema()
        df = align(df, _nullable(df.schema))
        if not self.partition_by:
            n_rows = self._overwrite_loads(df, uuid.uuid4().hex)
        else:
            n_rows = self._write(df, self.path, "overwrite", "static")
            self._declare(df, fresh=True)
        return Row(n_rows=n_rows, schema_evolved=before is not None and before != df.schema)

    def _overwrite_loads(self, df: DataFrame, batch: str) -> int:
        """One load in the place of all."""
        counted = Observation()
        named = df.withColumn(BATCH, F.lit(batch)).observe(counted, F.count(F.lit(1)).alias("n"))
        named.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BATCH).parquet(self.path)
        self._declare(df, fresh=True)
        return counted.get["n"]

    def overwrite_partitions(self, df: DataFrame) -> Row:
        """Replace only the partitions the new rows fall into."""
        if not self.partition_by:
            raise ValueError("partition overwrite needs a partition column")
        df, evolved = self._declare(df)
        return Row(n_rows=self._write(df, self.path, "overwrite", "dynamic"), schema_evolved=evolved)

    def replace_partitions(self, df: DataFrame, parts: Sequence[str]) -> Row:
        """Put rows in the place of the named values of a single partition column; values that get no rows are emptied."""
        [field] = self.partition_by
        done = self.overwrite_partitions(df)
        left = {r[0] for r in with_partitions(df, [field]).select(field.name).distinct().collect()}
        for part in set(parts) - left:
            self._drop_folder({field.name: part})
        return done

    def fold(self, tag: str, number: int, width: int, combine: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Bring the folders of finished batches together before batch ``number``; the folders that went.

        Whenever ``width`` folders of one size are full they become one, named by its first and last batch, so ``n`` batches leave at most
        ``width`` folders of each of log(n) sizes, and a row is written anew once for each size. ``combine`` may shrink their rows. Batch
        ``number`` and later ones are not touched: one that is run again still replaces itself. Not for folders that a stream reads.
        """
        self.recover()
        gone, size = 0, 1
        while number and number % (size * width) == 0:
            low, parts = number - size * width, []
            for first in range(low, number, size):
                parts.append(f"{tag}-{first}" if size == 1 else f"{tag}-{first}..{first + size - 1}")
            rows, size = self.rows().where(F.col(BATCH).isin(parts)), size * width
            if rows.isEmpty():  # folded before, by this batch's first run
                continue
            rows = rows.drop(BATCH)
            rows, _ = self._declare(rows if combine is None else combine(rows))
            plan = {"rows": self._aside(rows, "folded"), "batch": f"{tag}-{low}..{number - 1}", "gone": parts}
            self._note(plan)
            self._carry_out(plan)
            self._note(None)
            gone += len(parts)
        return gone

    # --- upsert ------------------------------------------------------------

    def merge(self, updates: DataFrame, keys: Sequence[str], newest: str) -> Row:
        """Upsert by key; rewrites only the partitions that hold or receive a changed key.

        Where the layout follows from the key, an update's partition is the one that holds its key, and the target is not searched.
        What is to be written is stored and noted before the target is touched: a merge that died half-way is brought to its
        end by the next one, or by ``recover``.
        """
        self.recover()
        updates = materialize(latest(updates, keys, newest), "updates")
        if updates.isEmpty():
            return Row(n_rows=0, schema_evolved=False)
        if not self.exists():
            return self.append(updates)
        if not self.partition_by:
            before = self.schema()
            merged = upsert(self.scan(), updates, keys, newest)
            return Row(n_rows=self._replace(merged), schema_evolved=before != _nullable(merged.schema))
        updates, evolved = self._declare(updates)
        names = [f.name for f in self.partition_by]
        rows = self.rows()
        touched = with_partitions(updates, self.partition_by).select(*names)
        if not {f.column for f in self.partition_by} <= set(keys):
            known = shuffled_again(updates.select(*keys), keys[0])
            touched = touched.union(rows.join(known, list(keys), "left_semi").select(*names))
        touched = materialize(touched.distinct(), "touched")
        affected = rows.join(touched, names, "left_semi").drop(*names)
        return Row(n_rows=self._replace(upsert(affected, updates, keys, newest), touched), schema_evolved=evolved)

    def _replace(self, rows: DataFrame, touched: DataFrame | None = None) -> int:
        """Put rows in the place of the touched partitions, or of everything."""
        plan = {"rows": self._aside(rows, "merged"), "touched": touched and self._aside(touched, "touched"), "batch": uuid.uuid4().hex}
        self._note(plan)
        n_rows = self._carry_out(plan)
        self._note(None)
        return n_rows

    def _aside(self, df: DataFrame, name: str) -> str:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        return path

    def _note(self, plan: dict | None) -> None:
        """Keep what is about to be written beside the folder, where an overwrite does not reach it; or that nothing is."""
        text = self.spark.range(0, 1, 1, 1).select(F.lit(json.dumps(plan)).alias("value"))
        text.write.mode("overwrite").text(f"{self.path}-pending")

    def recover(self) -> bool:
        """Finish a merge or a folding that died after its rows were stored; whether there was one."""
        try:
            row = self.spark.read.text(f"{self.path}-pending", wholetext=True).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        plan = json.loads(row.value) if row else None
        if plan is not None:
            self._carry_out(plan)
            self._note(None)
        return plan is not None

    def _carry_out(self, plan: dict) -> int:
        rows = self.spark.read.parquet(plan["rows"])
        if "gone" in plan:
            n_rows = self._write(rows, f"{self.path}/{BATCH}={plan['batch']}", "overwrite", "static")
            for part in plan["gone"]:
                self._drop_folder({BATCH: part})
            return n_rows
        if plan["touched"] is None:
            return self._overwrite_loads(rows, plan["batch"])
        n_rows = self._write(rows, self.path, "overwrite", "dynamic")
        names = [f.name for f in self.partition_by]
        left = with_partitions(rows, self.partition_by).select(*names).distinct()
        # Partitions whose rows have all moved away; there is at most one per touched partition.
        for row in self.spark.read.parquet(plan["touched"]).join(left, names, "left_anti").toLocalIterator():
            self._drop_folder(row.asDict())
        return n_rows

    def _drop_folder(self, values: dict[str, str]) -> None:
        jvm = self.spark._jvm
        escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        inner = "/".join(f"{name}={escape(values[name])}" for name in self.folders)
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{inner}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def latest(updates: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """One row per key; rows with a null in their key are no one's update and all stay."""
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    once = dedupe_latest(updates.where(whole), keys, newest)
    return once.select(*updates.columns).unionByName(updates.where(~whole))


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """Target rows whose key has no update that is as new or newer, and those updates.

    Only updates are deduplicated: target rows that share a key or have a null in it stay unless an update replaces them. An update that is
    older than the newest target row of its key changes nothing.
    """
    schema = merged_schema(target.schema, updates.schema)
    target, updates = align(target, schema), latest(align(updates, schema), keys, newest)
    known = target.groupBy(*keys).agg(F.max(newest).alias("_known"))
    known = known.select(*[F.col(k).alias(f"_{k}") for k in keys], "_known")
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    effective = updates.join(known, same, "left").where(F.col("_known").isNull() | (F.col(newest) >= F.col("_known")))
    effective = effective.select(*schema.fieldNames())
    kept = target.join(shuffled_again(effective.select(*keys), keys[0]), list(keys), "left_anti")
    return kept.select(*schema.fieldNames()).unionByName(effective)


def high_water(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Source rows above the largest value already loaded; all rows for an empty target."""
    mark = target.agg(F.max(column)).scalar()
    return source.where(mark.isNull() | (F.col(column) > mark))


# --- writing by name -------------------------------------------------------


def write_table(
    spark: SparkSession,
    path: str,
    df: DataFrame,
    mode: str = "overwrite",
    create_if_not_exists: bool = True,
    partition_by: Sequence[PartitionField] = (),
) -> Row:
    if mode not in {"append", "overwrite", "overwrite_partitions"}:
        raise ValueError(f"unknown write mode {mode!r}")
    table = Dataset(spark, path, partition_by)
    if not create_if_not_exists and not table.exists():
        raise ValueError(f"{path} does not exist")
    return getattr(table, mode)(df)


def materialize_report(
    spark: SparkSession, path: str, name: str, df: DataFrame, metadata: dict | None = None
) -> dict[str, object]:
    """Write an asset and say what was written; write mode and layout come from metadata."""
    metadata = metadata or {}
    mode = metadata.get("write_mode", "append")
    done = write_table(
        spark,
        path,
        df,
        mode,
        metadata.get("create_if_not_exists", True),
        metadata.get("partition_by", ()),
    )
    return {"table": name, "n_rows": done.n_rows, "write_mode": mode, "schema_evolved": done.schema_evolved}
