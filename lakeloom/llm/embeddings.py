"""Embedding near-duplicates by an inverted multi-index.

Each half of a unit vector has a codebook of its own; the pairs of codes are the cells of a grid. A vector is kept in the cell of
its own codes and visits the cells around it by multi-sequence traversal: cells in order of the least distance at which they
begin, from two sorted lists and a heap. With a recall of 1, the default, the traversal goes as far as a neighbour can be and
nothing is missed; of two cells the vectors of the later one visit the earlier one. With a lower recall cells are visited, in
both directions, as far as that share of real neighbours asks: the distance is measured on the pairs at the threshold between a
sample and all vectors, and where these are too few it is the exact one. Every pair that meets in a cell is verified by its cosine.

Equal vectors are one entry with a count. Members and visitors of a cell are dealt into blocks of bounded size and each pair
of blocks is a group of its own, so a crowded cell is many tasks. From a block come counts and one link per vector, never its pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from lakeloom.llm.common import draw_bound, written
from lakeloom.llm.components import components
from lakeloom.operators.joins import shuffled_again

COSINE = 0.95
# Of pairs at the threshold, the share that is found; at 1 all are.
RECALL = 1.0
# Vectors that the codebooks are fitted to, at most about; codes of a half; vectors that a cell should hold.
SAMPLE_ROWS = 20_000
MOST_CODES = 256
CELL_ROWS = 4096
# Vectors that the distance of visits is measured with, pairs that it needs, and its steps.
MEASURED_ROWS = 2000
MEASURED_PAIRS = 100
STEPS = 1000
# Rows of one side of a block, and visitors that are compared at a time.
BLOCK_ROWS = 8192
COMPARED_ROWS = 512


def usable(vector: F.Column) -> F.Column:
    """Whether a vector has a direction: not null, not empty, all components finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & finite & some, F.lit(False))


def units(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of unit length in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # Scaled first: a square of a very large or small component would not fit.
    values /= np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _as_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = units(batch["vector"])
        offsets = np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))], ["unit"])


def codebooks(vectors: DataFrame, dim: int, codes: int, rows: int = SAMPLE_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes of both halves, fitted to a sample of at most about ``rows`` vectors drawn by a hash; and some of the sample."""
    held = vectors.count()
    drawn = vectors.where(F.xxhash64(F.lit(5), "uid") <= draw_bound(rows, held))
    drawn = written(drawn.select("vector").mapInArrow(_as_units, "unit array<double>"), "codebook-sample")
    cut = (dim + 1) // 2
    books = []
    for first, size in ((1, cut), (cut + 1, dim - cut)):
        if not size or codes == 1 or drawn.isEmpty():
            books.append(np.zeros((1, size)))
            continue
        half = drawn.select(array_to_vector(F.slice("unit", first, size)).alias("half"))
        model = KMeans(featuresCol="half", k=codes, maxIter=8, seed=1).fit(half)
        books.append(np.array([c for c in model.clusterCenters()]).reshape(-1, size))
    some = [r.unit for r in drawn.limit(MEASURED_ROWS).collect()]
    return books, np.array(some).reshape(-1, dim)


def borders(half: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: its code, and how far it lies from where each other code begins (0 for its own)."""
    squares = (half * half).sum(axis=1)[:, None] - 2 * half @ book.T + (book * book).sum(axis=1)
    own = squares.argmin(axis=1)
    apart = np.sqrt(np.maximum(((book[:, None] - book[None]) ** 2).sum(axis=2), 0))[own]
    gap = squares - squares[np.arange(len(half)), own][:, None]
    return own, np.where(apart > 0, np.maximum(gap, 0) / np.maximum(2 * apart, 1e-300), 0.0)


def traverse(first: np.ndarray, second: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Cells in ascending order of the squared distances to their two codes, as far as ``reach``."""
    rows, columns = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    a, b = first[rows].tolist(), second[columns].tolist()
    limit, found = reach * reach * (1 + 1e-9) + 1e-15, []
    heap = [(a[0] ** 2 + b[0] ** 2, 0, 0)]
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > limit:
            break
        found.append((rows[i], columns[j]))
        if i + 1 < len(a) and (j == 0):
            heapq.heappush(heap, (a[i + 1] ** 2 + b[0] ** 2, i + 1, 0))
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] ** 2 + b[j + 1] ** 2, i, j + 1))
    return found


def _border_steps(books: list[np.ndarray], cut: int, cosine: float, sample: np.ndarray, radius: float):
    """Counts of the pairs at or just above the threshold between the vectors and the sample, by the lesser distance of the two directions."""

    def placed(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [borders(vectors[:, s], book) for s, book in zip((slice(0, cut), slice(cut, None)), books, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = placed(sample)
        for batch in batches:
            for start in range(0, len(batch), COMPARED_ROWS):
                vectors = units(batch["vector"].slice(start, COMPARED_ROWS))
                cosines = vectors @ sample.T
                q, m = np.nonzero((cosines >= cosine) & (cosines < (1 + cosine) / 2))
                there = sum(far[q, own[m]] ** 2 for (_, far), (own, _) in zip(placed(vectors), others, strict=True))
                back = sum(far[m, own[q]] ** 2 for (own, _), (_, far) in zip(placed(vectors), others, strict=True))
                step = np.ceil(np.sqrt(np.minimum(there, back)) / radius * STEPS).astype(np.int64)
                steps, counts = np.unique(np.minimum(step, STEPS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(steps, pa.int64()), pa.array(counts, pa.int64())], ["step", "n"])

    return run


def radius_of(cosine: float) -> float:
    """The furthest that a neighbour can be."""
    return float(np.sqrt(max(2 - 2 * cosine, 0.0)))


def reach_of(vectors: DataFrame, cosine: float, recall: float, books: list[np.ndarray], sample: np.ndarray) -> float:
    """Distance up to which cells are visited: the one within which the share ``recall`` of the sample's real neighbours at the
    threshold lie in one direction or the other. At a recall of 1, and with too few such pairs, it is the furthest that any
    neighbour can be."""
    radius = radius_of(cosine)
    if recall >= 1 or not radius or not len(sample):
        return radius
    steps = vectors.select("vector").mapInArrow(_border_steps(books, books[0].shape[1], cosine, sample, radius), "step long, n long")
    found = sorted((r.step, r.n) for r in steps.groupBy("step").agg(F.sum("n").alias("n")).collect())
    within = np.cumsum([n for _, n in found])
    if not found or within[-1] < MEASURED_PAIRS:
        return radius
    return radius * found[int(np.searchsorted(within, recall * within[-1]))][0] / STEPS


def _place(books: list[np.ndarray], cut: int, reach: float, exact: bool):
    width = len(books[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = units(batch["vector"])
            own1, far1 = borders(vectors[:, :cut], books[0])
            own2, far2 = borders(vectors[:, cut:], books[1])
            visits = []
            for own, a, b in zip((own1 * width + own2).tolist(), far1, far2, strict=True):
                cells = [i * width + j for i, j in traverse(a, b, reach)]
                if exact:
                    # Both vectors of a pair reach each other's cell: one direction finds it.
                    cells = [c for c in cells if c <= own]
                visits.append(cells if own in cells else [own, *cells])
            yield pa.RecordBatch.from_arrays(
                [batch["uid"], batch["n"], batch["vector"], pa.array(own1 * width + own2, pa.int64()), pa.array(visits, pa.list_(pa.int64()))],
                ["uid", "n", "vector", "cell", "visits"],
            )

    return run


def _least_labels(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` nodes the least one it can reach by links ``a, b``."""
    label = np.arange(size)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def _verify(cosine: float):
    def run(members: pa.Table, visitors: pa.Table) -> pa.Table:
        """Links between the visitors of a cell and its members. A member that does not visit the visitor's cell gets its count here."""
        schema = pa.schema([("uid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        if not members.num_rows or not visitors.num_rows:
            return schema.empty_table()
        uid = [t["uid"].to_numpy() for t in (visitors, members)]
        n = [t["n"].to_numpy() for t in (visitors, members)]
        cells, cell = np.unique(visitors["from"].to_numpy(), return_inverse=True)
        sees = np.zeros((members.num_rows, len(cells)), bool)
        lists = members["visits"].combine_chunks()
        of, seen = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(cells, seen), len(cells) - 1)
        known = cells[at] == seen
        sees[of[known], at[known]] = True
        left, right = (units(t["vector"].combine_chunks()) for t in (visitors, members))
        links = [np.zeros(len(x), np.int64) for x in uid]
        # One node per vector, whichever side it is on.
        nodes, number = np.unique(np.concatenate(uid), return_inverse=True)
        joined = [np.zeros((2, 0), np.int64)]
        for start in range(0, len(left), COMPARED_ROWS):
            q, m = np.nonzero(left[start : start + COMPARED_ROWS] @ right.T >= cosine)
            q += start
            other = uid[0][q] != uid[1][m]
            q, m = q[other], m[other]
            if not len(q):
                continue
            links[0] += np.bincount(q, n[1][m], len(left)).astype(np.int64)
            lonely = ~sees[m, cell[q]]
            links[1] += np.bincount(m[lonely], n[0][q[lonely]], len(right)).astype(np.int64)
            # Of the pairs remains one link per vector.
            label = _least_labels(number[q], number[len(left) + m], len(nodes))
            linked = np.flatnonzero(label != np.arange(len(nodes)))
            joined.append(np.stack([linked, label[linked]]))
        sums = np.bincount(number, np.concatenate(links), len(nodes)).astype(np.int64)
        root = nodes[_least_labels(*np.concatenate(joined, axis=1), len(nodes))]
        some = (sums > 0) | (root != nodes)
        return pa.Table.from_arrays([pa.array(x[some]) for x in (nodes, sums, root)], schema=schema)

    return run


def links(vectors: DataFrame, dim: int, cosine: float, recall: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``uid, n, vector`` of one length to ``uid, links, root`` rows, several per vector: counts to be summed, and links to a lesser one."""
    held = vectors.count()
    codes = max(1, min(MOST_CODES, round((held / CELL_ROWS) ** 0.5)))
    books, sample = codebooks(vectors, dim, codes)
    reach = reach_of(vectors, cosine, recall, books, sample)
    schema = f"uid long, n long, vector {vectors.schema['vector'].dataType.simpleString()}, cell long, visits array<long>"
    placed = vectors.repartition("uid").select("uid", "n", "vector").mapInArrow(_place(books, (dim + 1) // 2, reach, reach >= radius_of(cosine)), schema)
    placed = written(placed, "placed-vectors")
    # Named anew: the two sides of the cogroup come from one table.
    own = [F.col(c).alias(c) for c in ("uid", "n", "vector")]
    visitors = placed.select(*own, F.col("cell").alias("from"), F.explode("visits").alias("cell"))
    members = placed.groupBy("cell").agg(F.count("*").alias("members"))
    counts = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("visitors"))
    # At most as many rows as the grid has cells.
    blocks = counts.join(members, "cell").select(
        "cell",
        F.ceil(F.col("members") / block_rows).cast("int").alias("rows"),
        F.ceil(F.col("visitors") / block_rows).cast("int").alias("columns"),
    )
    blocks = shuffled_again(written(blocks, "cell-blocks"), "cell")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its block of one side, once for each block of the other."""
        side = side.join(blocks, "cell")
        side = side.withColumn(own, F.pmod(F.xxhash64("uid"), F.col(own)).cast("int"))
        return side.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    keys = ["cell", "rows", "columns"]
    left = dealt(placed, "rows", "columns").select(*keys, "uid", "n", "vector", "visits")
    right = dealt(visitors, "columns", "rows").select(*keys, "uid", "n", "vector", "from")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_verify(cosine), "uid long, links long, root long")


def near_duplicates(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    recall: float = RECALL,
) -> DataFrame:
    """One row per input row: vec_id, n_links (other rows linked directly), component_id (least id reachable), kept.

    Vectors that are null, empty or zero or hold a null or non-finite component link with nothing, and vectors of different lengths
    not with each other. Equal vectors are linked, repeated ids too. A null id is never a component's id unless its component has no
    other, and is never kept. No rows give none. Other columns are not read.
    """
    # Doubles stay doubles; whatever else is no float becomes one.
    kind = table.select(vector_col).schema[0].dataType.elementType
    vector = F.col(vector_col).cast("array<float>" if isinstance(kind, FloatType) else "array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    lone = rows.where(~usable(F.col("vector"))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    good = rows.where(usable(F.col("vector")))
    distinct = good.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    distinct = written(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct-vectors")
    found = None
    for (dim,) in sorted(distinct.select(F.size("vector")).distinct().collect()):
        part = links(distinct.where(F.size("vector") == dim), dim, cosine, recall)
        found = part if found is None else found.union(part)
    if found is None:
        return lone.withColumn("kept", F.col("vec_id").isNotNull())
    found = written(found, "verified-links")
    sums = found.groupBy("uid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    labels = distinct.join(sums, "uid", "left").join(joined, F.col("uid") == F.col("node"), "left")
    labels = labels.select(
        "vector", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "uid").alias("root")
    )
    labels = written(labels, "labelled-vectors")
    roots = shuffled_again(labels.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    labels = written(labels.join(roots, "root").select("vector", "n_links", "component_id"), "vector-labels")
    out = good.join(labels, "vector").select("vec_id", "n_links", "component_id").unionByName(lone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
