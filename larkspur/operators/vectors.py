"""Checks of vector columns and exact search by dot product."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOLERANCE = 1e-3
#: A default: rows of queries that go out at once; with vectors of 1,024 floats, 8 MB.
QUERIES_AT_ONCE = 2048
#: Rows of a block, and of the groups of vectors and of queries that meet in one cell of the grid: the work of one task,
#: whatever the size of the tables. More cells than ``TASKS`` share tasks.
BLOCK, ROWS_IN_CELL, QUERIES_IN_CELL, TASKS = 1024, 65_536, 4096, 8192
#: Pairs that are scored anew at a time.
_PAIRS = 65_536


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bad_component(v: Column) -> Column:
    return F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def integrity(vectors: DataFrame, dim: int, row: str = "row", vector: str = "vector", tolerance: float = TOLERANCE) -> DataFrame:
    """One row over all vectors: n, wrong_dim, nonfinite, off_unit, first_bad_row, least_norm, most_norm (of those off)."""
    v = F.col(vector)
    rows = vectors.select(F.col(row).alias("row"), (F.size(v) != dim).alias("d"), bad_component(v).alias("f"), norm(v).alias("n"))
    off = ~F.col("f") & (F.abs(F.col("n") - 1) > tolerance)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("d").alias("wrong_dim"), F.count_if("f").alias("nonfinite"), F.count_if(off).alias("off_unit"),
        F.min(F.when(F.col("d") | F.col("f") | off, F.col("row"))).alias("first_bad_row"), F.min(F.when(off, F.col("n"))).alias("least_norm"), F.max(F.when(off, F.col("n"))).alias("most_norm"),
    )


def scored(bundle: DataFrame, query: list[float], row: str = "row", vector: str = "vector") -> DataFrame:
    """row, score of every row."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return bundle.select(F.col(row).alias("row"), dot(q, F.col(vector)).alias("score"))


def top_k(bundle: DataFrame, query: list[float], k: int, row: str = "row", vector: str = "vector") -> DataFrame:
    """row, score of the k highest dot products, ties to the smaller row. k above the count gives all, k < 1 none."""
    if not np.isfinite(query).all():
        raise ValueError("the query holds a component that isn't finite")
    found = bundle.where(F.size(vector) != len(query)).limit(1).collect()
    if found:
        raise ValueError(f"the query has {len(query)} dimensions, row {found[0][row]} has {len(found[0][vector])}")
    return scored(bundle, query, row, vector).orderBy(F.desc("score"), "row").limit(max(k, 0))


class _Best:
    """The k best rows of each query among the vectors shown so far, ties to the smaller row; NaN is above all numbers, as
    SQL has it."""

    def __init__(self, ids: np.ndarray, asked: np.ndarray, k: int):
        self.ids, self.asked, self.k = ids, asked, k
        self.least = np.full(len(ids), -np.inf)
        self.q, self.rows, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def show(self, rows: np.ndarray, vectors: np.ndarray) -> None:
        rows, vectors = self._distinct(rows, vectors)
        scores = self.asked @ vectors.T
        least = self.least
        if len(rows) > self.k and not len(self.q):
            least = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
        # A matrix product may round one dot product differently by its place: what may reach the k-th is scored anew.
        slack = 4e-16 * vectors.shape[1] * np.abs(self.asked).sum(axis=1) * np.abs(vectors[np.isfinite(vectors)]).max(initial=0)
        q, at = np.nonzero(~(scores < (least - slack)[:, None]))
        if not len(q):
            return
        parts = (slice(i, i + _PAIRS) for i in range(0, len(q), _PAIRS))
        again = np.concatenate([np.einsum("ij,ij->i", self.asked[q[p]], vectors[at[p]]) for p in parts])
        q, rows, scores = np.append(self.q, q), np.append(self.rows, rows[at]), np.append(self.scores, again)
        order = np.lexsort((rows, np.where(np.isnan(scores), -np.inf, -scores), q))
        q, rows, scores = q[order], rows[order], scores[order]
        start = np.searchsorted(q, np.arange(len(self.ids)))
        keep = np.arange(len(q)) - start[q] < self.k
        last = np.flatnonzero(np.arange(len(q)) - start[q] == self.k - 1)
        self.least[q[last]] = np.where(np.isnan(scores[last]), np.inf, scores[last])
        self.q, self.rows, self.scores = q[keep], rows[keep], scores[keep]

    def _distinct(self, rows: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In order of the rows, and of equal vectors the first k only: the others can't be among the best."""
        order = np.argsort(rows, kind="stable")
        rows, vectors = rows[order], np.ascontiguousarray(vectors[order])
        _, same = np.unique(vectors.view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
        by_group = np.argsort(same, kind="stable")
        first = np.searchsorted(same[by_group], np.arange(same.max(initial=-1) + 1))
        keep = np.sort(by_group[np.arange(len(same)) - first[same[by_group]] < self.k])
        return rows[keep], vectors[keep]

    def told(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.q]), pa.array(self.rows), pa.array(self.scores)], ["query_id", "row", "score"])


def _best(ids: np.ndarray, asked: np.ndarray, k: int, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The best over all blocks of (numbers, vectors); with more than a block's rows to keep, over each."""
    best = _Best(ids, asked, k)
    for rows, v in blocks:
        best.show(rows, v)
        if k > BLOCK:
            yield best.told()
            best = _Best(ids, asked, k)
    yield best.told()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of (number, vector) as blocks of numbers and vectors."""
    for batch in batches:
        for s in range(0, batch.num_rows, BLOCK):
            part = batch.slice(s, BLOCK)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
            yield part.column(0).to_numpy(zero_copy_only=False), flat.reshape(part.num_rows, -1)


def _score(queries: list[tuple[int, list[float]]], k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, asked = np.array([q for q, _ in queries], np.int64), np.array([v for _, v in queries], float)
    return _best(ids, asked, k, ((rows, v.astype(float)) for rows, v in _blocks(batches)))


def _packed(kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as binary columns: the numbers, the vectors' components, and their length."""
    for rows, v in _blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array([rows.astype("<i8").tobytes()]), pa.array([v.astype(kind).tobytes()]), pa.array([v.shape[1]], pa.int32())], ["numbers", "flat", "dim"])


def _score_cells(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by cell, in each its queries first: a cell's queries are held, and its vectors pass block by block."""
    each = ([batch.column(c)[i].as_py() for c in range(5)] for batch in batches for i in range(batch.num_rows))
    for _, blocks in groupby(each, lambda b: b[0]):
        asked = []

        def vectors(blocks=blocks, asked=asked):
            for _, is_vector, numbers, flat, dim in blocks:
                block = np.frombuffer(numbers, "<i8"), np.frombuffer(flat, "<f4" if is_vector else "<f8").reshape(-1, dim)
                if is_vector:
                    yield block[0], block[1].astype(float)
                else:
                    asked.append(block)

        shown = vectors()
        first = next(shown, None)
        if first is not None and asked:
            ids, q = (np.concatenate(x) for x in zip(*asked, strict=True))
            yield from _best(ids, q, k, chain([first], shown))


def _blockwise(bundle: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Groups of blocks of vectors meet groups of blocks of queries in the cells of a grid. A task is a cell, of bounded
    work and memory, and tells k rows a query; the cells have numbers and go where those say, so that none is merged with
    others for having few bytes."""
    shape = "numbers binary, flat binary, dim int"
    down, across = (max(1, -(-df.count() // size)) for df, size in ((bundle, ROWS_IN_CELL), (queries, QUERIES_IN_CELL)))
    group = lambda n: F.pmod(F.xxhash64("numbers"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("down") * across + F.col("across")).cast("long").alias("cell")
    left = bundle.mapInArrow(partial(_packed, "<f4"), shape).select("*", F.lit(1).alias("side"), group(down).alias("down"), each(across).alias("across"))
    right = queries.mapInArrow(partial(_packed, "<f8"), shape).select("*", F.lit(0).alias("side"), each(down).alias("down"), group(across).alias("across"))
    met = left.unionByName(right).select(cell, "side", "numbers", "flat", "dim")
    tasks = min(down * across, TASKS)
    placed = met.repartitionById(tasks, (F.col("cell") % tasks).cast("int")).sortWithinPartitions("cell", "side")
    return placed.mapInArrow(partial(_score_cells, k), "query_id long, row long, score double")


def _demand_fit(asked: DataFrame, dim: int | None) -> None:
    """dim: of all vectors; None if they differ, -1 for no vectors."""
    if dim is None:
        raise ValueError("the vectors have more than one dimension")
    if dim >= 0 and (bad := asked.where(bad_component(F.col("v")) | (F.size("v") != dim) | F.col("v").isNull()).limit(1).collect()):
        raise ValueError(f"query {bad[0]['query_id']} holds a component that isn't finite, or hasn't {dim} of them")


def search(bundle: DataFrame, queries: DataFrame, k: int, row: str = "row", vector: str = "vector", at_once: int | None = None) -> DataFrame:
    """query_id, rank, row, score for each query (query_id, vector); scores in double precision, ties to the smaller row.

    Up to ``at_once`` queries (``QUERIES_AT_ONCE``, where it isn't given) go out to where the vectors lie: each block of
    vectors is one matrix product, and each task keeps k rows a query. More of them meet the vectors in blocks, and none comes to
    the driver; 0 makes that the only way. Both give the same rows. ValueError for a query that isn't finite or of the
    vectors' dimension."""
    spark, at_once = bundle.sparkSession, QUERIES_AT_ONCE if at_once is None else at_once
    rows = bundle.select(F.col(row).cast("long").alias("row"), F.col(vector).cast("array<float>").alias("v"))
    asked = queries.select(F.col("query_id").cast("long"), F.col(next(c for c in queries.columns if c != "query_id")).cast("array<double>").alias("v"))
    few = asked.limit(at_once + 1).collect()
    if not few or k < 1:
        return spark.createDataFrame([], "query_id long, rank int, row long, score double")
    dims = rows.select(F.size("v").alias("d")).distinct().limit(2).collect()
    _demand_fit(asked, dims[0]["d"] if len(dims) == 1 else None if dims else -1)
    if len(few) > at_once:
        found = _blockwise(rows, asked, k)
    else:
        found = rows.mapInArrow(partial(_score, [(r[0], list(r[1])) for r in few], k), "query_id long, row long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "row", "score")


def precision_at_k(hits: DataFrame, expected: DataFrame, attributes: DataFrame, k: int) -> DataFrame:
    """One row: hits, possible, precision. expected: query_id, category; attributes: row, category."""
    judged = hits.where(F.col("rank") <= k).join(expected.withColumnRenamed("category", "wanted"), "query_id").join(attributes.select("row", "category"), "row")
    one = lambda hit, asked: (hit.cast("long").alias("hit"), F.lit(asked).cast("long").alias("asked"))
    counted = judged.select(*one(F.col("wanted") == F.col("category"), 0)).unionByName(expected.select(*one(F.lit(0), k)))
    return counted.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.coalesce(F.sum("asked"), F.lit(0)).alias("possible")).withColumn("precision", F.col("hits") / F.nullif("possible", F.lit(0)))


def disagreements(theirs: DataFrame, ours: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Rows of one top-k list that the other lacks, unless their score ties with its last one."""
    last = ours.groupBy("query_id").agg(F.min("score").alias("last"))
    missing = theirs.join(ours.select("query_id", "row"), ["query_id", "row"], "left_anti").join(last, "query_id", "left")
    return missing.where(F.col("last").isNull() | (F.col("score") > F.col("last") + tolerance)).select("query_id", "row", "score")


def diff_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """code, expected, actual, agree over the union of codes; a missing count is 0. Inputs: code, n."""
    both = expected.select("code", F.col("n").alias("e")).join(actual.select("code", F.col("n").alias("a")), "code", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.select("code", zero(F.col("e")).alias("expected"), zero(F.col("a")).alias("actual"), (zero(F.col("e")) == zero(F.col("a"))).alias("agree"))
