"""Nearest neighbours with randomly rotated one-bit codes (after RaBitQ, Gao and Long, 2024).

The index holds every vector, in blocks of ``INDEX_BLOCK`` rows: for each, the sign bits of its rotated, centred,
normalised form, its distance from the block's centre, and its code's inner product with it. A query estimates inner
products from the packed bits and these scalars; an error bound of ``BOUND`` deviations gives each distance a lower and
an upper estimate. Vectors whose lower estimate is no more than the k-th smallest upper one are reranked by their
exact distance, in double precision; ties go to the smaller id.

Queries meet the index in cells of a grid, each a group of index blocks and a group of query blocks; the index moves once
for each ``QUERY_GROUP`` blocks of queries, and the queries once for each ``INDEX_GROUP`` blocks of the index. Each pair
of blocks in a cell yields at most k rows a query, so memory depends on the blocks' sizes only, and the driver gets two
counts. A vector that many rows share is reranked wherever it may count.
Recall depends on the bound only, and so does the share of pairs that are reranked; the README has both as measured.
Vectors travel beside their codes: in 64 dimensions a query's survivors are so many that fetching each of them by a
join would move far more than the index.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, as queries or candidates, and
vectors of other lengths than the query's are no candidates. Rows with the query's own id are no candidates. With
fewer than k candidates all are returned. Repeated candidate rows count each. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import Staged
from ._vectors import rows_of, usable

INDEX_BLOCK, QUERY_BLOCK = 4096, 512
INDEX_GROUP, QUERY_GROUP = 8, 64
BOUND = 1.9
_SEED = 20240613


@functools.cache
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([_SEED, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centre, packed sign bits, distances from the centre, and inner products of codes with what they stand for."""
    n, dim = x.shape
    centre = x.mean(axis=0)
    residual = x - centre
    radius = np.sqrt((residual * residual).sum(axis=1))
    turned = (residual / np.where(radius > 0, radius, 1)[:, None]) @ rotation(dim)
    bits = turned > 0
    overlap = np.where(radius > 0, np.abs(turned).sum(axis=1) / math.sqrt(dim), 1.0)
    return centre, np.packbits(bits, axis=1), radius, overlap


#: The sign of each bit of each byte, first bits first.
_SIGNS = (np.arange(256) >> np.arange(7, -1, -1)[:, None] & 1).astype(np.float32) * 2 - 1


def code_products(turned: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Inner products of turned queries with codes of signs, from the packed bits: each query has a table of what each
    byte adds at each place."""
    n, width = len(turned), codes.shape[1]
    padded = np.zeros((n, width * 8), np.float32)
    padded[:, : turned.shape[1]] = turned
    tables = padded.reshape(n, width, 8) @ _SIGNS
    total = np.zeros((n, len(codes)), np.float32)
    for place in range(width):
        total += np.take(tables[:, place], codes[:, place], axis=1)
    return total


def bounds(query: np.ndarray, centre: np.ndarray, codes: np.ndarray, radius: np.ndarray, overlap: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper estimates of squared distances, for rows of queries and of codes."""
    dim = len(centre)
    turned = (query - centre) @ rotation(dim)
    far = (turned * turned).sum(axis=1)
    inner = code_products(turned, codes).astype(float) / math.sqrt(dim) / overlap
    slack = np.sqrt(np.maximum(1 / overlap**2 - 1, 0)) * bound / math.sqrt(max(dim - 1, 1))
    slack = np.sqrt(far)[:, None] * slack + 1e-5 * (1 + np.sqrt(far))[:, None]
    base = radius**2 + far[:, None]
    return base - 2 * radius * (inner + slack), base - 2 * radius * (inner - slack)


def distances(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed in the order of the components."""
    return np.sqrt(np.cumsum((x - query) ** 2, axis=1)[:, -1])


def _blocks(size: int, index: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of one length: n, dim, ids, vectors, and for the index its codes and scalars."""

    def block(ids: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
        x = np.stack(vectors).astype("<f4")
        more = [a.astype("<f8").tobytes() if a.dtype != np.uint8 else a.tobytes() for a in encode(x.astype(float))] if index else []
        cols = [len(ids), x.shape[1], np.array(ids, "<i8").tobytes(), x.tobytes(), *more]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, [pa.int32(), pa.int32(), *[pa.binary()] * 6])], ["n", "dim", "ids", "x", "centre", "codes", "radius", "overlap"][: len(cols)])

    held: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), rows_of(batch.column(1)), strict=True):
            ids, vectors = held.setdefault(len(v), ([], []))
            ids.append(i)
            vectors.append(v)
            if len(ids) == size:
                yield block(*held.pop(len(v)))
    for ids, vectors in held.values():
        yield block(ids, vectors)


def _search(k: int, bound: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            r = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
            dim = r["dim"]
            take = lambda name, kind, r=r: np.frombuffer(r[name], kind)
            ids, x = take("ids", "<i8"), take("x", "<f4").reshape(-1, dim).astype(float)
            qids, q = take("q_ids", "<i8"), take("q_x", "<f4").reshape(-1, dim).astype(float)
            low, high = bounds(q, take("centre", "<f8"), take("codes", np.uint8).reshape(len(ids), -1), take("radius", "<f8"), take("overlap", "<f8"), bound)
            out: list[tuple[np.ndarray, ...]] = []
            for i in range(len(qids)):
                other = ids != qids[i]
                up = high[i][other]
                if not len(up):
                    continue
                limit = np.partition(up, min(k, len(up)) - 1)[min(k, len(up)) - 1]
                at = np.flatnonzero(other & (low[i] <= limit))
                d = distances(q[i], x[at])
                best = np.lexsort((ids[at], d))[:k]
                out.append((np.full(len(best), qids[i]), np.full(len(best), r["q_block"] * QUERY_BLOCK + i), ids[at][best], d[best]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "query", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 10, bound: float = BOUND) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` that ``is_query`` marks, its k nearest other rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("q")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    parts = lambda n, size: max(1, -(-n // (size - size // 8)))  # noqa: E731  a little room, as partitions aren't quite even
    n_index, n_query = parts(sizes["n"], INDEX_BLOCK), parts(sizes["q"], QUERY_BLOCK)
    down, across = max(-(-n_index // INDEX_GROUP), min(n_index, 64)), -(-n_query // QUERY_GROUP)
    shape = "n int, dim int, ids binary, x binary"
    index = rows.select("vec_id", "embedding").repartition(n_index).mapInArrow(functools.partial(_blocks, INDEX_BLOCK, True), f"{shape}, centre binary, codes binary, radius binary, overlap binary")
    index = Staged(index.withColumn("down", F.spark_partition_id() % down), "index").df
    asked = rows.where("q").select("vec_id", "embedding").distinct().repartition(n_query).mapInArrow(functools.partial(_blocks, QUERY_BLOCK, False), shape)
    asked = Staged(asked.withColumn("across", F.spark_partition_id() % across).withColumn("q_block", F.monotonically_increasing_id()), "queries").df
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = min(4 * down * across, 20_000)
    left = index.withColumn("across", every(across)).repartition(cells, "down", "across", "dim")
    right = asked.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), "q_block", F.col("across").alias("q_across"), every(down).alias("q_down"))
    right = right.repartition(cells, "q_down", "q_across", "q_dim")
    met = left.join(right, (F.col("down") == F.col("q_down")) & (F.col("across") == F.col("q_across")) & (F.col("dim") == F.col("q_dim")))
    met = met.select("dim", "ids", "x", "centre", "codes", "radius", "overlap", "q_ids", "q_x", "q_block")
    found = met.mapInArrow(functools.partial(_search, k, bound), "query_id long, query long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
