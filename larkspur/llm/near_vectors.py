"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label are one node. In each of a round's ``PASSES`` passes, nodes are ordered within label and
dimension by 64 random sign bits of their difference from the label's mean; in that order each meets, in double
precision, at least the ``WINDOW`` before it. Links found in any pass make components. Rounds of new random passes go on
until one merges nothing, so dense labels, where a pass brings fewer pairs together, take more of them: a pair that
a pass finds with probability p is missed with less than (1 - p) to the power of two rounds' passes. Taking the mean away
makes p in a narrow cone of vectors much the same as in a label that looks every way; the README has measured recall.

Links are then counted within components, all members against all, in blocks of ``BLOCK`` rows: no cap, and no pair
leaves its task. So within the components found, ``n_links`` is exact, and that step's work grows with the square of a
component's different vectors; ``count_links=False`` leaves it out.

Cases: a vector that is null, zero, or holds null or non-finite components, or has a null label, links with nothing:
no links, its own component, kept. Vectors of different lengths never link. Rows with the same id count as rows.
A null id is ignored as a component's smallest; a component of null ids is null and kept. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import sorted_groups
from ._common import Staged, tidy
from ._graph import connected_components, opaque
from ._vectors import rows_of, usable

PASSES, WINDOW, BLOCK = 8, 128, 1024
_SEED = 20240611


@functools.lru_cache(4)
def _planes(dim: int, passes: int, turn: int) -> np.ndarray:
    return np.random.default_rng([_SEED, dim, turn]).normal(size=(dim, passes * 64))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, embedding to the sums of each label and dimension of a batch: label, dim, n, sums."""
    for batch in batches:
        groups: dict[tuple, list] = {}
        for label, v in zip(batch.column(0).to_pylist(), rows_of(batch.column(1)), strict=True):
            groups.setdefault((label, len(v)), []).append(v)
        if groups:
            sums = [np.sum(np.stack(v), axis=0, dtype=float).tolist() for v in groups.values()]
            cols = [pa.array([k[0] for k in groups], pa.int64()), pa.array([k[1] for k in groups], pa.int32()), pa.array([len(v) for v in groups.values()], pa.int64()), pa.array(sums, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["label", "dim", "n", "sums"])


def _centres(classes: DataFrame) -> DataFrame:
    """l, d, centre: the mean of each label and dimension, to three digits, so that the order of summing doesn't show."""
    parts = classes.select("label", "embedding").mapInArrow(_sums, "label long, dim int, n long, sums array<double>")
    each = parts.select("label", "dim", "n", F.posexplode("sums").alias("at", "x")).groupBy("label", "dim", "at").agg(F.round(F.sum("x") / F.sum("n"), 3).alias("x"))
    inner = each.groupBy("label", "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centre"))
    return inner.select(opaque("label").alias("l"), F.col("dim").alias("d"), "centre")


def _keys(passes: int, turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label, embedding, centre to a row for each pass: pass, label, dim, key (64 sign bits in order), node, v."""
    for batch in batches:
        vectors, centres = rows_of(batch.column(2)), rows_of(batch.column(3))
        dims = np.array([len(v) for v in vectors], np.int32)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = np.stack([vectors[i] for i in at]).astype("<f8")
            unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
            bits = np.packbits((unit - np.stack([centres[i] for i in at])) @ _planes(int(dim), passes, turn) > 0, axis=1)
            body, n = pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary()), len(at)
            part = batch.take(pa.array(at))
            for p in range(passes):
                key = pa.array([r.tobytes() for r in bits[:, p * 8 : p * 8 + 8]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), part.column(1), pa.array(np.full(n, dim, np.int32)), key, part.column(0), body], ["pass", "label", "dim", "key", "node", "v"])


def _unit(bodies: list[bytes], dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(bodies), "<f4").reshape(-1, dim).astype("<f8")
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _windows(threshold: float, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between rows of the same group (pass, label, dim), in order: those of a block of ``window`` rows meet each
    other and the block before. Of the links within two blocks only a forest is given."""
    group, ids, units, tree = None, np.empty(0, np.int64), np.empty((0, 0)), np.empty(0, np.int64)
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        numbers = batch.column(4).to_numpy(zero_copy_only=False)
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows] if batch.num_rows else []
        a, b = [], []
        for s, e in itertools.pairwise(cuts):
            now = tuple(c[s] for c in cols)
            if now != group:
                group, ids, units, tree = now, numbers[:0], np.empty((0, int(now[2]))), np.empty(0, np.int64)
            for at in range(s, e, window):
                end = min(at + window, e)
                old = len(ids)
                ids = np.concatenate([ids, numbers[at:end]])
                units = np.vstack([units, _unit(batch.column(5).slice(at, end - at).to_pylist(), int(now[2]))])
                tree = np.concatenate([tree, np.arange(end - at) + (tree.max() + 1 if old else 0)])
                near = np.tril(units[old:] @ units.T >= threshold, old - 1)
                for i in np.flatnonzero(near.any(axis=1)):
                    for j in np.flatnonzero(near[i]):
                        if tree[j] != tree[old + i]:
                            tree[tree == tree[j]] = tree[old + i]
                            a.append(int(ids[old + i]))
                            b.append(int(ids[j]))
                ids, units, tree = ids[-window:], units[-window:], tree[-window:]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _count(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (component, i, j): each row's linked vectors in the other block, by the copies that a node stands for."""
    for group in sorted_groups(batches, ["component", "i", "j"]):
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        block, copies, nodes = (group.column(c).to_numpy() for c in ("block", "copies", "node"))
        bodies = group.column("v").to_pylist()
        unit = _unit(bodies, len(bodies[0]) // 4)
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = unit[a] @ unit[b].T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
            links, where = near @ copies[b], a
        else:
            links, where = np.concatenate([near @ copies[b], near.T @ copies[a]]), np.concatenate([a, b])
        yield pa.RecordBatch.from_arrays([pa.array(nodes[where], pa.int64()), pa.array(links.astype(np.int64))], ["node", "links"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body = pa.array([np.asarray(v, "<f4").tobytes() for v in rows_of(batch.column(6))], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], body], [*batch.schema.names[:6], "v"])


@tidy
def _stars(classes: DataFrame, threshold: float, passes: int, window: int) -> Staged:
    """node, component for each node that links, after the first round that merges nothing."""
    placed = classes.join(_centres(classes), (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")))
    placed = Staged(placed.select("node", "label", "embedding", "centre"), "placed").df
    order = ["pass", "label", "dim", "key", "node"]
    stars, merged = None, -1
    for turn in itertools.count():
        keyed = placed.mapInArrow(functools.partial(_keys, passes, turn), "pass int, label long, dim int, key binary, node long, v binary")
        rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
        links = rows.mapInArrow(functools.partial(_windows, threshold, window), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if stars is not None:
            links = links.unionByName(stars.df.select(F.col("component").alias("a"), F.col("node").alias("b")))
        stars = Staged(connected_components(links), "stars")
        before, merged = merged, stars.df.where("node != component").count()
        if merged == before:
            return stars


def _counts(members: DataFrame, threshold: float) -> DataFrame:
    """n, links: the linked rows of each node, from all pairs of each component."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).select(opaque("component").alias("c"), "blocks")
    dealt = members.join(sizes, F.col("component") == F.col("c")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "copies", "node", "embedding")
    met = met.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = met.mapInArrow(_bodies, "component long, i int, j int, block int, copies long, node long, v binary").mapInArrow(functools.partial(_count, threshold), "node long, links long")
    return found.groupBy("node").agg(F.sum("links").alias("links")).select(F.col("node").alias("n"), "links")


@tidy
def _linked(good: DataFrame, threshold: float, passes: int, window: int, count_links: bool) -> Staged:
    """l, e (a label and a vector), n_links, component_id for each different vector of a label."""
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    classes = Staged(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "classes").df
    stars = _stars(classes, threshold, passes, window).df
    members = classes.join(stars.select(F.col("node").alias("s"), "component"), F.col("node") == F.col("s"))
    least = members.groupBy("component").agg(F.min("least_id").alias("component_id")).select(opaque("component").alias("c"), "component_id")
    known = members.select("node", "component").join(least, F.col("component") == F.col("c")).select(F.col("node").alias("s"), "component_id")
    result = classes.join(known, F.col("node") == F.col("s"), "left")
    links = F.lit(None).cast("long")
    if count_links:
        result = result.join(_counts(members, threshold), F.col("node") == F.col("n"), "left")
        links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    return Staged(result.select(F.col("label").alias("l"), F.col("embedding").alias("e"), links.alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id")), "vectors")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, passes: int = PASSES, window: int = WINDOW, count_links: bool = True) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row; vectors: vec_id, embedding, label. n_links is null for vectors
    that may link, if ``count_links`` is false."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("long").alias("label"))
    fit = F.col("label").isNotNull() & usable(F.col("embedding"))
    good = rows.where(fit)
    result = _linked(good, threshold, passes, window, count_links).df
    done = good.join(result, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
