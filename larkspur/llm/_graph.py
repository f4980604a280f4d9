"""Connected components by alternating star contraction (Kiveris et al., 2014), all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Staged

#: A default: with so few edges left, one task finishes, as the rounds' overhead would exceed its work. 0: rounds only.
FEW = 20_000


def opaque(column: Column | str) -> Column:
    """The same value in a form whose partitioning the planner can't follow: the join gets an exchange on both sides,
    and the adaptive planner can then split a hot key's rows."""
    return F.array_max(F.array(column))


def connected_components(edges: DataFrame, label: str = "cc", few: int | None = None) -> DataFrame:
    """(a, b) to (node, component) for each node that has an edge; component is the smallest node reachable.

    Each round takes two joins and a written table; nothing but a count and a checksum of the edges comes to the
    driver. A hub's edges are only aggregated to a minimum, and joined to one row. At most ``few`` edges (``FEW``, where
    it isn't given) take no round; both ways give the same rows.
    """
    few = FEW if few is None else few
    cols = lambda df: df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = Staged(cols(edges).where("u != v").distinct(), label)
    state = _state(now.df)
    while state[0] > few:
        e = now.df
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("y")).select(opaque("x").alias("x"), F.least("x", "y").alias("m"))
        large = Staged(e.join(low, F.col("v") == F.col("x")).select("u", F.col("m").alias("v")).distinct(), label)
        e = large.df
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low.select(opaque("u").alias("x"), "m"), F.col("u") == F.col("x")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = Staged(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label)
        large.drop()
        now.drop()
        now, last, state = after, state, _state(after.df)
        if state == last:
            break
    if 0 < state[0] <= few:
        done = Staged(now.df.coalesce(1).mapInArrow(_finish, now.df.schema), label)
        now.drop()
        now = done
    stars = now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node that isn't the smallest of its component, with that one."""
    up: dict = {}
    kind = None

    def find(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in list(up)]
    pairs = [p for p in pairs if p[0] != p[1]]
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*pairs, strict=True)], ["u", "v"])


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
    return r["n"], r["h"] or 0
