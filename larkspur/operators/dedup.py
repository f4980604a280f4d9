"""First-accepted-wins de-duplication over two keys, in line order.

A record is accepted if neither its id nor its fingerprint belongs to an accepted record before it: the greedy matching
of ids and fingerprints. Records with both keys to themselves are accepted at once and go no further. Among the others, in rounds, each
record that is first for both its keys is accepted and those that share a key with it are decided. Rounds touch only
what is undecided; when that is at most ``tail`` rows (``TAIL`` by default; 0: rounds only), one task finishes them in
order, to the same result. Keys are aggregated before the shuffle, and what comes of that is joined in a form that
lets the adaptive planner split a hot key's rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import fixed

TAIL = 50_000
_KEYS, _LONE = ("id", "print"), ("lone_id", "lone_print")


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, prints = set(), set()
    for batch in batches:
        keep = []
        for i, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            keep.append(i not in ids and p not in prints)
            if keep[-1]:
                ids.add(i)
                prints.add(p)
        yield batch.select([0]).filter(pa.array(keep, pa.bool_()))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The definition itself, over rows in order: line_no and code of the rejected."""
    ids, prints = set(), set()
    for batch in batches:
        out = []
        for n, i, p, old_id, old_print in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if old_id or i in ids:
                out.append((n, "E010"))
            elif old_print or p in prints:
                out.append((n, "E011"))
            else:
                ids.add(i)
                prints.add(p)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["line_no", "code"])


def opaque(column: str) -> Column:
    """The same value in a form whose partitioning the planner can't follow, so that the join gets an exchange of its own
    and a hot key's rows can be split."""
    return F.array_max(F.array(column))


def _least(rows: DataFrame, key: str) -> DataFrame:
    """Each key's first line; aggregated before the shuffle, so a hot key is one row for each task."""
    least = rows.groupBy(key).agg(F.min("line_no").alias(f"first_{key}"))
    return least.select(opaque(key).alias(f"k_{key}"), f"first_{key}")


def _with_firsts(rows: DataFrame) -> DataFrame:
    """Each row with the first line of each of its keys. A lone key's is the row's own, so only the others are joined back."""
    for key in _KEYS:
        least = _least(rows.where(~F.col(f"lone_{key}")).select("line_no", key), key)
        rows = rows.join(least, F.col(key) == F.col(f"k_{key}"), "left").withColumn(f"first_{key}", F.coalesce(f"first_{key}", "line_no")).drop(f"k_{key}")
    return rows


def _in_conflict(rows: DataFrame, flags: list[str]) -> DataFrame:
    """Rows that share a key with another, or that a flag marks, and which of their keys are theirs alone. Shared keys are few beside the rows: where they are few
    enough, the planner sends them out and moves no row."""
    shared = [rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(opaque(key).alias(f"shared_{key}")) for key in _KEYS]
    for key, known in zip(_KEYS, shared, strict=True):
        rows = rows.join(known, F.col(key) == F.col(f"shared_{key}"), "left")
    met = F.col("shared_id").isNotNull() | F.col("shared_print").isNotNull()
    for flag in flags:
        met = met | F.col(flag).isNotNull()
    lone = [F.col(f"shared_{key}").isNull().alias(f"lone_{key}") for key in _KEYS]
    return fixed(rows.where(met).select("line_no", *_KEYS, *lone, *flags))


def _settled(left: DataFrame, tail: int) -> DataFrame:
    """line_no of the accepted among rows that share keys."""
    accepted = []
    while (n := left.count()) > tail:
        firsts = fixed(_with_firsts(left))
        won = firsts.where("line_no = first_id AND line_no = first_print").select("line_no", *_KEYS, *_LONE)
        accepted.append(won.select("line_no"))
        left = firsts.where("line_no <> first_id OR line_no <> first_print").select("line_no", *_KEYS, *_LONE)
        for key in _KEYS:
            left = left.join(won.where(~F.col(f"lone_{key}")).select(opaque(key).alias("k")), F.col(key) == F.col("k"), "left_anti")
        left = fixed(left)
    if n or not accepted:
        accepted.append(left.select("line_no", *_KEYS).coalesce(1).sortWithinPartitions("line_no").mapInArrow(_in_order, "line_no long"))
    return fixed(functools.reduce(DataFrame.unionByName, accepted))


def duplicates(rows: DataFrame, tail: int = TAIL, taken: DataFrame | None = None) -> DataFrame:
    """line_no, code of the rejected: E010 if the id was taken by an earlier accepted record, else E011.

    rows: line_no (unique), id, print (not null). taken: id, print of records accepted before all of these. Who repeats
    one of those is out before the others meet, as what is rejected reserves nothing."""
    rows, flags = rows.select("line_no", *_KEYS), []
    if taken is not None:
        for key in _KEYS:
            asked = rows.select(F.col(key).alias("k")).distinct()
            known = taken.select(F.col(key).alias("k")).join(asked, "k", "left_semi").distinct().select(opaque("k").alias(f"old_{key}"))
            rows = rows.join(known, F.col(key) == F.col(f"old_{key}"), "left")
            flags.append(f"old_{key}")
    met = _in_conflict(rows, flags)
    old = [F.col(f).isNotNull().alias(f"before_{f}") for f in flags] or [F.lit(False).alias(f"before_{k}") for k in _KEYS]
    if 0 < met.count() <= tail:
        return met.select("line_no", *_KEYS, *old).coalesce(1).sortWithinPartitions("line_no").mapInArrow(_codes, "line_no long, code string")
    free, before = met, F.lit(False)
    if flags:
        free, before = met.where("old_id IS NULL AND old_print IS NULL"), F.col("old_id").isNotNull()
    won = _settled(free.select("line_no", *_KEYS, *_LONE), tail)
    out = met.join(won, "line_no", "left_anti").select("line_no", "id", before.alias("before"))
    owners = met.join(won, "line_no", "left_semi").select(opaque("id").alias("owner"), F.col("line_no").alias("owned_at"))
    code = F.when(F.col("before") | (F.col("owned_at") < F.col("line_no")), "E010").otherwise("E011")
    return out.join(owners, F.col("id") == F.col("owner"), "left").select("line_no", code.alias("code"))


def accepted_lines(rows: DataFrame, tail: int = TAIL) -> DataFrame:
    """line_no of the accepted."""
    return rows.select("line_no").join(duplicates(rows, tail), "line_no", "left_anti")
