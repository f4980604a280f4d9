"""URL filters by a sort-merge range join of reversed-host keys.

A rule is a host, a path prefix and an action; it fits its host, all subdomains, and paths that start with its path.
A host's labels reversed, a slash and the path make a key, in which a rule is a prefix, that is an interval of keys. A
url asks with its host's key, and with one for each suffix that has as many labels as some rule's host (a few numbers,
which the driver collects); a key holds no more of the path than the longest rule does. Rules and keys are dealt out by
range and sorted; a sweep keeps the stack of nested rules that are open, and the top of the stack is a key's longest
rule. Of a url's keys the longest rule wins (then the longer host, then the first action).

Rules that are open where a partition begins come from the partitions before. A first sweep reports each partition's
first key and the rules open at its end; the driver chains these into a stack for each partition. A stack holds nested
prefixes of one key only, so what is collected and sent out is bounded by partitions times the depth of a key, not by
the number of urls or rules. A common host or a common url is split, as the row's own number is part of the order.

Cases: a null url, or one without ``://``, has an empty host and path. Where no rule fits, ``rule`` is null and the
verdict is the default's. Equal rules with different actions: the action that sorts first. Rules with null host or
action are left out; a null path is an empty one, which fits every path. Repeated rows are judged each. Other columns
stay out of the way: only those in ``keep`` are carried.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, lower_ascii


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where the url is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def _sweep(stack: list[tuple[str, str, str]], batch: pa.RecordBatch) -> list[tuple[str | None, str | None]]:
    """Rules go on the stack when their prefix begins and leave it when it ends; each key gets the top's name and action."""
    found = []
    for kind, key, name, action in zip(*_columns(batch, "kind", "key", "name", "action"), strict=True):
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if kind == 0:
            stack.append((key, name, action))
        found.append(stack[-1][1:] if stack and kind else (None, None))
    return found


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's first and last key, and its own rules that are open at its end."""
    stack: list = []
    part = first = last = None
    for batch in batches:
        if batch.num_rows:
            if part is None:
                part, first = (c[0] for c in _columns(batch.slice(0, 1), "part", "key"))
            last = _columns(batch.slice(batch.num_rows - 1), "key")[0][0]
            _sweep(stack, batch)
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([last]), pa.array([[list(x) for x in stack]], pa.list_(pa.list_(pa.string())))], ["part", "first", "last", "open"])


def chained(ends: list) -> dict[int, list[tuple[str, str, str]]]:
    """For each partition, the rules of earlier ones that are open where it begins, outermost first."""
    at_start, stack = {}, []
    for e in sorted(ends, key=lambda e: e["part"]):
        at_start[e["part"]] = stack = [x for x in stack if e["first"].startswith(x[0])]
        stack = [x for x in stack if e["last"].startswith(x[0])] + [tuple(x) for x in e["open"]]
    return at_start


def _match(at_start: dict[int, list], width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys with the rule found: a row's own key always, those of its host's suffixes only where they found one."""
    stack: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if stack is None:
            stack = list(at_start[_columns(batch.slice(0, 1), "part")[0][0]])
        found = _sweep(stack, batch)
        keep = [k == 1 or (k == 2 and r[0] is not None) for k, r in zip(_columns(batch, "kind")[0], found, strict=True)]
        cols = [*batch.columns[:width], pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:width], "rule", "rule_action"]).filter(pa.array(keep, pa.bool_()))


def judge(pages: DataFrame, rules: DataFrame, keep: Sequence[str] = ("page_id",), url: str = "url", default: str = "allow") -> DataFrame:
    """The columns in ``keep``, and host, path, rule, verdict. rules: host, path, action."""
    host, path = url_parts(F.col(url))
    rows = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), host.alias("host"), path.alias("path")).withColumn("uid", F.monotonically_increasing_id())
    known = rules.where("host is not null and action is not null").select(lower_ascii(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "action").groupBy("h", "p").agg(F.min("action").alias("action"))
    # One row: how many labels the rules' hosts have, and the length of the longest path. What a rule's host can't equal
    # asks nothing, and no rule looks further into a path.
    shape = known.agg(F.array_sort(F.collect_set(F.size(F.split("h", r"\.", -1)))).alias("counts"), F.coalesce(F.max(F.length("p")), F.lit(0)).alias("reach")).first()
    labels = F.split("host", r"\.", -1)
    ends = [F.when(F.size(labels) > n, F.struct(F.array_join(F.reverse(F.slice(labels, -n, n)), ".").alias("k"), F.lit(False).alias("own"))) for n in shape["counts"]]
    # The whole host's key carries the row; keys of its suffixes need the number only.
    suffixes = F.array_compact(F.array(F.struct(F.array_join(F.reverse(labels), ".").alias("k"), F.lit(True).alias("own")), *ends))
    asked = rows.withColumn("s", F.explode(suffixes))
    own = F.col("s.own")
    carried = [*(f"k{i}" for i in range(len(keep))), "host", "path"]
    asked = asked.select("uid", *(F.when(own, F.col(c)).alias(c) for c in carried), F.when(own, 1).otherwise(2).alias("kind"), F.concat(F.col("s.k"), F.lit("/"), F.left(F.col("path"), F.lit(shape["reach"]))).alias("key"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("action"))
    types = dict(asked.dtypes)
    opened = known.select(F.lit(-1).cast("long").alias("uid"), *(F.lit(None).cast(types[c]).alias(c) for c in carried), F.lit(0).alias("kind"), F.concat(_reversed(F.col("h")), F.lit("/"), F.col("p")).alias("key"), F.concat("h", "p").alias("name"), "action")
    order = ["key", "kind", "uid"]
    dealt = checkpointed(asked.unionByName(opened).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    stacks = chained(dealt.mapInArrow(_ends, "part int, first string, last string, open array<array<string>>").collect())
    width = 1 + len(carried)
    found = dealt.mapInArrow(functools.partial(_match, stacks, width), ", ".join([*(f"{c} {types[c]}" for c in ["uid", *carried]), "rule string", "rule_action string"]))
    rank = F.struct(F.length("rule").alias("n"), F.col("rule").alias("rule"), F.col("rule_action").alias("action"))
    best = found.groupBy("uid").agg(*(F.max(c).alias(c) for c in carried), F.max(F.when(F.col("rule").isNotNull(), rank)).alias("best"))
    return best.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
