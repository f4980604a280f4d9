"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct word shingles (A-Z lower-cased, words split at ASCII white space). Two documents
are linked if 100 times the intersection is at least 80 times the union; groups are connected components of links.

1. One pass turns each text into a 128-bit name of its set, the set's size and 125 minimum hashes. Documents with equal
   sets are one node from there on, so copies cost no comparisons.
2. 25 bands of 5 hashes: nodes that agree in a band share a bucket. A pair at the threshold is missed by all bands
   with probability 5e-5. In the first ``HUB_BANDS`` bands each bucket compares its members with its smallest node
   only: as many rows as members.
3. Verification looks at batches of 25 hashes. After each, a pair goes if, given its matches and a uniform prior, the
   probability that its similarity reaches the threshold is below ``miss``. Whoever is left after the last batch is
   confirmed on the full sets, rebuilt from the two texts.
4. Components of those links. What is undecided then are pairs of a bucket in different components: members outside
   the bucket's home component are compared with all its members, in blocks of ``BLOCK`` rows, by the same batches,
   within the task on 64-bit shingle sets, and what links is confirmed as before. So each pair of each bucket is in one component, or has been compared: no cap. Copies
   and large families, which earlier steps have joined, are never enumerated as pairs.

Cases: a text without words (or null) has an empty set, no links, and is its own component. With fewer words than a
shingle has, the whole sequence is the one shingle. Null ids are ignored by the minimum; a group of only null ids has
a null component, and its rows are kept (of a filter's rows one). Rows with equal ids and texts are equal results. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import matrix, sorted_groups
from ._common import Staged, tidy
from ._graph import connected_components, opaque

BANDS, ROWS, BATCH = 25, 5, 25
HASHES = BANDS * ROWS
HUB_BANDS = 5
BLOCK = 1024
MISS = 1e-6
_WORDS_KEPT = 300_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() and bytes.split() know ASCII only, as the definition asks."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], width: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    size = min(width, n)
    h = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        h = h * _PRIME + ids[i : n - size + 1 + i]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return np.unique(h)


def exact_set(text: str | None, width: int) -> set:
    words = words_of(text)
    return set(zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else ({tuple(words)} if words else set())


def minimums(hashes: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(hashes), 2048):
        np.minimum(low, (_A[:, None] * hashes[None, s : s + 2048] + _B[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def _sketch(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHash()
    for batch in batches:
        sizes, names, sigs = [], [], []
        done: dict[bytes, bytes] = {}
        for text in batch.column(2).to_pylist():
            h = shingle_hashes(words_of(text), width, known)
            sizes.append(len(h))
            if not len(h):
                names.append(None)
                sigs.append(None)
                continue
            name = xxhash.xxh3_128_digest(h.tobytes())
            if name not in done:
                done[name] = minimums(h).tobytes()
            names.append(name)
            sigs.append(done[name])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "text_key", "n_shingles", "node", "sig"])


@functools.cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For each batch, the fewest matches m of the n hashes so far with P(similarity >= threshold | m of n) >= miss.
    Under a uniform prior that is the probability of at most m successes in n + 1 trials at the threshold."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Indexes of the rows of signatures a and b (either may be one row for all) that no batch rules out."""
    n = max(len(a), len(b))
    left, matched = np.arange(n), np.zeros(n, np.int64)
    for k, m in enumerate(least):
        cols = slice(k * BATCH, (k + 1) * BATCH)
        x = a[left, cols] if len(a) == n else a[:, cols]
        y = b[left, cols] if len(b) == n else b[:, cols]
        matched = matched + (x == y).sum(axis=1)
        keep = matched >= m
        left, matched = left[keep], matched[keep]
    return left


def _judge(least: tuple[int, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keep = survivors(matrix(batch.column(2), "<u4", HASHES), matrix(batch.column(3), "<u4", HASHES), least)
            yield batch.select([0, 1]).take(pa.array(keep))


def _blocks(batches: Iterator[pa.RecordBatch], least: tuple[int, ...]) -> Iterator[tuple]:
    """For each group of (bucket, i, j): the group, its components' numbers, and for each row of side 0, one after the
    other, the rows of side 1 in other components that no batch of hashes rules out, in the pair's first common band.
    Components may be merged meanwhile."""
    for group in sorted_groups(batches, ["bucket", "i", "j"]):
        names, comps = (group.column(c).to_pylist() for c in ("node", "component"))
        sigs, band = matrix(group.column("sig"), "<u4", HASHES), group.column("band")[0].as_py()
        side, away = group.column("side").to_numpy(), group.column("away").to_numpy(zero_copy_only=False)
        number = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        comp = np.array([number[c] for c in comps])
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        right = np.flatnonzero(side == 1)

        def near(comp=comp, side=side, away=away, rank=rank, right=right, sigs=sigs, band=band):
            for x in np.flatnonzero(side == 0):
                other = right[(comp[right] != comp[x]) & (~away[right] | (rank[right] > rank[x]))]
                if len(other):
                    other = other[survivors(sigs[[x]], sigs[other], least)]
                    common = (sigs[other] == sigs[x]).reshape(-1, BANDS, ROWS).all(axis=2)
                    yield x, other[common.argmax(axis=1) == band]

        yield group, names, comp, near()


def _wanted(least: tuple[int, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose sets a group must see: those with a partner that the signatures leave."""
    for group, _, _, near in _blocks(batches, least):
        some = np.zeros(group.num_rows, bool)
        for x, others in near:
            some[others] = True
            some[x] |= len(others) > 0
        if some.any():
            yield from group.filter(pa.array(some)).combine_chunks().to_batches()


def _judge_blocks(least: tuple[int, ...], width: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between rows of (bucket, i, j): side 0 against side 1, in different components, in the pair's first common
    band. Links found merge components, so those of one block form a forest."""
    known = _WordHash()
    for group, names, comp, near in _blocks(batches, least):
        texts = group.column("text")
        sets: dict[int, set[int]] = {}

        def of(i: int, sets=sets, texts=texts) -> set[int]:
            if i not in sets:
                sets[i] = set(shingle_hashes(words_of(texts[i].as_py()), width, known).tolist())
            return sets[i]

        found = []
        for x, others in near:
            for y in others:
                if comp[x] != comp[y]:
                    p, q = of(x), of(y)
                    both = len(p & q)
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        found.append((min(names[x], names[y]), max(names[x], names[y])))
                        comp[comp == comp[y]] = comp[x]
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _confirm(width: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, kept = None, set()
    for batch in batches:
        a, b, at, bt = (batch.column(i) for i in range(4))
        keep = []
        for i in range(batch.num_rows):
            name = a[i].as_py()
            if name != last:
                last, kept = name, exact_set(at[i].as_py(), width)
            other = exact_set(bt[i].as_py(), width)
            both = len(kept & other)
            keep.append(100 * both >= percent * (len(kept) + len(other) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


@tidy
def _grouped(docs: DataFrame, width: int, percent: int, miss: float) -> tuple[Staged, Staged]:
    """doc_id, text_key, n_shingles, node, sig for each row; s (a node), component_id, first (the group's first row: its
    id, or null, and text_key) for each set."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    sketch_type = "doc_id long, text_key long, n_shingles long, node binary, sig binary"
    sketch = Staged(keyed.mapInArrow(functools.partial(_sketch, width), sketch_type), "sketch")
    nodes = Staged(sketch.df.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("ref"), F.min("sig").alias("sig")), "nodes").df
    sigs = nodes.select("node", "sig")
    least = least_matches(percent / 100, miss)

    def bands(rows: DataFrame, n: int) -> DataFrame:
        keys = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
        return rows.select("node", *(c for c in rows.columns if c == "component"), F.posexplode(keys).alias("band", "bucket"))

    def grouped(stars: DataFrame) -> DataFrame:
        """Nodes with the component that they are in so far."""
        return nodes.join(stars.withColumnRenamed("node", "s"), F.col("node") == F.col("s"), "left").select("node", F.coalesce("component", "node").alias("component"), "sig")

    def tested(pairs: DataFrame) -> DataFrame:
        judged = _with(pairs, sigs, "sig").mapInArrow(functools.partial(_judge, least), "a binary, b binary")
        return _confirmed(judged, nodes, keyed, width, percent)

    def merged(stars: DataFrame, links: DataFrame) -> DataFrame:
        if links.isEmpty():
            return stars
        return Staged(connected_components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)), "stars").df

    first = bands(sigs, HUB_BANDS)
    hubs = first.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select(opaque("bucket").alias("k"), "hub")
    pairs = first.join(hubs, F.col("bucket") == F.col("k")).where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = Staged(connected_components(tested(pairs)), "stars").df

    members = _members(bands(grouped(stars), BANDS))
    rest = _undecided(members, nodes, keyed, least, width, percent)
    stars = merged(stars, _confirmed(rest, nodes, keyed, width, percent))

    named = nodes.select("node", "least_id", "ref").join(stars.withColumnRenamed("node", "s"), F.col("node") == F.col("s"), "left").select("node", "least_id", "ref", F.coalesce("component", "node").alias("component"))
    named = Staged(named, "named").df
    first = named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.min("ref").alias("first")).select(opaque("component").alias("c"), "component_id", "first")
    return sketch, Staged(named.join(first, F.col("component") == F.col("c")).select(F.col("node").alias("s"), "component_id", "first"), "components")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """doc_id, text_key (a 64-bit hash of the text), n_shingles, component_id, kept for each row of ``docs``."""
    sketched, result = (x.df for x in _grouped(docs, width, percent, miss))
    some = sketched.where("node is not null").join(result, F.col("node") == F.col("s")).select("doc_id", "text_key", "n_shingles", "component_id")
    none = sketched.where("node is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _with(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """a, b and the column of each."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(f"{side}_node"), F.col(column).alias(f"{side}_{column}")), F.col(side) == F.col(f"{side}_node")).drop(f"{side}_node")
    return pairs.select("a", "b", f"a_{column}", f"b_{column}")


def _texts(wanted: DataFrame, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """node, text: for each wanted node a text that has its set."""
    refs = wanted.select(opaque("node").alias("w")).join(nodes, F.col("w") == F.col("node")).select("node", F.col("ref.doc_id").alias("i"), F.col("ref.text_key").alias("k"))
    found = keyed.join(refs, keyed["doc_id"].eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")))
    return Staged(found.groupBy("node").agg(F.min("text").alias("text")), "texts").df


def _confirmed(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs that the full sets of their texts confirm."""
    pairs = Staged(pairs.distinct(), "pairs").df
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, keyed)
    full = _with(pairs, texts, "text").sortWithinPartitions("a")
    return Staged(full.mapInArrow(functools.partial(_confirm, width, percent), "a binary, b binary"), "links").df


def _members(banded: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component; away: outside the bucket's home component."""
    homes = banded.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "node").alias("home"))
    homes = homes.where("low != high").select(opaque("bucket").alias("k"), "home")
    return Staged(banded.join(homes, F.col("bucket") == F.col("k")).select("band", "bucket", "node", "component", (F.col("component") != F.col("home")).alias("away")), "members").df


def _undecided(members: DataFrame, nodes: DataFrame, keyed: DataFrame, least: tuple[int, ...], width: int, percent: int) -> DataFrame:
    """Links between a bucket's members in different components: those away meet all members, in blocks, first by
    signatures alone; then the members that have a partner left meet again with their texts."""
    sigs = nodes.select("node", "sig")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("away").alias("away_n"))
    sizes = sizes.select(opaque("bucket").alias("k"), F.ceil(F.col("n") / BLOCK).cast("int").alias("nj"), F.ceil(F.col("away_n") / BLOCK).cast("int").alias("ni"))
    mixed = members.join(sizes, F.col("bucket") == F.col("k")).drop("k")
    place = F.xxhash64("node")
    left = mixed.where("away").withColumn("i", F.pmod(place, F.col("ni")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))).withColumn("side", F.lit(0))
    right = mixed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).withColumn("j", F.pmod(place, F.col("nj")).cast("int")).withColumn("side", F.lit(1))
    cols = ["bucket", "i", "j", "side", "band", "node", "component", "away"]
    rows = left.select(*cols).unionByName(right.select(*cols)).join(sigs.withColumnRenamed("node", "s"), F.col("node") == F.col("s")).drop("s")
    blocks = lambda rows: rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    kind = "bucket long, i int, j int, side int, band int, node binary, component binary, away boolean, sig binary"
    wanted = Staged(blocks(rows).mapInArrow(functools.partial(_wanted, least), kind), "wanted").df
    texts = _texts(wanted.select("node").distinct(), nodes, keyed)
    rows = wanted.join(texts.withColumnRenamed("node", "t"), F.col("node") == F.col("t")).drop("t")
    return blocks(rows).mapInArrow(functools.partial(_judge_blocks, least, width, percent), "a binary, b binary")


@tidy
def _kept(docs: DataFrame, width: int, percent: int) -> Staged:
    """__near_id, __near_key (id and text_key) and __near_n (rows) of what stays: a group's first row, and each id's rows
    without words."""
    sketched, result = (x.df for x in _grouped(docs, width, percent, MISS))
    some = sketched.where("node is not null").join(result, F.col("node") == F.col("s"))
    some = some.where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    kept = some.select("doc_id", "text_key").unionByName(sketched.where("node is null").select("doc_id", "text_key"))
    return Staged(kept.groupBy(F.col("doc_id").alias("__near_id"), F.col("text_key").alias("__near_key")).agg(F.count(F.lit(1)).alias("__near_n")), "kept")


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only: one of each group, whatever ids repeat. That is the
    row of the smallest id (of none, where no id is), and of its texts the one whose hash is smallest. Rows without
    words are no group's: they stay, once for each id and text."""
    kept = _kept(docs, width, percent).df
    out = docs.join(kept.drop("__near_n"), docs["doc_id"].eqNullSafe(F.col("__near_id")) & (F.xxhash64(docs["text"]) == F.col("__near_key")), "left_semi")
    return out if kept.where("__near_n > 1").isEmpty() else out.dropDuplicates(["doc_id", "text"])
