"""Versioned, checksummed vector bundles: publish and load.

A version is a folder with vectors.f32 (little-endian rows), ads.jsonl and manifest.json, beside LATEST, which names the
current one. A version appears by one rename and becomes current by another; nothing is ever overwritten. The files
are single and ordered by nature: lines and packed vectors are sorted and written in parallel and joined end to end by
streams. All paths are those of any store that Spark's readers open.
"""

from __future__ import annotations

import binascii
import functools
import json
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLEAN, CLEAN_COLUMNS
from ..sources.lines import numbered_lines
from ..storage import delete, exists, file_sha256, fixed, is_file, joined_text, make_dirs, read_text, rename, size, write_json, write_lines, write_text
from .embed import load_clean
from .vectors import TOLERANCE, integrity, top_k

# The format's version, and the bytes that a line of ads.jsonl may have.
FORMAT = 1
LINE_CAP = 1 << 20
#: Rows of a packed piece of a vector file.
_PIECE = 4096


class BundleError(RuntimeError):
    """A bundle can't be published or loaded."""


class ManifestError(BundleError): ...


class ChecksumError(BundleError): ...


class VectorsError(BundleError): ...


class AdsError(BundleError): ...


class PublishError(BundleError): ...


def plain_name(name: object) -> bool:
    return isinstance(name, str) and name not in ("", ".", "..") and not re.search(r"[/\\]", name)


def _demand(ok: object, error: type[BundleError], message: str) -> None:
    if not ok:
        raise error(message)


def check_manifest(m: dict) -> dict:
    """The manifest itself, after every check that needs no other file."""
    try:
        model, vectors, ads = m["model"], m["vectors"], m["ads"]
        facts = [
            (m["format_version"] == FORMAT, "format version"), ((vectors["dtype"], vectors["byte_order"], vectors["layout"]) == ("float32", "little", "row_major"), "vector layout"),
            (model["normalized"] is True and model["similarity"] == "dot", "similarity"), (vectors["count"] > 0 and vectors["dim"] > 0, "shape"), (vectors["dim"] == model["dim"], "dimension of model and vectors"),
            (vectors["count"] == ads["count"], "counts of vectors and ads"), (vectors["bytes"] == vectors["count"] * vectors["dim"] * 4, "size in bytes"),
            (plain_name(vectors["file"]) and plain_name(ads["file"]), "file names"), (vectors["sha256"] and ads["sha256"], "checksums"),
        ]
    except (KeyError, TypeError) as error:
        raise ManifestError(f"incomplete: {error!r}") from error
    for ok, what in facts:
        _demand(ok, ManifestError, f"manifest: {what}")
    return m


def latest(spark: SparkSession, root: str) -> str:
    """The current version's folder."""
    pointer = f"{root.rstrip('/')}/LATEST"
    if not is_file(spark, pointer):
        raise ManifestError(f"no pointer in {root}") from FileNotFoundError(pointer)
    name = read_text(spark, pointer).strip()
    _demand(plain_name(name), ManifestError, f"pointer {name!r} is no plain name")
    return f"{root.rstrip('/')}/{name}"


def _pieces(records: Iterator[tuple], width: int) -> Iterator[tuple]:
    """(offset, bytes) of single records to (first row, bytes) of up to ``_PIECE`` that follow one another."""
    first, held = 0, []
    for at, body in records:
        row = at // width
        if held and (row != first + len(held) or len(held) == _PIECE):
            yield first, bytearray(b"".join(held))
            held = []
        if not held:
            first = row
        held.append(bytes(body))
    if held:
        yield first, bytearray(b"".join(held))


def _unpacked(dim: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            flat = np.frombuffer(body.as_buffer(), "<f4")
            n = len(flat) // dim
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), vectors], ["row", "vector"])


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """row, vector of a file of little-endian floats. Splits are read in parallel as fixed-length records, each with its
    place in the file; pieces of them are unpacked as Arrow columns."""
    width, kind = 4 * dim, "row long, vector array<float>"
    if not size(spark, path) // width:
        return spark.createDataFrame([], kind)
    io = "org.apache.hadoop.io"
    raw = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", f"{io}.LongWritable", f"{io}.BytesWritable", conf={"fixedlengthinputformat.record.length": str(width)})
    packed = raw.mapPartitions(functools.partial(_pieces, width=width))
    return spark.createDataFrame(packed, "first long, body binary").mapInArrow(functools.partial(_unpacked, dim), kind)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vector to lines of Base64 of little-endian floats. Each line but a partition's last holds whole groups of three
    bytes, so that the lines of a partition are one Base64 text."""
    rest = b""
    for batch in batches:
        for s in range(0, batch.num_rows, _PIECE):
            body = rest + batch.column(0).slice(s, _PIECE).flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
            whole = len(body) - len(body) % 3
            body, rest = body[:whole], body[whole:]
            yield pa.RecordBatch.from_arrays([pa.array([binascii.b2a_base64(body, newline=False).decode()])], ["body"])
    if rest:
        yield pa.RecordBatch.from_arrays([pa.array([binascii.b2a_base64(rest, newline=False).decode()])], ["body"])


def write_vectors(rows: DataFrame, path: str) -> None:
    """A file of the vectors of row, vector in the order of row: sorted and packed in parallel as lines of text, then
    decoded and joined end to end by streams, so that no vector comes to the driver as a result."""
    packed, java = rows.orderBy("row").select("vector").mapInArrow(_packed, "body string"), rows.sparkSession._jvm.java
    decoder = java.util.Base64.getMimeDecoder()
    joined_text(packed, path, lambda part: decoder.wrap(java.io.BufferedInputStream(part, 1 << 16)))


def ends_of(rows: DataFrame) -> DataFrame:
    """One row over row, ad_id: n, the first and the last id (a, z), blank (ids without text)."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min_by("ad_id", "row").alias("a"), F.max_by("ad_id", "row").alias("z"), F.count_if(F.trim("ad_id") == "").alias("blank"))


def aligned(clean: DataFrame, vectors: DataFrame) -> DataFrame:
    """The rows whose record and vector have the same id."""
    return clean.join(vectors, ["row", "ad_id"])


def publish(spark: SparkSession, clean_path: str, embedded_dir: str, root: str) -> dict:
    """Verifies, writes a version beside the others, and makes it current last. What was current stays so on failure."""
    source, out = embedded_dir.rstrip("/"), root.rstrip("/")
    for p in (clean_path, f"{source}/embed_manifest.json", f"{source}/embedded.parquet"):
        if not exists(spark, p):
            raise FileNotFoundError(p)
    told = json.loads(read_text(spark, f"{source}/embed_manifest.json"))
    _demand(told["source_sha256"] == file_sha256(spark, clean_path), PublishError, "the clean file has changed since it was embedded")
    clean = fixed(load_clean(spark, clean_path))
    vectors = spark.read.parquet(f"{source}/embedded.parquet").select("row", "ad_id", "vector")
    ends = ends_of(clean).first()
    ids = repeated_ids(clean).limit(1).collect()
    state = integrity(vectors, told["dim"]).first()
    matched = aligned(clean, vectors).count()
    for ok, what in (
        (ends["n"] > 0, "there are no records"), (ends["n"] == told["count"] == state["n"], f"{ends['n']} records, {state['n']} vectors, {told['count']} in the manifest"),
        (state["wrong_dim"] == 0, f"{state['wrong_dim']} vectors of another dimension"), (ends["a"] == told["first_ad_id"] and ends["z"] == told["last_ad_id"], "first or last id differs"),
        (matched == ends["n"], "ids of records and vectors differ by row"), (ends["blank"] == 0, "blank ids"), (not ids, "repeated ids"), (state["nonfinite"] == 0, f"{state['nonfinite']} vectors aren't finite"),
        (state["off_unit"] == 0, f"{state['off_unit']} vectors aren't of unit length ({state['least_norm']} to {state['most_norm']})"),
    ):
        _demand(ok, PublishError, str(what))
    make_dirs(spark, out)
    stage = f"{out}/.staging-{uuid.uuid4().hex}"
    make_dirs(spark, stage)
    try:
        write_vectors(vectors, f"{stage}/vectors.f32")
        write_lines(clean.select("row", F.to_json(F.struct("row", *CLEAN_COLUMNS)).alias("told")), "row", "told", f"{stage}/ads.jsonl")
        digest = file_sha256(spark, f"{stage}/vectors.f32")
        now = datetime.now(UTC)
        # Fixed names: the manifest's fields.
        manifest = dict(
            format_version=FORMAT, created_at=f"{now:%Y-%m-%dT%H:%M:%SZ}",
            model={k: told[s] for k, s in (("name", "model"), ("revision", "revision"), ("dim", "dim"), ("max_tokens", "max_tokens"))} | {"normalized": True, "similarity": "dot"},
            vectors=dict(file="vectors.f32", count=ends["n"], dim=told["dim"], bytes=size(spark, f"{stage}/vectors.f32"), sha256=digest, dtype="float32", layout="row_major", byte_order="little"),
            ads=dict(file="ads.jsonl", sha256=file_sha256(spark, f"{stage}/ads.jsonl"), count=ends["n"]),
            source=dict(clean_file=clean_path, clean_sha256=told["source_sha256"], embedded_at=told["created_at"], tokens=told["tokens"], device=told["device"]),
        )
        write_json(spark, f"{stage}/manifest.json", check_manifest(manifest))
        version = f"{now:%Y%m%dT%H%M%SZ}-{digest[:8]}"
        _demand(not exists(spark, f"{out}/{version}"), PublishError, f"version {version} exists")
        rename(spark, stage, f"{out}/{version}")
    finally:
        delete(spark, stage)
    write_text(spark, f"{out}/LATEST", version + "\n")
    return manifest | {"version": version}


class Bundle:
    """A verified version. ``rows`` has row, the clean columns and vector."""

    def __init__(self, manifest: dict, rows: DataFrame, version: str = "", folder: str = ""):
        self.version, self.folder = version, folder
        self.manifest, self.rows, self.count, self.dim = manifest, rows, manifest["ads"]["count"], manifest["vectors"]["dim"]

    def __len__(self) -> int:
        return self.count

    def vector(self, row: int) -> list[float]:
        return self.rows.where(F.col("row") == row).first()["vector"]

    def row_of(self, ad_id: str) -> int | None:
        found = self.rows.where(F.col("ad_id") == ad_id).select("row").first()
        return found["row"] if found else None

    def top_k(self, query: list[float], k: int) -> DataFrame:
        if len(query) != self.dim:
            raise ValueError(f"the query has {len(query)} dimensions, the bundle {self.dim}")
        return top_k(self.rows, query, k)


def load(spark: SparkSession, root: str) -> Bundle:
    return load_version(spark, latest(spark, root))


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """A version's manifest, checked."""
    try:
        return check_manifest(json.loads(read_text(spark, f"{folder}/manifest.json")))
    except (OSError, ValueError, Py4JJavaError) as error:
        raise ManifestError(f"no readable manifest in {folder}") from error


def check_vectors(spark: SparkSession, path: str, spec: dict) -> DataFrame:
    """row, vector, after size, checksum and rows."""
    if not is_file(spark, path):
        raise VectorsError(f"{path} is missing") from FileNotFoundError(path)
    _demand(size(spark, path) == spec["bytes"], VectorsError, f"{path} isn't {spec['bytes']} bytes long")
    _demand(file_sha256(spark, path) == spec["sha256"], ChecksumError, path)
    vectors = read_vectors(spark, path, spec["dim"])
    state = integrity(vectors, spec["dim"]).first()
    _demand(state["nonfinite"] == 0 and state["off_unit"] == 0, VectorsError, f"row {state['first_bad_row']} isn't a finite unit vector (tolerance {TOLERANCE})")
    return vectors


def check_ads(spark: SparkSession, path: str, spec: dict) -> DataFrame:
    """row and the clean columns, after order, ids, count and checksum."""
    if not is_file(spark, path):
        raise AdsError(f"{path} is missing") from FileNotFoundError(path)
    lines = numbered_lines(spark, path)
    rows = fixed(lines.select((F.col("line_no") - 1).alias("at"), F.octet_length("line").alias("size"), F.from_json("line", f"row long, {CLEAN}, broken string", {"columnNameOfCorruptRecord": "broken"}).alias("r")))
    r = F.col("r")
    bad = rows.where((F.col("size") > LINE_CAP) | r.isNull() | r["broken"].isNotNull() | r["row"].isNull() | (r["row"] != F.col("at")) | (F.coalesce(r["ad_id"], F.lit("")) == "")).agg(F.min("at")).first()[0]
    _demand(bad is None, AdsError, f"line {bad} is malformed or out of order")
    twice = repeated_ids(rows.select("r.ad_id")).limit(1).collect()
    _demand(not twice, AdsError, "an id occurs twice")
    n = rows.count()
    _demand(n == spec["count"], AdsError, f"{n} records, {spec['count']} in the manifest")
    _demand(file_sha256(spark, path) == spec["sha256"], ChecksumError, path)
    return rows.select("r.*").drop("broken")


def repeated_ids(rows: DataFrame, column: str = "ad_id") -> DataFrame:
    """The column's values that occur more than once, with their number."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def load_version(spark: SparkSession, folder: str) -> Bundle:
    """Checks the cheapest first: manifest; size, checksum and rows of vectors; records."""
    folder = folder.rstrip("/")
    manifest = read_manifest(spark, folder)
    vectors = check_vectors(spark, f"{folder}/{manifest['vectors']['file']}", manifest["vectors"])
    ads = check_ads(spark, f"{folder}/{manifest['ads']['file']}", manifest["ads"])
    return Bundle(manifest, fixed(ads.join(vectors, "row")), folder.rpartition("/")[2], folder)


def report(bundle: Bundle) -> str:
    m = bundle.manifest
    return f"version {bundle.version}: {m['ads']['count']:,} records, {bundle.dim} dimensions, {m['vectors']['bytes']:,} bytes, model {m['model']['name']}"


def summary(manifest: dict) -> str:
    """A published version in a few lines."""
    v, a = manifest["vectors"], manifest["ads"]
    return "\n".join([
        f"version {manifest['version']}: {a['count']:,} records, {v['dim']} dimensions, model {manifest['model']['name']}",
        f"{v['file']}: {v['bytes']:,} bytes, sha256 {v['sha256'][:16]}",
        f"{a['file']}: sha256 {a['sha256'][:16]}",
    ])
