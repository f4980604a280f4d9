"""Files and tables in any store that Spark's readers open, by Hadoop's file systems; scratch tables; small JSON files."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scratch: list[tuple[SparkSession, str]] = []


def _shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for an unset setting in local mode."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault("path", "file://" + tempfile.mkdtemp(prefix="larkspur-"))


def fixed(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: written once, read by column, and independent of any executor. It stays
    until ``clean_up``."""
    spark = df.sparkSession
    path = f"{_shared_dir(spark)}/larkspur-core-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which stays until ``clean_up``."""
    path = f"{_shared_dir(spark)}/larkspur-core-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    make_dirs(spark, path)
    return f"{path}/{name}"


def clean_up(since: int = 0) -> None:
    """Delete the scratch tables, but for the first ``since``; to be called when what reads them is written."""
    while len(_scratch) > since:
        delete(*_scratch.pop())


def scratch_tables() -> int:
    return len(_scratch)


def together(*jobs: Callable) -> list:
    """What each of the jobs gives; they run side by side, as none needs another."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def _at(spark: SparkSession, path: str):
    """The path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def is_file(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def size(spark: SparkSession, path: str) -> int:
    p, fs = _at(spark, path)
    return fs.getFileStatus(p).getLen()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def make_dirs(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.mkdirs(p)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """To a path that must not exist."""
    a, fs = _at(spark, source)
    b, _ = _at(spark, target)
    if fs.exists(b) or not fs.rename(a, b):
        raise OSError(f"can't rename {source} to {target}")


def replace(spark: SparkSession, source: str, target: str) -> None:
    """In one step, where the store can."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    a, fs = _at(spark, source)
    b, _ = _at(spark, target)
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    try:
        context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    except Py4JJavaError:  # a store without that interface: two steps
        fs.delete(b, False)
        rename(spark, source, target)
        return
    context.rename(fs.makeQualified(a), fs.makeQualified(b), options)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _created(spark: SparkSession, path: str):
    """A stream to a new file, without the side file of checksums that a local store would put beside it."""
    p, fs = _at(spark, path)
    fs.setWriteChecksum(False)
    try:
        return fs.create(p, True)
    finally:
        fs.setWriteChecksum(True)


def write_chunks(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> None:
    """A new file of bytes that come one after the other."""
    stream = _created(spark, path)
    try:
        for c in chunks:
            stream.write(bytearray(c))
        stream.flush()
        stream.hsync() if stream.hasCapability("hsync") else None
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced in one step after its bytes are stored."""
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}.draft" if folder else f".{name}.draft"
    write_chunks(spark, draft, [text.encode()])
    replace(spark, draft, path)


def write_json(spark: SparkSession, path: str, content: dict) -> None:
    write_text(spark, path, json.dumps(content, indent=2, ensure_ascii=False) + "\n")


def write_lines(rows: DataFrame, order: str, column: str, path: str) -> None:
    """One file of lines in the order of a column: sorted and written in parallel, then joined end to end by streams."""
    joined_text(rows.orderBy(order).select(column), path)


def joined_text(rows: DataFrame, path: str, read: Callable | None = None) -> None:
    """One file of lines, written in parallel and joined end to end by streams in the driver's JVM; ``read`` puts another
    stream, such as a decoder's, around a part's."""
    spark = rows.sparkSession
    folder = f"{_shared_dir(spark)}/larkspur-lines-{uuid.uuid4().hex}"
    rows.write.text(folder)
    base, fs = _at(spark, folder)
    copy, conf = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes, spark._jsc.hadoopConfiguration()
    stream = _created(spark, path)
    try:
        for part in sorted((s.getPath() for s in fs.listStatus(base) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
            piece = read(fs.open(part)) if read else fs.open(part)
            try:
                copy(piece, stream, conf, False)
            finally:
                piece.close()
    finally:
        stream.close()
        fs.delete(base, True)


def file_sha256(spark: SparkSession, path: str) -> str:
    """Hashed as a stream in the driver's JVM: a SHA-256 is sequential."""
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def table_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """file (its path in the folder), length and sha256 of each file of the folder's Parquet tables.

    Each file passes once, as a stream and never whole, through the driver's JVM, a few files at a time.
    """
    path, store = _at(spark, folder)
    base = store.makeQualified(path).toString() + "/"
    found = []
    for entry in store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(base + "*.parquet")) or []:
        files = store.listFiles(entry.getPath(), True)
        while files.hasNext():
            status = files.next()
            name = status.getPath().toString().removeprefix(base)
            if not any(part.startswith(("_", ".")) for part in name.split("/")):
                found.append((name, status.getLen()))
    with ThreadPoolExecutor(4) as pool:
        sums = list(pool.map(lambda name: file_sha256(spark, base + name), [name for name, _ in found]))
    return spark.createDataFrame([(n, length, d) for (n, length), d in zip(found, sums, strict=True)], "file string, length long, sha256 string")
