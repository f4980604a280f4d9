"""Table access, scratch tables in the shared folder, and small expressions that several operators use."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_own_dir: dict[str, str] = {}
_written: dict[str, SparkSession] = {}
#: For each thread, the tables that each tidy function under way in it has written.
_calls = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for an unset setting in local mode."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dir.setdefault("path", "file://" + tempfile.mkdtemp(prefix="larkspur-"))


class Staged:
    """A table written to the shared folder: it cuts the lineage and outlives any executor."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/larkspur-{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        _written[self.path] = self.spark
        if stack := getattr(_calls, "stack", None):
            stack[-1].append(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows fixed in their partitions and order, in the shared folder; the cleaner deletes them with the result."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _written.pop(path, None)


def tidy(f: Callable) -> Callable:
    """The scratch tables that a function writes go when it returns, but for those that it returns as ``Staged``; tables of
    other calls, such as of another thread's, stay."""

    @functools.wraps(f)
    def run(*args, **named):
        stack = _calls.__dict__.setdefault("stack", [])
        stack.append([])
        try:
            out = f(*args, **named)
            kept = {x.path for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, Staged)}
        except BaseException:
            stack.pop()
            raise
        mine = stack.pop()
        for path in mine:
            if path in _written and path not in kept:
                _delete(_written[path], path)
        if stack:
            stack[-1].extend(p for p in mine if p in kept)
        return out

    return run


def clean_up(spark: SparkSession) -> int:
    """Delete the scratch tables that results of this session have been read from; call it when those are written."""
    paths = list(_written)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the documents whose labels are never learned from, and for a null id."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters keep their case, so that no letter turns into an ASCII one."""
    each = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(each)  # pure ASCII has a faster way


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
