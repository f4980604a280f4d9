"""Small tables as Parquet folders, and comparisons."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
DOCUMENTS = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
EMBEDDINGS = {"vec_id": pa.int64(), "embedding": pa.list_(pa.float32()), "label": pa.int32()}
PAGES = {"page_id": pa.int64(), "url": pa.string(), "html": pa.string()}
LABELS = {"doc_id": pa.int64(), "quality": pa.int32(), "toxic": pa.int32()}
CONVERSATIONS = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
#: Columns that a caller's table may have beside those that are read; operators use most of these names for their own.
CLASHES = ["node", "bucket", "component", "component_id", "band", "kept", "score", "rank", "held_out", "predicted", "host", "path", "rule", "verdict", "uid", "kind", "part", "key", "size", "target", "taken", "whole", "cut", "ids", "decoded", "x", "y", "place", "k", "s", "n", "a", "b", "parts", "loss", "formatted", "attachments", "base", "detections", "n_words", "q", "block", "dim", "label_"]


def write(folder, **tables) -> str:
    """tables: name to (types, rows), rows as tuples in the order of the types."""
    for name, (types, rows) in tables.items():
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
        pq.write_table(pa.table({n: pa.array(list(c), t) for (n, t), c in zip(types.items(), cols, strict=True)}), f"{folder}/{name}.parquet")
    return str(folder)


def with_clashes(types: dict, rows: list[tuple]) -> tuple[dict, list[tuple]]:
    """The same table with columns of other types under names that operators use themselves."""
    extra = [c for c in CLASHES if c not in types]
    return types | {c: pa.string() for c in extra}, [(*r, *["clash"] * len(extra)) for r in rows]


def documents(rows: list[tuple]) -> tuple[dict, list[tuple]]:
    """(doc_id, text[, source]) to the documents table."""
    return DOCUMENTS, [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", None if r[1] is None else len(r[1])) for r in rows]


def rows_of(df, cols=None) -> list[tuple]:
    """Rows as tuples, sorted; doubles to 9 digits."""
    cols = cols or sorted(df.columns)
    shown = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(shown(r[c]) for c in cols) for r in df.select(*cols).collect()), key=repr)


def sql_rows(folder: str, sql: str, *tables: str) -> list[tuple]:
    """What DuckDB makes of the same tables; columns by name."""
    db = duckdb.connect()
    for t in tables:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = db.sql(sql)
    names = got.columns
    order = [names.index(c) for c in sorted(names)]
    shown = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(shown(r[i]) for i in order) for r in got.fetchall()), key=repr)
