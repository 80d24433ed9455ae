"""SQLite files as a data source: ``spark.read.format("sqlitefile").option("table", t).load(path)``."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KINDS = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


class SqliteSource(DataSource):
    """Rows of one table or view, dealt out by ranges of rowid; the path must be one that every worker can open."""

    @classmethod
    def name(cls) -> str:
        return "sqlitefile"

    def schema(self) -> T.StructType:
        with _connect(self.options["path"]) as db:
            columns = db.execute("SELECT name, type FROM pragma_table_info(?)", (self.options["table"],)).fetchall()
        return T.StructType([T.StructField(n, _KINDS.get(k.upper(), T.StringType())) for n, k in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", 4)))


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, parts: int):
        self.path, self.table, self.schema, self.parts = path, table, schema, parts

    def partitions(self) -> list[InputPartition]:
        """Ranges of rowid; one part for views and tables without rowids."""
        table = self.table.replace('"', '""')
        with _connect(self.path) as db:
            try:
                low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
            except sqlite3.OperationalError:
                low = high = None
        if not isinstance(low, int):
            return [InputPartition(None)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [InputPartition((at, at + step - 1)) for at in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        quoted = ", ".join('"{}"'.format(n.replace('"', '""')) for n in self.schema.names)
        convert = [float if isinstance(f.dataType, T.DoubleType) else str if isinstance(f.dataType, T.StringType) else (lambda v: v) for f in self.schema.fields]
        table = self.table.replace('"', '""')
        where = " WHERE rowid BETWEEN ? AND ?" if partition.value else ""
        with _connect(self.path) as db:
            for row in db.execute(f'SELECT {quoted} FROM "{table}"{where}', partition.value or ()):
                yield tuple(v if v is None else f(v) for v, f in zip(row, convert, strict=True))


def write_sqlite(df: DataFrame, path: str, table: str, batch: int = 1000) -> None:
    """Replace ``table`` of a local SQLite file by ``df``, streamed through the driver."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "binary": "BLOB"}
    columns = ", ".join(f'"{n}" {kinds.get(k, "TEXT")}' for n, k in df.dtypes)
    db = sqlite3.connect(path)
    try:
        with db:
            db.execute(f'DROP TABLE IF EXISTS "{table}"')
            db.execute(f'CREATE TABLE "{table}" ({columns})')
            rows: list[tuple] = []
            insert = f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})'
            for r in df.toLocalIterator():
                rows.append(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r))
                if len(rows) == batch:
                    db.executemany(insert, rows)
                    rows = []
            db.executemany(insert, rows)
    finally:
        db.close()
