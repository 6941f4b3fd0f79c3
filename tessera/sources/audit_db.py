"""Audit logs in SQLite files as a Spark data source with pushed filters (S13, 2.15 search backend).

Register AuditSource, then `spark.read.format("audit_sqlite").option("path", folder).load()`. Each file is cut into ranges of row
numbers, one partition each; comparisons of columns with values are answered by SQLite, so that its indexes serve and other rows
are never sent. SQLite reads local files only: the folder must be mounted on every executor.

Files without the table give no rows, and columns that a file lacks are null."""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

#: The columns of an audit log.
COLUMNS = {"event_id": "string", "request_id": "string", "session_id": "string", "timestamp": "double", "tool_name": "string", "tier_applied": "string", "status": "string", "duration_ms": "double", "input_summary": "string", "output_summary": "string", "error": "string"}
TABLE = "tool_calls"
COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def condition(f: Filter) -> tuple[str, list] | None:
    """A filter as SQL with its values, if it is one that SQLite answers as Spark does."""
    column = getattr(f, "attribute", ())
    if len(column) != 1 or column[0] not in COLUMNS:
        return None
    name, value = f'"{column[0]}"', getattr(f, "value", None)
    if type(f) in COMPARE and value is not None:
        return f"{name} {COMPARE[type(f)]} ?", [value]
    if isinstance(f, In) and value and None not in value:
        return f"{name} IN ({', '.join('?' * len(value))})", list(value)
    if isinstance(f, IsNotNull):
        return f"{name} IS NOT NULL", []
    if isinstance(f, StringContains):
        return f"instr({name}, ?) > 0", [value]
    if isinstance(f, StringStartsWith):
        return f"substr({name}, 1, length(?)) = ?", [value, value]
    if isinstance(f, StringEndsWith):
        return f"length({name}) >= length(?) AND substr({name}, length({name}) - length(?) + 1) = ?", [value, value, value]
    return None


@dataclass
class Range(InputPartition):
    """Rows first to before last of a file, by SQLite's row numbers."""

    path: str
    first: int
    last: int


class AuditReader(DataSourceReader):
    """Reads ranges of rows that meet the pushed filters."""

    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows, self.where, self.values = path, rows, [], []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if (made := condition(f)) is None:
                yield f
            else:
                self.where.append(made[0])
                self.values += made[1]

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, "*.db"))) if os.path.isdir(self.path) else [self.path]
        out: list[InputPartition] = []
        for name in files:
            with closing(_open(name)) as db:
                if not _columns(db):
                    continue
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {TABLE}").fetchone()
                if low is not None:
                    out += [Range(name, k, min(k + self.rows, high + 1)) for k in range(low, high + 1, self.rows)]
        return out or [Range("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        with closing(_open(partition.path)) as db:
            own = _columns(db)
            picked = ", ".join(f'"{c}"' if c in own else f'NULL AS "{c}"' for c in COLUMNS)
            where = "".join(f" AND ({w})" for w in self.where)
            yield from db.execute(f"SELECT * FROM (SELECT {picked} FROM {TABLE} WHERE rowid >= ? AND rowid < ?) WHERE TRUE{where}", [partition.first, partition.last, *self.values])


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _columns(db: sqlite3.Connection) -> set[str]:
    return {r[1] for r in db.execute(f"PRAGMA table_info({TABLE})")}


class AuditSource(DataSource):
    """Format audit_sqlite. Options: path (a file, or a folder of .db files), rows (in a partition, 100,000 by default)."""

    @classmethod
    def name(cls) -> str:
        """The name of the format."""
        return "audit_sqlite"

    def schema(self) -> str:
        """The columns of an audit log."""
        return ", ".join(f"{c} {kind}" for c, kind in COLUMNS.items())

    def reader(self, schema) -> AuditReader:
        """A reader of the option's path."""
        return AuditReader(self.options["path"], int(self.options.get("rows", "100000")))
