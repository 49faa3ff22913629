"""SQLite tables through the Python data source API: `spark.read.format("sqlite")`.

Options: `path` and `table`, and optionally `partitions` (default 8), which cuts the row ids into ranges, or the first column
of the key where there are none. Filters that SQLite decides as Spark does are pushed down to its indexes, and a schema that is
given (`.schema("a long")`) names the only columns that are read. The file is opened read-only; where a writer has locked it, a copy in a temporary file is read. It must be reachable from the
executors under the same path.
"""

from __future__ import annotations

import math
import shutil
import sqlite3
import tempfile
from collections.abc import Iterator
from contextlib import closing, contextmanager
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)
from pyspark.sql.types import StructType

_KINDS = (("INT", "long"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))


def _locked(db: sqlite3.Connection) -> bool:
    try:
        db.execute("SELECT 1 FROM sqlite_master LIMIT 1").fetchall()
    except sqlite3.OperationalError as why:
        if "locked" not in str(why):
            raise
        return True
    return False


@contextmanager
def _connect(path: str) -> Iterator[sqlite3.Connection]:
    """A connection to the database, or to a copy of it if it is locked."""
    with closing(sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True, timeout=1)) as db:
        if not _locked(db):
            yield db
            return
    with tempfile.TemporaryDirectory() as folder:
        copy = shutil.copy(path, folder)
        if Path(f"{path}-wal").exists():  # what was committed but not yet put in the main file
            shutil.copy(f"{path}-wal", folder)
        with closing(sqlite3.connect(f"file:{quote(copy)}", uri=True)) as db:
            yield db


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _kind(declared: str | None) -> str | None:
    """The type that a column's declaration says that its values are kept as; none where it leaves that open."""
    return next((k for sign, k in _KINDS if sign in (declared or "").upper()), None)


#: The most values of a set that is pushed down.
MOST_VALUES = 500
_COMPARED = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def condition(asked: Filter, kinds: dict[str, str]) -> tuple[str, list] | None:
    """SQL and parameters that give what Spark gives for a filter, null for null included; none where SQLite may see it differently.

    Only columns whose values are kept as their declared kind are compared (`kinds`), with values of that kind, and texts by their bytes.
    """
    if isinstance(asked, Not):
        inner = condition(asked.child, kinds)
        return inner and (f"NOT ({inner[0]})", inner[1])
    if len(asked.attribute) != 1 or asked.attribute[0] not in kinds:
        return None
    kind, column = kinds[asked.attribute[0]], _quoted(asked.attribute[0])
    if isinstance(asked, IsNull | IsNotNull):
        return f"{column} IS {'NOT ' if isinstance(asked, IsNotNull) else ''}NULL", []
    values = list(asked.value) if isinstance(asked, In) else [asked.value]
    fits = {"long": lambda v: type(v) is int and abs(v) < 1 << 63, "double": lambda v: type(v) in (int, float) and math.isfinite(v), "string": lambda v: type(v) is str and "\0" not in v}.get(kind)
    if fits is None or len(values) > MOST_VALUES or not all(v is None or fits(v) for v in values):
        return None
    own = f"{column} COLLATE BINARY" if kind == "string" else column
    if isinstance(asked, In):
        return f"{own} IN ({', '.join('?' * len(values))})", values
    if sign := _COMPARED.get(type(asked)):
        return f"{own} {sign} ?", values
    if kind != "string" or not values[0]:
        return None
    if isinstance(asked, StringStartsWith):
        return f"({own} >= ? AND substr({column}, 1, {len(values[0])}) = ? COLLATE BINARY)", values * 2
    if isinstance(asked, StringEndsWith):
        return f"substr({column}, -{len(values[0])}) = ? COLLATE BINARY", values
    return (f"instr({column}, ?) > 0", values) if isinstance(asked, StringContains) else None


@dataclass
class Part(InputPartition):
    """Rows whose `by` is from `first` on and below `end`, each if there is one."""

    by: str = ""
    first: object = None
    end: object = None


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with _connect(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']!r}")
        return ", ".join(f"`{c[1].replace('`', '``')}` {_kind(c[2]) or 'string'}" for c in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.parts, self.fields = options["path"], options["table"], int(options.get("partitions", 8)), schema.fields
        self.wheres: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the name that Spark calls
        with _connect(self.path) as db:
            declared = {c[1]: _kind(c[2]) for c in db.execute(f"PRAGMA table_info({_quoted(self.table)})")}
        read_as = {f.name: f.dataType.simpleString().replace("bigint", "long") for f in self.fields}
        kinds = {name: kind for name, kind in declared.items() if kind and read_as.get(name) == kind}
        for asked in filters:
            found = condition(asked, kinds)
            if found is None:
                yield asked
            else:
                self.wheres.append(found)

    def partitions(self) -> list[Part]:
        table = _quoted(self.table)
        with _connect(self.path) as db:
            columns = db.execute(f"PRAGMA table_info({table})").fetchall()
            taken = {c[1].lower() for c in columns}
            for by in {"rowid", "_rowid_", "oid"} - taken:
                try:
                    low, high = db.execute(f"SELECT min({by}), max({by}) FROM {table}").fetchone()
                except sqlite3.OperationalError:  # a view or a table without row ids
                    break
                if low is None:
                    return [Part()]
                step = -(-(high - low + 1) // self.parts)
                return [Part(by, a, None if a + step > high else a + step) for a in range(low, high + 1, step)]
            keys = [_quoted(c[1]) for c in sorted(columns, key=lambda c: c[5]) if c[5]]
            if not keys:
                return [Part()]
            # by the first column of the key, in shares of equal numbers of rows; rows that are equal there stay together
            n = db.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
            bounds = [db.execute(f"SELECT {keys[0]} FROM {table} ORDER BY {keys[0]} LIMIT 1 OFFSET ?", (n * i // self.parts,)).fetchone() for i in range(1, self.parts)]
        bounds = list(dict.fromkeys(b[0] for b in bounds if b))
        return [Part(keys[0], a, b) for a, b in zip([None, *bounds], [*bounds, None], strict=True)]

    def read(self, partition: Part) -> Iterator[tuple]:
        names = ", ".join(_quoted(f.name) for f in self.fields) or "1"
        text = [f.dataType.simpleString() == "string" for f in self.fields]
        wheres = [*self.wheres, *((f"{partition.by} {sign} ?", [v]) for sign, v in ((">=", partition.first), ("<", partition.end)) if v is not None)]
        sql = f"SELECT {names} FROM {_quoted(self.table)}" + (" WHERE " + " AND ".join(w for w, _ in wheres) if wheres else "")
        with _connect(self.path) as db:
            for row in db.execute(sql, [v for _, values in wheres for v in values]):
                yield tuple(str(v) if t and v is not None and not isinstance(v, str) else v for v, t in zip(row, text, strict=False))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
