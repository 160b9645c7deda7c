"""Mutable tables: immutable Parquet parts and a numbered manifest that lists them.

A change writes new parts and then commits manifest n + 1; what is read is never overwritten, and a failed change
leaves files that no manifest names. INSERT adds a part; UPDATE and DELETE rewrite the parts that hold changed rows;
ALTER changes the manifest alone, but for a new type. One writer a table: the second of two concurrent commits fails.

Parts hold columns under field names that a column keeps when it is renamed and that are never used again. A part that
is older than a column has the column's first default.

A table that others reference can't be dropped or renamed, nor the column they name; its rows may go or change only
while every reference still finds its row.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sql import ast as A
from .files import Store


class TableError(ValueError):
    """A statement that the catalog's state or a constraint forbids."""


SPARK_TYPES = {"INT": T.IntegerType(), "BIGINT": T.LongType(), "VARCHAR": T.StringType(), "BOOLEAN": T.BooleanType(), "TEXT": T.StringType(), "TIMESTAMP": T.TimestampNTZType()}


@dataclass
class Column_:
    name: str
    type: str
    length: int | None = None
    primary: bool = False
    unique: bool = False
    required: bool = False
    default: list | None = None  # [kind, text, sign]
    parent: list | None = None  # [table, column]
    field: str = ""  # its name in parts
    first: list | None = None  # the default for parts that are older than the column

    @classmethod
    def of(cls, d: A.ColumnDef) -> Column_:
        default = d.get("default")
        if default is not None:
            sign = default.op if isinstance(default, A.Unary) else "+"
            lit = default.operand if isinstance(default, A.Unary) else default
            default = [lit.kind, lit.text, sign]
        return cls(d.name, d.type.name, d.type.length, d.has("primary key"), d.has("unique"), d.has("not null") or d.has("primary key"), default, list(d.get("references")) if d.has("references") else None)

    @property
    def spark(self) -> T.DataType:
        return SPARK_TYPES[self.type]

    def default_column(self, older: bool = False) -> Column:
        default = self.first if older else self.default
        if default is None or default[0] == "null":
            return F.lit(None).cast(self.spark)
        kind, text, sign = default
        value: object = text.upper() == "TRUE" if kind == "boolean" else text
        if kind in ("integer", "float"):
            return (F.lit(sign + text) if sign == "-" else F.lit(text)).cast("double" if "." in text or "e" in text.lower() else self.spark).cast(self.spark)
        return F.lit(value).cast(self.spark)


@dataclass
class Manifest:
    version: int
    columns: list[Column_]
    parts: list[list]  # [name, fields it has]
    fields: int = 0  # field names used so far

    def column(self, name: str) -> Column_:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise TableError(f"unknown column {name}")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark) for c in self.columns])

    def next(self, **changed) -> Manifest:
        out = Manifest(**(self.__dict__ | {"version": self.version + 1} | changed))
        out.columns = [replace(c) for c in out.columns]
        for c in out.columns:
            if not c.field:
                c.field = f"f{out.fields}"
                out.fields += 1
        return out


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.views: dict[str, DataFrame] = {}

    # -- databases

    def has_database(self, db: str) -> bool:
        return self.store.exists(db.lower())

    def create_database(self, db: str, unless: bool = False) -> None:
        if self.has_database(db):
            if unless:
                return
            raise TableError(f"database {db} exists")
        self.store.make(db.lower())

    def drop_database(self, db: str, maybe: bool = False) -> None:
        if not self.has_database(db):
            if maybe:
                return
            raise TableError(f"unknown database {db}")
        if self.store.names(db.lower()):
            raise TableError(f"database {db} is not empty")
        self.store.remove(db.lower())

    # -- tables

    def _at(self, db: str, table: str) -> str:
        return f"{db.lower()}/{table.lower()}"

    def has(self, db: str, table: str) -> bool:
        return bool(self._versions(db, table))

    def _versions(self, db: str, table: str) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.store.names(self._at(db, table)) if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, db: str, table: str) -> Manifest:
        versions = self._versions(db, table)
        if not versions:
            raise TableError(f"unknown table {table}")
        raw = json.loads(self.store.read(f"{self._at(db, table)}/manifest-{versions[-1]}.json"))
        return Manifest(versions[-1], [Column_(**c) for c in raw["columns"]], raw["parts"], raw["fields"])

    def _commit(self, db: str, table: str, m: Manifest) -> None:
        text = json.dumps({"columns": [c.__dict__ for c in m.columns], "parts": m.parts, "fields": m.fields})
        if not self.store.commit(f"{self._at(db, table)}/manifest-{m.version}.json", text):
            raise TableError(f"table {table} was changed meanwhile")

    def create(self, db: str, table: str, columns: list[Column_], unless: bool = False) -> None:
        if self.has(db, table):
            if unless:
                return
            raise TableError(f"table {table} exists")
        if not self.has_database(db):
            raise TableError(f"unknown database {db}")
        names = [c.name.lower() for c in columns]
        if len(set(names)) < len(names):
            raise TableError("a column name is used twice")
        if sum(c.primary for c in columns) > 1:
            raise TableError("a table takes one PRIMARY KEY")
        for c in columns:
            self._check_parent(db, c)
        self.store.make(self._at(db, table))
        self._commit(db, table, Manifest(0, columns, []).next())

    def _check_parent(self, db: str, c: Column_) -> None:
        if c.parent:
            self.manifest(db, c.parent[0]).column(c.parent[1])

    def drop(self, db: str, table: str, maybe: bool = False) -> None:
        if not self.has(db, table):
            if maybe:
                return
            raise TableError(f"unknown table {table}")
        self._refuse_if_referenced(db, table)
        self.store.remove(self._at(db, table))

    def rename(self, db: str, table: str, new: str) -> None:
        if self.has(db, new):
            raise TableError(f"table {new} exists")
        self.manifest(db, table)
        self._refuse_if_referenced(db, table)
        self.store.rename(self._at(db, table), self._at(db, new))

    def read(self, db: str, table: str) -> DataFrame:
        return self._read(db, table, self.manifest(db, table))

    def _read(self, db: str, table: str, m: Manifest, with_part: bool = False) -> DataFrame:
        """The rows under the columns' names; with_part, also the part each is in, as a last column."""
        groups: dict[tuple[str, ...], list[str]] = {}
        for name, fields in m.parts:
            groups.setdefault(tuple(fields), []).append(name)
        out = None
        for fields, names in groups.items():
            has = [c for c in m.columns if c.field in fields]
            schema = T.StructType([T.StructField(c.field, c.spark) for c in has])
            df = self.spark.read.schema(schema).parquet(*[self.store.full(f"{self._at(db, table)}/{n}") for n in names])
            cols = [(F.col(c.field) if c.field in fields else c.default_column(older=True)).alias(c.name) for c in m.columns]
            if with_part:
                cols.append(F.regexp_extract("_metadata.file_path", "/(part-[0-9a-f]{32})/", 1))
            df = df.select(*cols)
            out = df if out is None else out.unionAll(df)
        if out is None:
            schema = m.schema.add("part", T.StringType()) if with_part else m.schema
            out = self.spark.createDataFrame([], schema)
        return out

    def _write(self, db: str, table: str, df: DataFrame, columns: list[Column_]) -> list:
        """A new part of df, whose columns are those given, in order."""
        part, fields = f"part-{uuid.uuid4().hex}", [c.field for c in columns]
        df.toDF(*fields).write.parquet(self.store.full(f"{self._at(db, table)}/{part}"))
        return [part, fields]

    # -- changes

    def check(self, db: str, columns: list[Column_], new: DataFrame, old: DataFrame | None) -> None:
        """Constraints of new rows; keys are compared with old rows too. Only faults' counts come to the driver."""
        tests = []
        for c in columns:
            if c.required:
                tests.append(F.count_if(F.col(f"`{c.name}`").isNull()).alias(f"NOT NULL of {c.name}"))
            if c.length:
                tests.append(F.count_if(F.length(f"`{c.name}`") > c.length).alias(f"length of {c.name}"))
        if tests:
            row = new.agg(*tests).first()
            for k, v in row.asDict().items():
                if v:
                    raise TableError(f"{v} rows break {k}")
        for c in columns:
            keys = new.select(F.col(f"`{c.name}`").alias("k")).where("k IS NOT NULL")
            if c.primary or c.unique:
                # the new keys among themselves, and against old ones: these are only read, not grouped
                twice = keys.groupBy("k").count().where("count > 1").limit(1).count()
                if twice or old is not None and keys.join(old.select(F.col(f"`{c.name}`").alias("k")), "k", "left_semi").limit(1).count():
                    raise TableError(f"{'PRIMARY KEY' if c.primary else 'UNIQUE'} of {c.name} is broken")
            if c.parent:
                parent = self.read(db, c.parent[0]).select(F.col(f"`{self.manifest(db, c.parent[0]).column(c.parent[1]).name}`").alias("k"))
                if keys.join(parent, "k", "left_anti").limit(1).count():
                    raise TableError(f"REFERENCES of {c.name} is broken")

    def references(self, db: str, table: str, column: str | None = None) -> list[tuple[str, Column_]]:
        """The (table, column) of the database that reference the table, or its column."""
        out = []
        for name in self.store.names(db.lower()):
            if self.has(db, name):
                out += [(name, c) for c in self.manifest(db, name).columns if c.parent and c.parent[0].lower() == table.lower() and (column is None or c.parent[1].lower() == column.lower())]
        return out

    def _refuse_if_referenced(self, db: str, table: str, column: str | None = None) -> None:
        for name, c in self.references(db, table, column):
            if column is not None or name.lower() != table.lower():
                raise TableError(f"{table}{f'.{column}' if column else ''} is referenced by {name}.{c.name}")

    def append(self, db: str, table: str, df: DataFrame) -> None:
        """df has the table's columns, in order."""
        m = self.manifest(db, table)
        part = self._write(db, table, df, m.columns)
        try:
            new = self._read(db, table, m.next(parts=[part]))
            self.check(db, m.columns, new, self._read(db, table, m) if m.parts else None)
            self._commit(db, table, m.next(parts=[*m.parts, part]))
        except Exception:
            self.store.remove(f"{self._at(db, table)}/{part[0]}")
            raise

    def change(self, db: str, table: str, hit: Column, new: dict[str, Column] | None, names: list[str]) -> None:
        """Delete the rows that hit (new is None), or give their columns new values. hit and new are over columns named names."""
        m = self.manifest(db, table)
        rows = self._read(db, table, m, with_part=True).toDF(*names, "part")
        parts = {r["part"] for r in rows.where(hit).select("part").distinct().collect()}  # a table's parts are few
        if not parts:
            return
        touched = [p for p in m.parts if p[0] in parts]
        rest = [p for p in m.parts if p[0] not in parts]
        old = self._read(db, table, m.next(parts=touched)).toDF(*names)
        if new is None:
            out, changed = old.where(~hit), m.columns
        else:
            out = old.select(*[F.when(hit, new[c.name]).otherwise(F.col(n)).alias(n) if c.name in new else F.col(n) for c, n in zip(m.columns, names, strict=True)])
            changed = [c for c in m.columns if c.name in new]
        part = self._write(db, table, out, m.columns)
        after = m.next(parts=[*rest, part])
        try:
            if new is not None:
                self.check(db, changed, self._read(db, table, m.next(parts=[part])), self._read(db, table, m.next(parts=rest)) if rest else None)
            self._check_children(db, table, after, {c.name.lower() for c in changed})
            self._commit(db, table, after)
        except Exception:
            self.store.remove(f"{self._at(db, table)}/{part[0]}")
            raise

    def _check_children(self, db: str, table: str, after: Manifest, changed: set[str]) -> None:
        for name, c in self.references(db, table):
            column = after.column(c.parent[1])
            if column.name.lower() not in changed:
                continue
            child = self._read(db, table, after) if name.lower() == table.lower() else self.read(db, name)
            keys = child.select(F.col(f"`{c.name}`").alias("k")).where("k IS NOT NULL")
            if keys.join(self._read(db, table, after).select(F.col(f"`{column.name}`").alias("k")), "k", "left_anti").limit(1).count():
                raise TableError(f"{table} has rows that {name}.{c.name} references")

    def alter(self, db: str, table: str, a: A.AlterTable) -> None:
        m = self.manifest(db, table)
        new = Column_.of(a.column) if a.column is not None else None
        if new:
            self._check_parent(db, new)
        taken = {c.name.lower() for c in m.columns}
        match a.action:
            case "add":
                if new.name.lower() in taken:
                    raise TableError(f"column {new.name} exists")
                if new.primary and any(c.primary for c in m.columns):
                    raise TableError("a table takes one PRIMARY KEY")
                new.first = new.default
                after = m.next(columns=[*m.columns, new])
                self.check(db, [after.columns[-1]], self._read(db, table, after), None)
            case "modify":
                old = m.column(new.name)
                new.name = old.name
                if new.primary and any(c.primary and c is not old for c in m.columns):
                    raise TableError("a table takes one PRIMARY KEY")
                if new.type == old.type:  # only constraints: parts stay
                    new.field, new.first = old.field, old.first
                    after = m.next(columns=[new if c is old else c for c in m.columns])
                    self.check(db, [new], self._read(db, table, after), None)
                else:
                    self._retype(db, table, m, old, new)
                    return
            case "rename column":
                old = m.column(a.old)
                if a.new.lower() in taken - {old.name.lower()}:
                    raise TableError(f"column {a.new} exists")
                self._refuse_if_referenced(db, table, old.name)
                after = m.next(columns=[replace(c, name=a.new) if c is old else c for c in m.columns])
            case _:
                old = m.column(a.old)
                if len(m.columns) == 1:
                    raise TableError("the only column cannot be dropped")
                self._refuse_if_referenced(db, table, old.name)
                after = m.next(columns=[c for c in m.columns if c is not old])
        self._commit(db, table, after)

    def _retype(self, db: str, table: str, m: Manifest, old: Column_, new: Column_) -> None:
        """Another type: every part is written again."""
        after = m.next(columns=[new if c is old else c for c in m.columns], parts=[])
        at = m.columns.index(old)
        if not m.parts:
            self._commit(db, table, after)
            return
        df = self._read(db, table, m)
        df = df.select(*[F.col(f"`{c.name}`").cast(after.columns[at].spark).alias(c.name) if c is old else F.col(f"`{c.name}`") for c in m.columns])
        part = self._write(db, table, df, after.columns)
        after.parts = [part]
        try:
            self.check(db, [after.columns[at]], self._read(db, table, after), None)
            self._check_children(db, table, after, {new.name.lower()})
            self._commit(db, table, after)
        except Exception:
            self.store.remove(f"{self._at(db, table)}/{part[0]}")
            raise
