"""From trees to DataFrames: names are resolved and every clause becomes a DataFrame operation for Catalyst.

Semantics that the grammar leaves open: NULLs sort last in both directions; numbers are true if not zero; SUM of a
condition counts it; LIKE has no escape character; / is fractional and % truncates; GROUP BY and ORDER BY names mean an
input column first, then a select alias; unknown functions and ordinals are faults.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import AGGREGATES, aggregate
from ..sql import ast as A
from ..sql.diagnostics import Diagnostic, Position, Span

_NOWHERE = Span(Position(1, 1, 0), Position(1, 1, 0))


class Fault(Diagnostic):
    pass


def fault(code: int, message: str, node: A.Node, source: str) -> Fault:
    return Fault(code, "Semantic Error", message, node.span or _NOWHERE, source)


class Scope:
    """What names mean: entries (qualifiers, column name, Column, type), names compared without case."""

    def __init__(self, source: str):
        self.source = source
        self.entries: list[tuple[tuple[str, ...], str, Column, T.DataType]] = []

    def add(self, qualifiers: tuple[str, ...], df: DataFrame, at: A.Node | None = None) -> DataFrame:
        """df with columns under names of their own, which this scope knows."""
        if any(q == qualifiers for q, *_ in self.entries):
            raise fault(3002, f"table name {qualifiers[-1]} is used twice", at, self.source)
        k = len(self.entries)
        inner = [f"c{k + i}" for i in range(len(df.columns))]
        for name, f in zip(inner, df.schema.fields, strict=True):
            self.entries.append((qualifiers, f.name, F.col(name), f.dataType))
        return df.toDF(*inner)

    def find(self, n: A.Name) -> list[tuple[Column, T.DataType]]:
        low = n.name.lower()
        return [(c, t) for q, name, c, t in self.entries if name.lower() == low and (n.qualifier is None or q[-1].lower() == n.qualifier.lower())]

    def resolve(self, n: A.Name) -> tuple[Column, T.DataType]:
        found = self.find(n)
        if not found:
            raise fault(3001, f"unknown column {n.qualifier + '.' if n.qualifier else ''}{n.name}", n, self.source)
        if len(found) > 1:
            raise fault(3002, f"column {n.name} is ambiguous", n, self.source)
        return found[0]


class Lowering:
    """Expressions over a scope. known: subtrees that stand for columns already computed (groups and aggregates)."""

    def __init__(self, scope: Scope, known: Callable[[A.Expr], tuple[Column, T.DataType] | None] | None = None):
        self.scope, self.known = scope, known or (lambda e: None)

    def fail(self, code: int, message: str, node: A.Node):
        raise fault(code, message, node, self.scope.source)

    def literal(self, e: A.Literal) -> tuple[Column, T.DataType]:
        match e.kind:
            case "integer":
                v = int(e.text)
                if v >= 1 << 63:
                    self.fail(3004, f"integer {e.text} is out of range", e)
                return F.lit(v), T.IntegerType() if v < 1 << 31 else T.LongType()
            case "float":
                if "e" in e.text.lower():
                    return F.lit(float(e.text)), T.DoubleType()
                d = Decimal(e.text.rstrip(".") if e.text.endswith(".") else e.text)
                digits = max(len(d.as_tuple().digits), -d.as_tuple().exponent, 1)
                if digits > 38:
                    self.fail(3004, f"number {e.text} is out of range", e)
                return F.lit(d), T.DecimalType(digits, max(0, -d.as_tuple().exponent))
            case "string":
                return F.lit(e.text), T.StringType()
            case "boolean":
                return F.lit(e.text.upper() == "TRUE"), T.BooleanType()
            case _:
                return F.lit(None), T.NullType()

    def both(self, e: A.Expr) -> tuple[Column, T.DataType]:
        if (found := self.known(e)) is not None:
            return found
        match e:
            case A.Literal():
                return self.literal(e)
            case A.Name():
                return self.scope.resolve(e)
            case A.Paren(inner=inner):
                return self.both(inner)
            case A.Unary(op=op, operand=x):
                c, t = self.both(x)
                return (-c if op == "-" else c), t
            case A.Binary(op=op, left=l, right=r):
                (a, ta), (b, tb) = self.both(l), self.both(r)
                for side, t in ((l, ta), (r, tb)):
                    if isinstance(t, (T.StringType, T.BooleanType)):
                        self.fail(3005, f"{op} needs numbers", side)
                return {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "%": a % b}[op], T.DoubleType()
            case A.Call(name=name):
                if name.upper() in AGGREGATES:
                    self.fail(3006, f"{name} is not allowed here", e)
                self.fail(3007, f"unknown function {name}", e)
            case _:
                return self.condition(e), T.BooleanType()

    def column(self, e: A.Expr) -> Column:
        return self.both(e)[0]

    def truth(self, e: A.Expr) -> Column:
        c, t = self.both(e)
        if isinstance(t, (T.BooleanType, T.NullType)):
            return c.cast("boolean")
        if isinstance(t, T.NumericType):
            return c != 0
        self.fail(3008, "a condition must be true or false, or a number", e)

    def condition(self, e: A.Expr) -> Column:
        match e:
            case A.Compare(op=op, left=l, right=r):
                a, b = self.column(l), self.column(r)
                return {"=": a == b, "!=": a != b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
            case A.Like(operand=x, pattern=p, negated=n):
                inner = p
                while isinstance(inner, A.Paren):
                    inner = inner.inner
                if isinstance(inner, A.Literal) and inner.kind == "string":
                    pattern = F.lit(inner.text.replace("\\", "\\\\"))
                else:
                    pattern = F.replace(self.column(p), F.lit("\\"), F.lit("\\\\"))
                c = F.like(self.column(x), pattern)
                return ~c if n else c
            case A.IsNull(operand=x, negated=n):
                return self.column(x).isNotNull() if n else self.column(x).isNull()
            case A.InList(operand=x, items=items, negated=n):
                c = self.column(x).isin(*map(self.column, items))
                return ~c if n else c
            case A.Between(operand=x, low=lo, high=hi, negated=n):
                c = self.column(x).between(self.column(lo), self.column(hi))
                return ~c if n else c
            case A.Logic(op=op, left=l, right=r):
                return self.truth(l) & self.truth(r) if op == "AND" else self.truth(l) | self.truth(r)
            case A.Not(operand=x):
                return ~self.truth(x)
        raise AssertionError(e)


def calls(e: object) -> list[A.Call]:
    """Aggregate calls in a tree, outermost only."""
    if isinstance(e, A.Call) and e.name.upper() in AGGREGATES:
        return [e]
    if isinstance(e, tuple):
        return [c for x in e for c in calls(x)]
    if isinstance(e, A.Node):
        return [c for f in e.__dataclass_fields__ if f != "span" for c in calls(getattr(e, f))]
    return []


def bare(e: A.Expr) -> A.Expr:
    while isinstance(e, A.Paren):
        e = e.inner
    return e


class SelectLowering:
    def __init__(self, select: A.Select, source: str, table: Callable[[A.TableName], tuple[DataFrame, str]], one_row: DataFrame):
        self.q, self.source, self.table, self.one_row = select, source, table, one_row
        self.scope = Scope(source)

    def primary(self, t: A.TableName) -> DataFrame:
        df, database = self.table(t)
        return self.scope.add((t.alias,) if t.alias else (database, t.name), df, t)

    def ref(self, r: A.TableRef) -> DataFrame:
        if r.paren is not None:
            return self.ref(r.paren)
        first = len(self.scope.entries)
        df = self.primary(r.primary)
        for j in r.joins:
            right = self.primary(j.right)
            if j.kind == "cross":
                df = df.crossJoin(right)
            else:
                seen = Scope(self.source)
                seen.entries = self.scope.entries[first:]
                df = df.join(right, Lowering(seen).truth(j.on), j.kind)
        return df

    def stars(self, item: A.SelectItem) -> list[tuple[str, Column, A.Expr | None]]:
        want = tuple(x.lower() for x in item.star_of)
        found = [(name, c, A.Name(name, q[-1])) for q, name, c, _ in self.scope.entries if not want or tuple(x.lower() for x in q[-len(want) :]) == want]
        if not found:
            raise fault(3003, f"unknown table {'.'.join(item.star_of)}" if want else "SELECT * needs a table", item, self.source)
        return found

    def run(self) -> DataFrame:
        q = self.q
        df = None
        for r in q.tables:
            part = self.ref(r)
            df = part if df is None else df.crossJoin(part)  # with the WHERE below, Catalyst makes it an equi join
        if df is None:
            df = self.one_row
        plain = Lowering(self.scope)
        if q.where is not None:
            if found := calls(q.where):
                raise fault(3006, f"{found[0].name} is not allowed in WHERE", found[0], self.source)
            df = df.where(plain.truth(q.where))
        aliases = {i.alias.lower(): i.expr for i in q.items if i.alias}
        every = calls((*[i.expr for i in q.items if i.expr], q.having, *[o.expr for o in q.order or ()]))
        low = plain
        if every or q.group is not None or q.having is not None:
            df, low = self.grouped(df, every, aliases)
            if q.having is not None:
                df = df.where(low.truth(q.having))
        out: list[tuple[str, Column, A.Expr | None]] = []
        for i in q.items:
            if i.expr is None:
                if low is not plain:
                    out += [(n, low.column(e), e) for n, _, e in self.stars(i)]
                else:
                    out += self.stars(i)
            else:
                inner = bare(i.expr)
                name = i.alias or (inner.name if isinstance(inner, A.Name) else self.text(i.expr))
                out.append((name, low.column(i.expr), i.expr))
        return self.finish(df, low, out, aliases)

    def text(self, e: A.Expr) -> str:
        raw = self.source.encode()
        return raw[e.span.start.offset : e.span.end.offset].decode()

    def grouped(self, df: DataFrame, every: list[A.Call], aliases: dict[str, A.Expr]) -> tuple[DataFrame, Lowering]:
        """One aggregation that computes every aggregate of SELECT, HAVING and ORDER BY under names of its own."""
        plain, source = Lowering(self.scope), self.source
        keys: list[tuple[A.Expr, Column, T.DataType]] = []
        for n in self.q.group or ():
            e: A.Expr = n
            if not self.scope.find(n) and n.qualifier is None and n.name.lower() in aliases:
                e = aliases[n.name.lower()]
                if calls(e):
                    raise fault(3006, "an aggregate cannot be grouped by", n, source)
            keys.append((bare(e), *plain.both(e)))
        inner = [c.alias(f"k{i}") for i, (_, c, _) in enumerate(keys)]
        aggs, types, distinct_calls = [], [], list(dict.fromkeys(every))
        for i, c in enumerate(distinct_calls):
            name = c.name.upper()
            if c.star and name != "COUNT":
                raise fault(3009, f"{name}(*) is not a function", c, source)
            if not c.star and (not c.args or len(c.args) > 1 and not (name == "COUNT" and c.distinct)):
                raise fault(3009, f"{name} takes one argument", c, source)
            if found := calls(c.args):
                raise fault(3006, f"{found[0].name} is not allowed inside {name}", found[0], source)
            args = [plain.both(a) for a in c.args]
            cols = [x.cast("int") if name in ("SUM", "AVG") and isinstance(t, T.BooleanType) else x for x, t in args]
            names = [f"a{i}_{j}" for j in range(len(cols))]
            inner += [x.alias(n) for x, n in zip(cols, names, strict=True)]
            aggs.append(aggregate(name, [F.col(n) for n in names], names, c.distinct, c.star).alias(f"g{i}"))
            types.append(args[0][1] if name in ("MIN", "MAX") else T.LongType() if name == "COUNT" else T.DoubleType())
        df = df.select(*inner) if inner else df
        group = [F.col(f"k{i}") for i in range(len(keys))]
        df = df.groupBy(*group).agg(*(aggs or [F.count("*").alias("rows")])) if group or aggs else df.agg(F.count("*").alias("rows"))
        at = {c: (F.col(f"g{i}"), types[i]) for i, c in enumerate(distinct_calls)}
        cols = {str(c): (F.col(f"k{i}"), t) for i, (_, c, t) in enumerate(keys)}
        whole = {e: (F.col(f"k{i}"), t) for i, (e, _, t) in enumerate(keys)}

        def known(e: A.Expr):
            if isinstance(e, A.Call):
                return at.get(e)
            if e in whole:
                return whole[e]
            if isinstance(e, A.Name) and e.qualifier is None and not self.scope.find(e) and (x := bare(aliases.get(e.name.lower(), e))) in whole:
                return whole[x]
            if isinstance(e, A.Name):
                found = cols.get(str(self.scope.resolve(e)[0]))
                if found is None:
                    raise fault(3010, f"column {e.name} must be grouped by or aggregated", e, source)
                return found
            return None

        return df, Lowering(self.scope, known)

    def finish(self, df: DataFrame, low: Lowering, out: list, aliases: dict[str, A.Expr]) -> DataFrame:
        q = self.q
        hidden: list[Column] = []
        orders: list[Column] = []
        listed = {bare(e): i for i, (_, _, e) in enumerate(out) if e is not None}
        for o in q.order or ():
            e = bare(o.expr)
            if isinstance(e, A.Literal):
                raise fault(3011, "ORDER BY takes expressions, not ordinals or constants", o, self.source)
            if isinstance(e, A.Name) and e.qualifier is None and not self.scope.find(e) and e.name.lower() in aliases:
                e = bare(aliases[e.name.lower()])
            i = listed.get(e)
            if i is None and isinstance(e, A.Name):
                want = str(self.scope.resolve(e)[0])
                i = next((k for x, k in listed.items() if isinstance(x, A.Name) and str(self.scope.resolve(x)[0]) == want), None)
            if i is None:
                if q.distinct:
                    raise fault(3012, "with DISTINCT, ORDER BY takes selected columns only", o, self.source)
                hidden.append(low.column(e).alias(f"s{len(hidden)}"))
                c = F.col(f"s{len(hidden) - 1}")
            else:
                c = F.col(f"o{i}")
            orders.append(c.desc_nulls_last() if o.descending else c.asc_nulls_last())
        df = df.select(*[c.alias(f"o{i}") for i, (_, c, _) in enumerate(out)], *hidden)
        if q.distinct:
            df = df.distinct()
        if orders:
            df = df.orderBy(*orders)
        if q.limit is not None:
            if q.limit.offset:
                df = df.offset(q.limit.offset)
            df = df.limit(q.limit.count)
        return df.select(*[F.col(f"o{i}").alias(name) for i, (name, _, _) in enumerate(out)])
