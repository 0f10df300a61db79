"""Expressions to Spark columns, directed by the kinds of their operands.

A predicate in a value's place is 1 or 0 (unknown counts as 0); a value in a predicate's
place is compared with 0.  ``+`` joins strings, ``/`` of two integers truncates, dates
are counted by boundaries, and bounded strings are cut.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExpressionError
from ..types import cast, kind_of, plain, spark_type
from .parse import parse

Typed = tuple[Column, str]
_CUSTOM: dict[str, tuple[Callable[..., Column], str]] = {}
_ORDER = ["null", "int", "dec", "float"]

# The abbreviations of date parts.
DATE_PARTS = {
    "year": "yy yyyy year", "quarter": "qq q quarter", "month": "mm m month", "dayofyear": "dy y dayofyear", "day": "dd d day",
    "week": "wk ww week", "weekday": "dw w weekday", "hour": "hh h hour", "minute": "mi n minute", "second": "ss s second", "millisecond": "ms millisecond",
}
_PART = {a: part for part, names in DATE_PARTS.items() for a in names.split()}


def register_function(name: str, build: Callable[..., Column], kind: str) -> None:
    """Add a function: ``build`` gets columns and returns one of ``kind``."""
    _CUSTOM[name.upper()] = (build, kind)


def _seconds(d: Column) -> Column:
    return F.unix_seconds(d.cast("timestamp"))


def _week(d: Column) -> Column:
    return F.floor(F.datediff(F.to_date(d), F.lit("1899-12-31").cast("date")) / 7)


def date_diff(part: str, a: Column, b: Column) -> Column:
    """How many boundaries of ``part`` lie between two dates."""
    counted = {
        "year": lambda d: F.year(d), "quarter": lambda d: F.year(d) * 4 + F.quarter(d), "month": lambda d: F.year(d) * 12 + F.month(d), "week": _week,
        "hour": lambda d: F.floor(_seconds(d) / 3600), "minute": lambda d: F.floor(_seconds(d) / 60), "second": _seconds,
        "millisecond": lambda d: F.unix_millis(d.cast("timestamp")),
    }
    if part in counted:
        return (counted[part](b) - counted[part](a)).cast("int" if part != "millisecond" else "long")
    return F.datediff(F.to_date(b), F.to_date(a))


def date_part(part: str, d: Column) -> Column:
    """One part of a date; weeks start on Sunday and week 1 holds January 1."""
    ts = d.cast("timestamp_ntz")
    simple = {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.day, "dayofyear": F.dayofyear, "weekday": F.dayofweek, "hour": F.hour, "minute": F.minute, "second": F.second}
    if part == "week":
        return F.floor((F.dayofyear(ts) + F.dayofweek(F.trunc(ts, "YEAR")) - 2) / 7).cast("int") + 1
    if part == "millisecond":
        return (F.unix_millis(d.cast("timestamp")) % 1000).cast("int")
    return simple[part](ts)


def date_add(part: str, n: Column, d: Column) -> Column:
    unit = {"dayofyear": "DAY", "weekday": "DAY"}.get(part, part.upper())
    return F.timestamp_add(unit, n.cast("int"), d.cast("timestamp_ntz"))


def _substring(s: Column, start: Column, n: Column) -> Column:
    """From position ``start`` (1 is the first); what lies before the string counts against the length."""
    first = F.greatest(start, F.lit(1))
    return F.substring(s, first, F.greatest(start + n - first, F.lit(0)))


def _find(s: Column, part: Column, k: int) -> Column:
    """Position of the k-th occurrence, 0 if there is none."""
    head = F.length(F.call_function("substring_index", s, part, F.lit(k)))
    enough = (F.length(s) - F.length(F.replace(s, part, F.lit("")))) / F.length(part) >= k
    return F.when(s.isNull() | part.isNull(), F.lit(None).cast("int")).when(enough, head + 1).otherwise(0)


class Expressions:
    """Compiles expressions over one schema; ``variables`` are typed columns by (namespace, name)."""

    def __init__(self, schema: T.StructType, variables: dict[tuple[str, str], tuple[Column, T.DataType]] | None = None, compat: str = "reference", warn: Callable[[str], None] = lambda _: None):
        self.fields = {f.name.lower(): f for f in schema}
        self.variables = {(a.lower(), b.lower()): v for (a, b), v in (variables or {}).items()}
        self.compat, self.warn = compat, warn

    def value(self, text: str) -> Column:
        return self._number(self._typed(parse(text)))[0]

    def condition(self, text: str) -> Column:
        return self._truth(parse(text))

    # Kinds and contexts

    def _number(self, x: Typed) -> Typed:
        """A predicate as 1 or 0; other values as they are."""
        return (F.when(x[0], 1).otherwise(0), "int") if x[1] == "pred" else x

    def _truth(self, node) -> Column:
        c, kind = self._typed(node)
        return c if kind in ("pred", "bool") else c.cast("boolean") if kind == "null" else c != 0

    def _arg(self, node) -> Typed:
        c, kind = self._number(self._typed(node))
        return (c.cast("int"), "int") if kind == "bool" else (c, kind)

    def _typed(self, node) -> Typed:
        return getattr(self, f"_{node[0]}")(node)

    def _lit(self, node) -> Typed:
        _, kind, value = node
        if kind == "bool":
            return F.lit(value), "pred"
        if kind == "null":
            return F.lit(None), "null"
        return F.lit(Decimal(value) if kind == "dec" else float(value) if kind == "float" else value), kind

    def _col(self, node) -> Typed:
        field = self.fields.get(node[1].lower())
        if field is None:
            raise ExpressionError(f"no column {node[1]!r}")
        return F.col("`" + field.name.replace("`", "``") + "`"), kind_of(field.dataType)

    def _var(self, node) -> Typed:
        found = self.variables.get((node[1].lower(), node[2].lower()))
        if found is None:
            self.warn(f"no variable {node[1]}::{node[2]}; it is null")
            return F.lit(None), "null"
        return found[0], kind_of(found[1])

    def _un(self, node) -> Typed:
        if node[1] == "!":
            return ~self._truth(node[2]), "pred"
        c, kind = self._arg(node[2])
        return (-c if node[1] == "-" else F.bitwise_not(c) if node[1] == "~" else c), kind

    def _if(self, node) -> Typed:
        (a, x), (b, y) = self._number(self._typed(node[2])), self._number(self._typed(node[3]))
        if {x, y} == {"bool", "int"}:
            a, b, x, y = a.cast("int"), b.cast("int"), "int", "int"
        return F.when(self._truth(node[1]), a).otherwise(b), y if x == "null" else x if x not in _ORDER or y not in _ORDER else max(x, y, key=_ORDER.index)

    def _cast(self, node) -> Typed:
        c, kind = self._number(self._typed(node[3]))
        name, args = plain(node[1]), node[2]
        length = args[0] if args and name in ("str", "wstr", "bytes") else None
        precision, scale = (args[0], args[1]) if name == "numeric" and len(args) > 1 else (None, args[0] if args and name == "decimal" else None)
        return cast(c, name, length, precision, scale, kind), kind_of(spark_type(name, precision, scale))

    def _null(self, node) -> Typed:
        return self._cast(("cast", node[1], node[2], ("lit", "null", None)))

    def _bin(self, node) -> Typed:
        _, op, left, right = node
        if op in ("&&", "||"):
            x, y = self._truth(left), self._truth(right)
            return (x & y if op == "&&" else x | y), "pred"
        (a, x), (b, y) = self._arg(left), self._arg(right)
        if op in ("==", "!=", "<", ">", "<=", ">="):
            if x == "str" and y in ("int", "dec", "float"):
                a = a.cast("decimal(38,10)" if y != "float" else "double")
            elif y == "str" and x in ("int", "dec", "float"):
                b = b.cast("decimal(38,10)" if x != "float" else "double")
            compare = {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}
            return compare[op], "pred"
        if op in ("&", "|", "^"):
            return (a.bitwiseAND(b) if op == "&" else a.bitwiseOR(b) if op == "|" else a.bitwiseXOR(b)), "int"
        if op == "+" and "str" in (x, y):
            return F.concat(a.cast("string"), b.cast("string")), "str"
        if op == "/" and x == y == "int":
            return F.call_function("div", a, b), "int"
        kind = max(x, y, key=lambda k: _ORDER.index(k) if k in _ORDER else 9)
        return {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "%": a % b}[op], kind

    # Functions

    def _call(self, node) -> Typed:
        _, name, args = node
        if name in _CUSTOM:
            build, kind = _CUSTOM[name]
            return build(*(self._arg(a)[0] for a in args)), kind
        if name in ("DATEADD", "DATEDIFF", "DATEPART"):
            return self._dates(name, args)
        if name == "ISNULL":
            self._count(name, args, 1)
            return self._typed(args[0])[0].isNull(), "pred"
        if name == "NULL":
            return F.lit(None), "null"
        if name == "FINDSTRING":
            self._count(name, args, 2, 3)
            s, part = self._arg(args[0])[0], self._arg(args[1])[0]
            k = args[2][2] if len(args) > 2 and args[2][:2] == ("lit", "int") else 1
            if k != 1 and self.compat == "reference":
                self.warn("FINDSTRING looks for the first occurrence")
                k = 1
            return (F.when(part.isNull(), F.lit(None).cast("int")).otherwise(F.call_function("locate", part, s)) if k == 1 else _find(s, part, k)), "int"
        if name not in _FUNCTIONS:
            raise ExpressionError(f"unknown function {name}")
        n, build, kind = _FUNCTIONS[name]
        self._count(name, args, n)
        typed = [self._arg(a) for a in args]
        if kind == "same":
            kind = next((k for _, k in typed if k != "null"), "null")
        return build(*(c for c, _ in typed)), kind

    def _dates(self, name: str, args: list) -> Typed:
        self._count(name, args, 2 if name == "DATEPART" else 3)
        if args[0][:2] not in (("lit", "str"),) and args[0][0] != "col":
            raise ExpressionError(f"{name} needs a literal date part")
        part = _PART.get(str(args[0][-1]).lower())
        if part is None:
            raise ExpressionError(f"unknown date part {args[0][-1]!r}")
        rest = [self._arg(a)[0] for a in args[1:]]
        if name == "DATEPART":
            return date_part(part, *rest), "int"
        return (date_add(part, *rest), "ts") if name == "DATEADD" else (date_diff(part, *rest), "int")

    @staticmethod
    def _count(name: str, args: list, *allowed: int) -> None:
        if len(args) not in allowed:
            raise ExpressionError(f"{name} takes {' or '.join(map(str, allowed))} arguments, not {len(args)}")


_FUNCTIONS: dict[str, tuple[int, Callable[..., Column], str]] = {
    "ABS": (1, F.abs, "same"), "CEILING": (1, F.ceil, "same"), "FLOOR": (1, F.floor, "same"), "SIGN": (1, F.signum, "float"), "SQRT": (1, F.sqrt, "float"),
    "EXP": (1, F.exp, "float"), "LN": (1, F.ln, "float"), "LOG": (1, F.log10, "float"), "SQUARE": (1, lambda x: x.cast("double") * x.cast("double"), "float"),
    "POWER": (2, F.pow, "float"), "ROUND": (2, lambda x, n: F.round(x, n), "same"),
    "UPPER": (1, F.upper, "str"), "LOWER": (1, F.lower, "str"), "LTRIM": (1, F.ltrim, "str"), "RTRIM": (1, F.rtrim, "str"), "TRIM": (1, F.trim, "str"),
    "REPLACE": (3, F.replace, "str"), "REVERSE": (1, F.reverse, "str"), "SUBSTRING": (3, _substring, "str"), "REPLICATE": (2, lambda s, n: F.repeat(s, n), "str"),
    "LEN": (1, F.length, "int"), "LEFT": (2, F.left, "str"), "RIGHT": (2, F.right, "str"), "CODEPOINT": (1, F.ascii, "int"),
    "REPLACENULL": (2, F.coalesce, "same"), "YEAR": (1, F.year, "int"), "MONTH": (1, F.month, "int"), "DAY": (1, F.day, "int"),
    "GETDATE": (0, F.localtimestamp, "ts"), "GETUTCDATE": (0, lambda: F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz"), "ts"),
    "ISNUMERIC": (1, lambda x: F.when(x.try_cast("double").isNotNull(), 1).otherwise(0), "int"),
}
