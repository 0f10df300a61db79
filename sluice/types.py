"""Data types of packages: codes of columns and casts, and the kinds that expressions distinguish."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type codes of the package format (without the DT_ prefix) and their Spark types.
CODES: dict[str, T.DataType] = {
    "i1": T.ShortType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(),
    "ui1": T.ShortType(), "ui2": T.IntegerType(), "ui4": T.LongType(), "ui8": T.DecimalType(20, 0),
    "r4": T.FloatType(), "r8": T.DoubleType(), "bool": T.BooleanType(), "guid": T.StringType(), "cy": T.DecimalType(19, 4),
    "date": T.TimestampNTZType(), "dbdate": T.DateType(), "dbtime": T.StringType(), "dbtime2": T.StringType(),
    "dbtimestamp": T.TimestampNTZType(), "dbtimestamp2": T.TimestampNTZType(), "dbtimestampoffset": T.TimestampType(), "filetime": T.TimestampNTZType(),
    "image": T.BinaryType(), "text": T.StringType(), "ntext": T.StringType(), "str": T.StringType(), "wstr": T.StringType(), "bytes": T.BinaryType(),
}
# Parameter types by .NET type code.
PARAMETER_CODES: dict[int, T.DataType] = {
    3: T.BooleanType(), 4: T.StringType(), 5: T.ShortType(), 6: T.ShortType(), 7: T.ShortType(), 8: T.IntegerType(), 9: T.IntegerType(),
    10: T.LongType(), 11: T.LongType(), 12: T.DecimalType(20, 0), 13: T.FloatType(), 14: T.DoubleType(), 15: T.DecimalType(38, 6),
    16: T.TimestampNTZType(), 18: T.StringType(),
}


def plain(code: str) -> str:
    code = (code or "").strip().lower()
    return code[3:] if code.startswith("dt_") else code


def spark_type(code: str, precision: int | None = None, scale: int | None = None) -> T.DataType:
    """The Spark type of a code; unknown codes are strings.  Numeric defaults to (18, 0)."""
    name = plain(code)
    if name == "numeric":
        return T.DecimalType(min(precision or 18, 38), scale or 0)
    if name == "decimal":
        return T.DecimalType(38, scale or 0)
    return CODES.get(name, T.StringType())


def parameter_type(code: str | int) -> T.DataType:
    text = str(code).strip()
    return PARAMETER_CODES.get(int(text), T.StringType()) if text.isdigit() else spark_type(text)


def length_limit(code: str, length: int | None, default: bool = False) -> int | None:
    """Characters that a cast to a bounded string keeps; None if unbounded."""
    name = plain(code)
    if name in ("str", "wstr"):
        return length or ((8000 if name == "str" else 4000) if default else 255)
    return None


def cast(column: Column, code: str, length: int | None = None, precision: int | None = None, scale: int | None = None, kind: str = "", lenient: bool = False) -> Column:
    """A cast with the truncation of bounded strings.  Bad input raises, as ANSI casts do; under ``lenient`` it gives null."""
    name, target = plain(code), spark_type(code, precision, scale)
    if kind in ("dec", "float", "str") and isinstance(target, (T.ShortType, T.IntegerType, T.LongType)) and kind != "str":
        column = F.when(column >= 0, F.floor(column)).otherwise(F.ceil(column))
    out = column.try_cast(target) if lenient else column.cast(target)
    most = length_limit(name, length, default=True)
    return F.left(out, F.lit(most)) if most else out


def kind_of(t: T.DataType) -> str:
    """bool, int, dec, float, str, date, ts, bin or null."""
    for kinds, name in (
        (T.BooleanType, "bool"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"), (T.DecimalType, "dec"), ((T.FloatType, T.DoubleType), "float"),
        (T.StringType, "str"), (T.DateType, "date"), ((T.TimestampType, T.TimestampNTZType), "ts"), (T.BinaryType, "bin"),
    ):
        if isinstance(t, kinds):
            return name
    return "null"


def literal(text: str | None, t: T.DataType, sensitive: bool = False) -> Column:
    """A typed literal of a parameter or variable; sensitive values and empty numbers are null."""
    if text is None or sensitive or (text == "" and not isinstance(t, T.StringType)):
        return F.lit(None).cast(t)
    return F.lit(text).cast(t)
