"""The type system: names, Spark types, and three relations between types.

Conversion says what a value of a type becomes under a specification, compatibility what a
validator accepts, refinement what an extension may narrow a type to. They differ.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.local import small_frame

# Type names with their synonyms, as the schema language has them.
SYNONYMS = {
    "float": ["float", "float32"],
    "double": ["double", "float64"],
    "long": ["long", "int64"],
    "int": ["int", "int32"],
    "short": ["short", "int16"],
    "int8": ["int8"],
    "uint8": ["uint8"],
    "uint16": ["uint16"],
    "uint32": ["uint32", "uint"],
    "uint64": ["uint64"],
    "bool": ["bool"],
    "utf": ["utf", "text", "utf8", "utf-8"],
    "ascii": ["ascii", "bytes"],
    "isodatetime": ["isodatetime", "datetime", "date"],
    "object": ["object"],
    "region": ["region"],
    "numeric": ["numeric"],
}
CANONICAL = {s: c for c, names in SYNONYMS.items() for s in names}
#: Name of the storage type: family and bits.
STORAGE = {"float": ("float", 32), "double": ("float", 64), "long": ("int", 64), "int": ("int", 32), "short": ("int", 16), "int8": ("int", 8), "uint8": ("uint", 8), "uint16": ("uint", 16), "uint32": ("uint", 32), "uint64": ("uint", 64), "bool": ("bool", 8)}
_BY_STORAGE = {v: k for k, v in STORAGE.items()}
#: Wider types of a family that a validator also accepts.
WIDER = {"float": ["double"], "int8": ["short", "int", "long"], "short": ["int", "long"], "int": ["long"], "uint8": ["uint16", "uint32", "uint64"], "uint16": ["uint32", "uint64"], "uint32": ["uint64"], "utf": ["ascii"]}
#: Unsigned types are one step wider in Spark, with a check that values aren't negative.
SPARK = {
    "float": T.FloatType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "int8": T.ByteType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "bool": T.BooleanType(), "utf": T.StringType(), "ascii": T.StringType(), "isodatetime": T.StringType(),
    "object": T.StringType(), "region": T.ArrayType(T.LongType()), "numeric": T.DoubleType(),
}
#: A date, or a date and time with optional fraction and zone.
ISO8601 = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def spark_type(dtype: str) -> T.DataType:
    return SPARK[CANONICAL[dtype]]


def convert(given: str, wanted: str) -> tuple[str, bool]:
    """The type that a value of `given` gets under a specification, and whether that is worth a warning."""
    given, wanted = CANONICAL[given], CANONICAL[wanted]
    if given == wanted:
        return wanted, False
    (g_family, g_bits), (w_family, w_bits) = STORAGE[given], STORAGE[wanted]
    if g_bits <= w_bits:
        return wanted, True
    if g_family == w_family:
        return given, False
    if wanted == "bool":
        raise ValueError(f"expected bool, received {given}")
    return _BY_STORAGE[w_family, max(g_bits, 32) if w_family == "float" else g_bits], True


def accepts(expected: str, received: str) -> bool:
    """Whether data of a type satisfies an expected type: itself or a wider one of its family."""
    expected = CANONICAL[expected]
    received = CANONICAL.get(received, received)
    if expected == "numeric":
        return received in STORAGE and received != "bool"
    return received == expected or received in WIDER.get(expected, ())


def refines(base: str, new: str) -> bool:
    """Whether an extension may narrow `base` to `new`: the same kind with at least as many bits."""
    kind = lambda d: (d[0], int(m[0]) if (m := re.findall(r"\d+", d)) else 32)
    (a, n), (b, m) = kind(base), kind(new)
    return a == b and m >= n


def lattice(spark) -> DataFrame:
    """(expected, received): all accepted pairs, as a small table to join with."""
    rows = [(e, r) for e in CANONICAL for r in CANONICAL if accepts(e, r)]
    return small_frame(spark, rows, "expected string, received string")


def conversions(spark) -> DataFrame:
    """(given, wanted, result, warns): what `convert` says of each pair of storage types; null where it refuses."""

    def row(g: str, w: str) -> tuple:
        try:
            return (g, w, *convert(g, w))
        except ValueError:
            return (g, w, None, None)

    return small_frame(spark, [row(g, w) for g in STORAGE for w in STORAGE], "given string, wanted string, result string, warns boolean")


def cast(column: Column, dtype: str, strict: bool = True) -> Column:
    """A column as a type; out of range is an error, or null if not strict. Unsigned types have their
    own range, though Spark holds them in wider ones."""
    kind = spark_type(dtype)
    out = column.cast(kind) if strict else column.try_cast(kind)
    family, bits = STORAGE.get(CANONICAL[dtype], ("", 0))
    if family == "uint":
        outside = (column < 0) | (column.cast("decimal(20,0)") > F.lit(str((1 << bits) - 1)).cast("decimal(20,0)"))
        out = F.when(outside, F.raise_error(F.lit(f"value out of range for {dtype}")) if strict else F.lit(None)).otherwise(out)
    return out


def is_iso8601(column: Column) -> Column:
    return column.rlike(ISO8601)


def ascii_escape(column: Column) -> Column:
    """ASCII with backslash escapes for the rest, as \\xNN, \\uNNNN or \\UNNNNNNNN."""
    code = lambda c: F.conv(F.hex(F.encode(c, "utf-32")), 16, 10).cast("long")
    pad = lambda c, n: F.lower(F.lpad(F.hex(code(c)), n, "0"))
    escape = lambda c: F.when(code(c) < 128, c).when(code(c) < 256, F.concat(F.lit("\\x"), pad(c, 2))).when(code(c) < 65536, F.concat(F.lit("\\u"), pad(c, 4))).otherwise(F.concat(F.lit("\\U"), pad(c, 8)))
    return F.when(column.rlike(r"^[\x00-\x7F]*$"), column).otherwise(F.array_join(F.transform(F.split(column, ""), escape), ""))


def shape_of(df: DataFrame, column: str) -> tuple[int, ...]:
    """Rows, then lengths of the first elements, level by level."""
    kind, c, out = df.schema[column].dataType, F.col(column), [df.count()]
    while isinstance(kind, T.ArrayType):
        row = df.select(F.size(c).alias("n")).first()
        out.append(row["n"] if row else 0)
        kind, c = kind.elementType, F.get(c, F.lit(0))
    return tuple(out)


def shape_fits(expected, received: tuple[int, ...]) -> bool:
    """A shape of numbers and None (any), or a list of such shapes."""
    if expected is None:
        return True
    if any(isinstance(e, (list, tuple)) for e in expected):
        return any(shape_fits(e, received) for e in expected if isinstance(e, (list, tuple)))
    return len(expected) == len(received) and all(e is None or e == r for e, r in zip(expected, received))


def compare_shapes(a: tuple, b: tuple, axes_a=None, axes_b=None) -> str | None:
    """Why two shapes don't match along the given axes; None if they do. A None length fits any."""
    if axes_a is None and axes_b is None and len(a) != len(b):
        return "NUM_DIMS"
    axes_a = range(len(a)) if axes_a is None else [axes_a] if isinstance(axes_a, int) else axes_a
    axes_b = range(len(b)) if axes_b is None else [axes_b] if isinstance(axes_b, int) else axes_b
    if len(axes_a) != len(axes_b):
        return "NUM_AXES"
    if any(not -len(a) <= i < len(a) for i in axes_a) or any(not -len(b) <= j < len(b) for j in axes_b):
        return "AXIS_OUT_OF_BOUNDS"
    return "AXIS_LEN" if any(a[i] is not None and b[j] is not None and a[i] != b[j] for i, j in zip(axes_a, axes_b)) else None


def snake_case(type_name: str, plural: bool = False) -> str:
    """CamelCase as snake_case, with an s if there may be many."""
    out = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", re.sub(r"(.)([A-Z][a-z]+)", r"\1_\2", type_name)).lower()
    return out + "s" if plural and not out.endswith("s") else out
