"""Element types of lists, their Spark types and default values.

A list has elements of one type; a missing element is the default of its type, and not found is -1, as there are no nulls.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Spark type of each element type.
SPARK = {
    "char": T.ShortType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.IntegerType(), "float": T.DoubleType(), "string": T.StringType(),
}
#: Narrow types at the edge of the engine, where files ask for them.
STORED = {**SPARK, "float": T.FloatType()}


def array(inner: T.DataType, depth: int = 1) -> T.DataType:
    """Type of a list nested ``depth`` deep; built here, as type names need a session to be read."""
    for _ in range(depth):
        inner = T.ArrayType(inner)
    return inner


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def element_type(name: str, depth: int = 0) -> T.DataType:
    """Spark type of a list element, nested ``depth`` deep."""
    out = SPARK[name]
    for _ in range(depth):
        out = T.ArrayType(out)
    return out


def default(kind: T.DataType) -> object:
    """What fills a gap in a column or list of this type."""
    if isinstance(kind, T.StringType):
        return ""
    if isinstance(kind, T.ArrayType):
        return []
    if isinstance(kind, T.BooleanType):
        return False
    return 0.0 if isinstance(kind, T.DoubleType | T.FloatType) else 0


def depth(kind: T.DataType) -> int:
    """Levels of nesting: 0 for a scalar, 1 for a flat list."""
    n = 0
    while isinstance(kind, T.ArrayType):
        kind, n = kind.elementType, n + 1
    return n


def leaf(kind: T.DataType) -> T.DataType:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return kind


def infer(values: list) -> T.DataType:
    """Element type of values from user code: int if all are, else float if all are numbers, else string."""
    if all(isinstance(v, int) and not isinstance(v, bool) for v in values):
        return T.LongType()
    if all(isinstance(v, int | float) for v in values):
        return T.DoubleType()
    return T.StringType()
