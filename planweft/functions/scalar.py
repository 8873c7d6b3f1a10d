"""Scalar expressions as Spark columns: built-in functions only, each cast to its declared type.

Divisions and remainders by zero give null; an overflow of the declared type
raises. Logic has three values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from planweft.errors import PlanError, check
from planweft.plans import expressions as X
from planweft.types import DataType, TypeId, cast, literal

Generic = Callable[[Column, Column], Column]

COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "EQUAL": lambda a, b: a == b,
    "NOT_EQUAL": lambda a, b: a != b,
    "LESS": lambda a, b: a < b,
    "GREATER": lambda a, b: a > b,
    "LESS_EQUAL": lambda a, b: a <= b,
    "GREATER_EQUAL": lambda a, b: a >= b,
    "NULL_EQUALS": lambda a, b: a.eqNullSafe(b),
    "LOGICAL_AND": lambda a, b: a & b,
    "LOGICAL_OR": lambda a, b: a | b,
}
MATH: dict[str, Callable[[Column], Column]] = {
    "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ARCSIN": F.asin, "ARCCOS": F.acos, "ARCTAN": F.atan,
    "SINH": F.sinh, "COSH": F.cosh, "TANH": F.tanh, "ARCSINH": F.asinh, "ARCCOSH": F.acosh, "ARCTANH": F.atanh,
    "EXP": F.exp, "LOG": F.ln, "SQRT": F.sqrt, "CBRT": F.cbrt, "RINT": F.rint,
}
WHOLE_BEYOND = float(2**52)


def not_zero(b: Column) -> Column:
    return F.nullif(b, F.lit(0).cast("int"))


def as_bits(value: Column, t: DataType) -> Column:
    """The bits of a whole number as an int or a long."""
    if t.type_id is TypeId.UINT64:
        wide = value.cast("decimal(21,0)")
        return F.when(wide >= F.lit(str(2**63)).cast("decimal(21,0)"), wide - F.lit(str(2**64)).cast("decimal(21,0)")).otherwise(wide).cast("long")
    return value.cast("long" if t.type_id in (TypeId.INT64, TypeId.UINT32) else "int")


def from_bits(value: Column, t: DataType) -> Column:
    if t.type_id is TypeId.UINT64:
        wide = value.cast("decimal(21,0)")
        return F.when(wide < 0, wide + F.lit(str(2**64)).cast("decimal(21,0)")).otherwise(wide).cast(t.spark)
    if t.unsigned_bits:
        return value.bitwiseAND(F.lit(2**t.unsigned_bits - 1)).cast(t.spark)
    return value.cast(t.spark)


def quotient(a: Column, b: Column, t: DataType) -> Column:
    """Division as in C: whole numbers lose their fraction."""
    a, b = cast(a, t), not_zero(cast(b, t))
    if not t.integral:
        return a / b
    if t.type_id is TypeId.UINT64:
        return (a - a % b) / b  # exact: Spark's own div gives a signed long
    return F.call_function("div", a, b)


def binary(op: str, a: Column, b: Column, t: DataType, generic: Generic | None = None) -> Column:
    if op in COMPARISONS:
        return COMPARISONS[op](a, b)
    if op in ("ADD", "SUB", "MUL"):
        a, b = cast(a, t), cast(b, t)
        return cast(a + b if op == "ADD" else a - b if op == "SUB" else a * b, t)
    if op in ("COALESCE", "NULL_MAX", "NULL_MIN"):
        return {"COALESCE": F.coalesce, "NULL_MAX": F.greatest, "NULL_MIN": F.least}[op](cast(a, t), cast(b, t))
    if op in ("BITWISE_AND", "BITWISE_OR", "BITWISE_XOR"):
        a, b = as_bits(cast(a, t), t), as_bits(cast(b, t), t)
        return from_bits(a.bitwiseAND(b) if op == "BITWISE_AND" else a.bitwiseOR(b) if op == "BITWISE_OR" else a.bitwiseXOR(b), t)
    if op in ("SHIFT_LEFT", "SHIFT_RIGHT", "SHIFT_RIGHT_UNSIGNED"):
        return from_bits(F.call_function(op.replace("_", "").lower(), as_bits(cast(a, t), t), b.cast("int")), t)
    if op == "DIV":
        return cast(quotient(a, b, t), t)
    if op == "TRUE_DIV":
        return cast(a.cast("double") / not_zero(b.cast("double")), t)
    if op == "FLOOR_DIV":
        return cast(F.floor(a.cast("double") / not_zero(b.cast("double"))), t)
    if op in ("MOD", "PYMOD", "PMOD"):
        a, b = cast(a, t), not_zero(cast(b, t))
        return cast(a % b if op == "MOD" else ((a % b) + b) % b if op == "PYMOD" else F.pmod(a, b), t)
    if op == "POW":
        return cast(F.pow(a.cast("double"), b.cast("double")), t)
    if op == "LOG_BASE":  # the plan language has the base on the right; base 1 has no logarithms
        return cast(F.call_function("log", F.nullif(b.cast("double"), F.lit(1.0)), a.cast("double")), t)
    if op == "ATAN2":
        return cast(F.atan2(a.cast("double"), b.cast("double")), t)
    check(op == "GENERIC_BINARY" and generic is not None, f"{op} needs a function that the engine was given")
    return cast(generic(a, b), t)


def unary(op: str, a: Column, t: DataType, of: DataType) -> Column:
    if op in MATH:
        return cast(MATH[op](a.cast("double")), t)
    if op in ("CEIL", "FLOOR"):
        if of.integral:
            return cast(a, t)
        whole = F.ceil(a) if op == "CEIL" else F.floor(a)
        # beyond 2**52 a double has no fraction, and might not fit the long that Spark makes of it
        return F.when(F.abs(a) < F.lit(WHOLE_BEYOND), cast(whole, t)).otherwise(cast(a, t))
    if op == "ABS":
        return cast(F.abs(cast(a, t)), t)
    if op == "BIT_INVERT":
        return from_bits(F.bitwise_not(as_bits(cast(a, t), t)), t)
    if op == "NOT":
        return ~a
    raise PlanError(f"unknown unary operator {op!r}")


def extract_year(a: Column) -> Column:
    """The year of a packed date and time: its 14 highest bits."""
    return F.shiftrightunsigned(a.cast("long"), 50).cast("long")


def column(x: X.Expression, names: list[str], generic: Generic | None = None) -> Column:
    """The Spark column of an expression over columns called ``names``."""
    if isinstance(x, X.Literal):
        return literal(x.value, x.type)
    if isinstance(x, X.ColumnRef):
        return F.col(names[x.index])
    if isinstance(x, X.UnaryOp):
        of = column(x.operand, names, generic)
        return extract_year(of) if x.host else unary(x.op, of, x.type, x.operand.type)
    if isinstance(x, X.BinaryOp):
        return binary(x.op, column(x.left, names, generic), column(x.right, names, generic), x.type, generic)
    raise PlanError(f"{x} can't stand here")
