"""Expression nodes. They are plain data; ``planweft.functions`` gives them meaning."""

from __future__ import annotations

from dataclasses import dataclass, field

from planweft.errors import check
from planweft.types import DataType, Schema, TypeId, checked_literal

#: Operator names of the plan language, with the sign that explain prints where there is one.
BINARY = {
    "ADD": "+", "SUB": "-", "MUL": "*", "DIV": "/", "TRUE_DIV": "/", "FLOOR_DIV": "/", "MOD": "%", "PYMOD": "%", "POW": "",
    "EQUAL": "=", "NOT_EQUAL": "!=", "LESS": "<", "GREATER": ">", "LESS_EQUAL": "<=", "GREATER_EQUAL": ">=",
    "BITWISE_AND": "&", "BITWISE_OR": "|", "BITWISE_XOR": "^", "LOGICAL_AND": "&&", "LOGICAL_OR": "||", "COALESCE": "", "GENERIC_BINARY": "",
    "SHIFT_LEFT": "<<", "SHIFT_RIGHT": ">>", "SHIFT_RIGHT_UNSIGNED": ">>", "LOG_BASE": "", "ATAN2": "", "PMOD": "%", "NULL_EQUALS": "==", "NULL_MAX": "", "NULL_MIN": "",
}
UNARY = (
    "SIN", "COS", "TAN", "ARCSIN", "ARCCOS", "ARCTAN", "SINH", "COSH", "TANH", "ARCSINH", "ARCCOSH", "ARCTANH",
    "EXP", "LOG", "SQRT", "CBRT", "CEIL", "FLOOR", "ABS", "RINT", "BIT_INVERT", "NOT",
)
HOST_UNARY = ("EXTRACT_YEAR",)
AGGREGATES = (
    "SUM", "PRODUCT", "MIN", "MAX", "COUNT_VALID", "COUNT_ALL", "ANY", "ALL", "SUM_OF_SQUARES", "MEAN", "MEDIAN", "QUANTILE", "ARGMAX", "ARGMIN", "NUNIQUE", "NTH_ELEMENT",
)


class Expression:
    type: DataType

    def operands(self) -> tuple[Expression, ...]:
        return ()

    def walk(self):
        yield self
        for x in self.operands():
            yield from x.walk()


@dataclass(frozen=True)
class Literal(Expression):
    """A constant; null makes it nullable, any other value doesn't."""

    type_id: TypeId
    value: object = None

    def __post_init__(self):
        object.__setattr__(self, "value", checked_literal(self.value, self.type_id))

    @property
    def type(self) -> DataType:
        return DataType(self.type_id, self.value is None)

    def __str__(self) -> str:
        return "NULL" if self.value is None else repr(self.value)


@dataclass(frozen=True)
class ColumnRef(Expression):
    index: int
    type: DataType

    def __str__(self) -> str:
        return f"ColumnRef#{self.index}"


@dataclass(frozen=True)
class UnaryOp(Expression):
    op: str
    operand: Expression
    type: DataType
    host: bool = False

    def __post_init__(self):
        check(self.op in (HOST_UNARY if self.host else UNARY), f"unknown unary operator {self.op!r}")

    def operands(self):
        return (self.operand,)

    def __str__(self) -> str:
        return f"{self.op.lower()}({self.operand})"


@dataclass(frozen=True)
class BinaryOp(Expression):
    op: str
    left: Expression
    right: Expression
    type: DataType

    def __post_init__(self):
        check(self.op in BINARY, f"unknown binary operator {self.op!r}")

    def operands(self):
        return self.left, self.right

    def __str__(self) -> str:
        sign = BINARY[self.op]
        return f"{self.left} {sign} {self.right}" if sign else f"{self.op}({self.left}, {self.right})"


@dataclass(frozen=True)
class Aggregation(Expression):
    """``n`` is for NTH_ELEMENT, ``q`` for QUANTILE; ``order_by`` (column numbers) sets the arrival order that NTH_ELEMENT, ARGMAX and ARGMIN go by."""

    op: str
    operand: Expression
    type: DataType
    n: int | None = None
    q: float | None = None
    order_by: tuple[int, ...] = field(default=())

    def __post_init__(self):
        check(self.op in AGGREGATES, f"unknown aggregation {self.op!r}")
        check((self.op == "NTH_ELEMENT") == (self.n is not None), "n is for NTH_ELEMENT, which needs it")
        check(self.q is None or self.op == "QUANTILE" and 0 <= self.q <= 1, "q is for QUANTILE, from 0 to 1")

    def operands(self):
        return (self.operand,)

    def __str__(self) -> str:
        return f"{self.op}({f'{self.n}, ' if self.n is not None else ''}{self.operand})"


def column(schema: Schema, index: int) -> ColumnRef:
    check(isinstance(index, int) and 0 <= index < len(schema), f"column {index} of {len(schema)}")
    return ColumnRef(index, schema[index])
