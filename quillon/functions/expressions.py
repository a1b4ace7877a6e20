"""Feature expressions such as `$income / 1000`, turned into Spark columns.

Python's own parser reads the text; only arithmetic and a fixed set of functions pass. Numbers
follow Python: `//` and `%` round towards minus infinity, `round` is half-even. Where Python
would raise (division by zero, root of a negative) the result is null.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, functions as F


def _floor_mod(left: Column, right: Column) -> Column:
    rest = F.try_mod(left, right)
    return F.when((rest != 0) & ((rest < 0) != (right < 0)), rest + right).otherwise(rest)


def _floor_divide(left: Column, right: Column) -> Column:
    return F.floor(F.try_divide(left - _floor_mod(left, right), right) + F.lit(0.5)).cast("double")


def _finite(value: Column) -> Column:
    number = value.cast("double")
    bad = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(~bad, number)


def _all_present(function, values: tuple[Column, ...]) -> Column:
    present = F.lit(True)
    for value in values:
        present = present & value.isNotNull()
    return F.when(present, function(*values))


def _round(value: Column, digits: Column | None = None) -> Column:
    return F.bround(value, digits) if digits is not None else F.bround(value)


BINARY = {
    ast.Add: F.try_add,
    ast.Sub: F.try_subtract,
    ast.Mult: F.try_multiply,
    ast.Div: F.try_divide,
    ast.FloorDiv: _floor_divide,
    ast.Mod: _floor_mod,
    ast.Pow: lambda left, right: _finite(F.pow(left, right)),
}
UNARY = {ast.USub: lambda value: -value, ast.UAdd: lambda value: value}
CALLS = {
    "abs": F.abs,
    "max": lambda *values: _all_present(F.greatest, values),
    "min": lambda *values: _all_present(F.least, values),
    "round": _round,
    "sqrt": lambda value: F.when(value >= 0, F.sqrt(value)),
    "log": lambda value: F.when(value > 0, F.log(value)),
    "exp": lambda value: _finite(F.exp(value)),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
}


def feature_column(expression: str, columns: list[str]) -> Column:
    """Compile one expression over the named columns. Raises ValueError on anything else."""
    names: dict[str, str] = {}
    longest_first = "|".join(re.escape(name) for name in sorted(columns, key=len, reverse=True))

    def placeholder(match: re.Match) -> str:
        mark = f"c{len(names)}_"
        names[mark] = match.group(1)
        return mark

    text = re.sub(rf"\$({longest_first})(?![A-Za-z0-9_])", placeholder, expression)
    if "$" in text:
        raise ValueError(f"unknown column in expression: {expression}")
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as error:
        raise ValueError(f"not an expression: {expression}") from error

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return build(body)
            case ast.Constant(value=bool() | int() | float() | str() as value):
                return F.lit(value)
            case ast.Name(id=name) if name in names:
                return F.col(f"`{names[name]}`")
            case ast.BinOp(left=left, op=op, right=right) if type(op) in BINARY:
                return BINARY[type(op)](build(left), build(right))
            case ast.UnaryOp(op=op, operand=operand) if type(op) in UNARY:
                return UNARY[type(op)](build(operand))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in CALLS:
                return CALLS[name](*[build(arg) for arg in args])
        raise ValueError(f"not allowed in a feature expression: {ast.dump(node)}")

    return build(tree)
