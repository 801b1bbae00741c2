"""Conditions: text to a Column, and the ordered choices that strategies declare."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import divide

_COMPARE = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}


class ConditionError(ValueError):
    """A condition that isn't allowed."""


def column_name(name: str) -> str:
    """`leg.field` names a leg's column; strike is short for strike_price."""
    leg, dot, field = name.rpartition(".")
    field = "strike_price" if field == "strike" else field
    return f"leg_{leg}_{field}" if dot else field


def compile_condition(text: str, resolve: Callable[[str], Column] | None = None) -> Column:
    """A Column for comparisons, and/or/not, + - * /, abs() and names; anything else is an error at load time.

    Null follows three-valued logic; a division by zero gives infinities and NaN. `if A then B` reads as not A or B.
    """
    implied = re.fullmatch(r"\s*if\s+(.+?)\s+then\s+(.+)", text, re.S)
    if implied:
        return ~compile_condition(implied[1], resolve) | compile_condition(implied[2], resolve)
    return _build(_parsed(text), resolve or (lambda n: F.col(column_name(n))))


def check_condition(text: str) -> None:
    """Raises ConditionError for what compile_condition() doesn't take; needs no session."""
    implied = re.fullmatch(r"\s*if\s+(.+?)\s+then\s+(.+)", text, re.S)
    for part in implied.groups() if implied else [text]:
        _allowed(_parsed(part))


def _parsed(text: str) -> ast.AST:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ConditionError(f"not a condition: {text!r}") from e


def _allowed(node: ast.AST) -> None:
    match node:
        case ast.Constant(value=bool() | int() | float() | str()) | ast.Name() | ast.Attribute(value=ast.Name()):
            parts = []
        case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
            parts = [a, b]
        case ast.BoolOp(values=parts):
            pass
        case ast.UnaryOp(op=ast.Not(), operand=x) | ast.Call(func=ast.Name(id="abs"), args=[x], keywords=[]):
            parts = [x]
        case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=int() | float() as v)) if not isinstance(v, bool):
            parts = []
        case ast.BinOp(left=a, op=ast.Add() | ast.Sub() | ast.Mult() | ast.Div(), right=b):
            parts = [a, b]
        case _:
            raise ConditionError(f"not allowed in a condition: {ast.unparse(node)}")
    for part in parts:
        _allowed(part)


def _build(node: ast.AST, resolve: Callable[[str], Column]) -> Column:
    build = lambda n: _build(n, resolve)
    match node:
        case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
            return getattr(build(a), _COMPARE[type(op)])(build(b))
        case ast.BoolOp(op=op, values=values):
            out = build(values[0])
            for v in values[1:]:
                out = out & build(v) if isinstance(op, ast.And) else out | build(v)
            return out
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return ~build(x)
        case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=bool())):
            raise ConditionError("minus stands before numbers only")
        case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=int() | float() as v)):
            return F.lit(-v)
        case ast.BinOp(left=a, op=ast.Add(), right=b):
            return build(a) + build(b)
        case ast.BinOp(left=a, op=ast.Sub(), right=b):
            return build(a) - build(b)
        case ast.BinOp(left=a, op=ast.Mult(), right=b):
            return build(a) * build(b)
        case ast.BinOp(left=a, op=ast.Div(), right=b):
            return divide(build(a), build(b))
        case ast.Call(func=ast.Name(id="abs"), args=[x], keywords=[]):
            return F.abs(build(x))
        case ast.Constant(value=bool() | int() | float() | str() as v):
            return F.lit(v)
        case ast.Name(id=name):
            return resolve(name)
        case ast.Attribute(value=ast.Name(id=leg), attr=field):
            return resolve(f"{leg}.{field}")
    raise ConditionError(f"not allowed in a condition: {ast.unparse(node)}")


def steps(source: Column, ladder: Sequence[Mapping], fields: Sequence[str]) -> Column:
    """The first step whose `below` exceeds the source, as a struct of its fields; a step without `below` takes the rest.

    Null if no step fits, or if the source is null and a step with `below` comes first.
    """
    out = None
    for step in ladder:
        value = F.struct(*(F.lit(step.get(f)).cast("double").alias(f) for f in fields))
        if step.get("below") is None:
            return value if out is None else out.otherwise(F.when(source.isNotNull(), value))
        out = (F if out is None else out).when(source < step["below"], value)
    return out


def targets(named: Mapping[str, Mapping], fields: Sequence[str], resolve: Callable[[str], Column] | None = None) -> Column:
    """The fields and the name of the first target by priority whose condition holds, else those of `default`, else null."""
    value = lambda name: F.struct(F.lit(name).alias("name"), *(F.lit(named[name].get(f)).cast("double").alias(f) for f in fields))
    out = None
    for name in sorted((n for n in named if n != "default"), key=lambda n: named[n]["priority"]):
        out = (F if out is None else out).when(compile_condition(named[name]["condition"], resolve), value(name))
    if "default" in named:
        return value("default") if out is None else out.otherwise(value("default"))
    return out
