"""Condition expressions of a configuration, as columns.

A condition is written as what follows the column: ``eq('x')``, ``str.contains('a|b')``, ``is_in(['a', 'b'])``.
Conditions are joined by ``&``, ``|`` and ``~``; ``pl.col('name')`` or ``col('name')`` names another column, also
on either side of ``==``, ``!=``, ``<``, ``<=``, ``>`` and ``>=``.  The text is read into a syntax tree, of which only the
listed forms are known; nothing of it is ever run.
"""

from __future__ import annotations

import ast
import re
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARED = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
}

#: Conditions by name: number of values, and the column they make of a column and the values.
METHODS = {
    "eq": (1, lambda c, v: c == v),
    "ne": (1, lambda c, v: c != v),
    "lt": (1, lambda c, v: c < v),
    "le": (1, lambda c, v: c <= v),
    "gt": (1, lambda c, v: c > v),
    "ge": (1, lambda c, v: c >= v),
    "eq_missing": (1, lambda c, v: c.eqNullSafe(v)),
    "is_between": (2, lambda c, a, b: c.between(a, b)),
    "is_null": (0, lambda c: c.isNull()),
    "is_not_null": (0, lambda c: c.isNotNull()),
    "str.starts_with": (1, lambda c, v: c.startswith(v)),
    "str.ends_with": (1, lambda c, v: c.endswith(v)),
}
#: Those that take more than columns and single values.
OTHERS = ("is_in", "str.contains")


def condition(column: Column, text: str) -> Column:
    """The condition ``text`` on ``column``; ``ValueError`` names what is not known in it."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # of backslashes in patterns
            tree = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError):
        raise ValueError(f"condition {text!r} is not an expression") from None
    return _boolean(tree, column, text)


def _unknown(what: str, text: str) -> ValueError:
    return ValueError(f"unknown {what} in condition {text!r}; known are {', '.join([*METHODS, *OTHERS])}, comparisons, &, | and ~")


def _boolean(node: ast.AST, column: Column, text: str) -> Column:
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.BitAnd, ast.BitOr)):
        left, right = _boolean(node.left, column, text), _boolean(node.right, column, text)
        return left & right if isinstance(node.op, ast.BitAnd) else left | right
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Invert):
        return ~_boolean(node.operand, column, text)
    if isinstance(node, ast.Compare):
        if len(node.ops) != 1 or type(node.ops[0]) not in _COMPARED:
            raise _unknown("comparison", text)
        return _COMPARED[type(node.ops[0])](_side(node.left, text), _side(node.comparators[0], text))
    if isinstance(node, ast.Call):
        return _method(node, column, text)
    raise _unknown(f"form {ast.unparse(node)!r}", text)


def _method(node: ast.Call, column: Column, text: str) -> Column:
    path, at = [], node.func
    while isinstance(at, ast.Attribute):
        path.insert(0, at.attr)
        at = at.value
    named = _named(at)
    if named is not None and path:
        column = F.col(named)
    elif isinstance(at, ast.Name):
        path.insert(0, at.id)
    else:
        raise _unknown(f"form {ast.unparse(node)!r}", text)
    name = ".".join(path)
    options = {k.arg: _value(k.value, text) for k in node.keywords}
    if name == "str.contains":
        if len(node.args) != 1 or set(options) - {"literal"}:
            raise _unknown("option of str.contains", text)
        pattern = _value(node.args[0], text)
        return column.contains(pattern) if options.get("literal") else column.rlike(pattern)
    if name == "is_in":
        if len(node.args) != 1 or options or not isinstance(node.args[0], (ast.List, ast.Tuple, ast.Set)):
            raise _unknown("form of is_in, which takes a list of values,", text)
        return column.isin([_value(v, text) for v in node.args[0].elts])
    if name not in METHODS:
        raise _unknown(f"name {name!r}", text)
    count, build = METHODS[name]
    if len(node.args) != count or options:
        raise ValueError(f"{name} takes {count} value(s), condition {text!r}")
    return build(column, *[_side(v, text) for v in node.args])


def _named(node: ast.AST) -> str | None:
    """The column that ``col('name')`` or ``pl.col('name')`` names."""
    if isinstance(node, ast.Call) and ast.unparse(node.func) in ("col", "pl.col") and len(node.args) == 1:
        value = node.args[0]
        if isinstance(value, ast.Constant) and isinstance(value.value, str) and re.search(r"\S", value.value) and not node.keywords:
            return f"`{value.value.replace('`', '``')}`"
    return None


def _side(node: ast.AST, text: str) -> Column:
    named = _named(node)
    return F.lit(_value(node, text)) if named is None else F.col(named)


def _value(node: ast.AST, text: str):
    if isinstance(node, ast.Call) and ast.unparse(node.func) in ("lit", "pl.lit") and len(node.args) == 1:
        node = node.args[0]
    try:
        value = ast.literal_eval(node)
    except ValueError:
        raise _unknown(f"value {ast.unparse(node)!r}", text) from None
    if value is not None and not isinstance(value, (str, int, float, bool)):
        raise _unknown(f"value {ast.unparse(node)!r}", text)
    return value
