"""Calculated columns: ``[Column]`` arithmetic handed to Spark's expression language.

The text is checked against a whitelist of tokens and rewritten token by token;
Spark parses and plans the result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The functions of the expression language and their Spark forms.
FUNCTIONS = {
    "round": "element_at(transform(array(0.5D + ",
    "abs": "abs(",
    "log": "ln(",
    "sqrt": "sqrt(",
    "pow": "power(",
    "min": "least(",
    "max": "greatest(",
    "floor": "element_at(transform(array(",
    "ceil": "element_at(transform(array(",
    "exp": "exp(",
}
#: What follows the argument of a function in place of a parenthesis: Spark rounds by way of
#: 64-bit integers, and a double from 2**52 on has no fraction.
WHOLE = "), x -> CASE WHEN abs(x) < 4503599627370496D THEN CAST({}(x) AS DOUBLE) ELSE x END), 1)"
ENDS = {"round": WHOLE.format("floor"), "floor": WHOLE.format("floor"), "ceil": WHOLE.format("ceil")}

TOKEN = re.compile(r"\s*(?:(\[[^\]]+\])|(\d+\.?\d*|\.\d+)|([A-Za-z_]\w*)\s*\(|([-+*/(),]))")


def tokens(expression: str) -> list[str]:
    out, at = [], 0
    text = expression.strip()
    while at < len(text):
        match = TOKEN.match(text, at)
        if match is None:
            raise ValueError(f"invalid token in expression at {text[at:at + 20]!r}")
        column, number, function, sign = match.groups()
        if function is not None and function not in FUNCTIONS:
            raise ValueError(f"function {function!r} is not allowed")
        out.append(column or number or (function + "(" if function else sign))
        at = match.end()
    return out


def spark_expression(expression: str, columns: list[str]) -> str:
    """Division by zero gives null, as do missing operands; round goes half up."""
    parts = tokens(expression) if expression and expression.strip() else []
    if not parts:
        raise ValueError("expression is empty")
    if not any(p.startswith("[") for p in parts):
        raise ValueError("expression must reference a column as [Column]")
    out: list[str] = []
    depth, divisors, ends = 0, [], []

    def close_divisor() -> None:
        # the divisor that started at this depth is complete
        while divisors and divisors[-1] == depth:
            divisors.pop()
            out.append(", 0D)")

    for part in parts:
        if part.endswith("("):
            out.append(FUNCTIONS[part[:-1]] if part != "(" else "(")
            ends.append(ENDS.get(part[:-1], ")"))
            depth += 1
            continue
        if part == ")":
            depth -= 1
            if depth < 0:
                raise ValueError("unbalanced parentheses in expression")
            out.append(ends.pop())
            close_divisor()
        elif part == "/":
            out.append(" / nullif(")
            divisors.append(depth)
        elif part in "+-*,":
            out.append(f" {part} ")
        elif part.startswith("["):
            name = part[1:-1]
            if name not in columns:
                raise ValueError(f"unknown column [{name}]")
            quoted = name.replace("`", "``")
            out.append(f"try_cast(`{quoted}` AS double)")
            close_divisor()
        else:
            out.append(f"{part}D")
            close_divisor()
    if depth or divisors:
        raise ValueError("incomplete expression")
    return "".join(out)


def calculated(expression: str, columns: list[str]) -> Column:
    return F.expr(spark_expression(expression, columns)).cast("double")
