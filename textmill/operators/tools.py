"""Replay of the calculator calls in conversations: does each recorded output follow from its expression?"""

from __future__ import annotations

import ast
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# What the calculator accepts.
ARITHMETIC = frozenset("0123456789*+-/.() ")
TEXTUAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'\"()._ ")
LONGEST = 1000  # characters of an expression
MOST_DIGITS = 1000  # of a whole number on the way

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv}


class Refused(ValueError):
    pass


def _value(node: ast.expr):
    """Value of a parsed expression: numbers, + - * / //, signs, and ``'text'.count('part')``."""
    match node:
        case ast.Constant(value=int() | float() as v) if not isinstance(v, bool):
            return v
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_value(x)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return +_value(x)
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
            got = _BINARY[type(op)](_value(a), _value(b))
            if isinstance(got, int) and abs(got) >= 10 ** MOST_DIGITS:
                raise Refused("too large")
            return got
        case ast.Call(func=ast.Attribute(value=ast.Constant(value=str() as text), attr="count"), args=[ast.Constant(value=str() as part)], keywords=[]):
            return text.count(part)
    raise Refused("not an expression of the calculator")


def calculate(expression: str | None) -> str | None:
    """The calculator's answer as text; None where it refuses the expression or fails."""
    if expression is None:
        return None
    text = expression.replace(",", "")
    if len(text) > LONGEST:
        return None
    letters = set(text)
    if letters <= ARITHMETIC:
        if "**" in text:
            return None
    elif not letters <= TEXTUAL or ".count(" not in text:
        return None
    try:
        return str(_value(ast.parse(text.strip(), mode="eval").body))
    except (Refused, SyntaxError, ValueError, ArithmeticError, RecursionError, MemoryError):
        return None


@F.arrow_udf(ArrayType(StringType()))
def _answers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if x is None else [calculate(e) for e in x] for x in batch.to_pylist()], pa.list_(pa.string()))


def verify_tool_outputs(d: DataFrame, messages: str = "messages") -> DataFrame:
    """Add the number of calls of each conversation, and of those refused, unanswered and mismatched.

    A call is a ``python`` part of an assistant message; its output is the ``python_output``
    part right after it.  A call that the calculator refuses has no value to compare; one with
    a value but without an output part is unanswered.  Conversations stay in their rows: nothing is shuffled.
    """
    part = "struct<type:string,text:string"
    kind = f"array<{part},next:{part}>>>"

    def calls(m):
        own = F.when(m["role"] == "assistant", m["parts"])
        every = F.transform(own, lambda p, i: F.struct(p["type"].alias("type"), p["text"].alias("text"), F.get(own, i + 1).alias("next")))
        return F.coalesce(F.filter(every, lambda p: p["type"] == "python"), F.array().cast(kind))

    d = d.withColumn("_calls", F.coalesce(F.flatten(F.transform(messages, calls)), F.array().cast(kind)))
    d = d.withColumn("_got", _answers(F.transform("_calls", lambda c: c["text"])))
    d = d.withColumn("_both", F.transform("_calls", lambda c, i: F.struct(
        F.get("_got", i).alias("value"), F.coalesce(c["next"]["type"] == "python_output", F.lit(False)).alias("answered"), c["next"]["text"].alias("output"))))
    number = lambda test: F.size(F.filter("_both", test)).cast("long")
    return d.withColumns({
        "n_calls": F.size("_calls").cast("long"), "n_refused": number(lambda b: b["value"].isNull()), "n_unanswered": number(lambda b: b["value"].isNotNull() & ~b["answered"]),
        "n_mismatched": number(lambda b: b["value"].isNotNull() & b["answered"] & ~b["value"].eqNullSafe(b["output"]))}).drop("_calls", "_got", "_both")
