"""Tool calls: the calculator's language, and counts per conversation."""

import pytest

from textmill.operators.chat import MESSAGE
from textmill.operators.tools import calculate, verify_tool_outputs


@pytest.mark.parametrize("text,value", [
    ("2+3*4", "14"), ("(2+3)*4", "20"), ("-2 - -3", "1"), ("7/2", "3.5"), ("7//2", "3"), ("-7//2", "-4"), ("1,000 * 2", "2000"), ("1/3", str(1 / 3)), (" 4 ", "4"),
    (".5+1.", "1.5"), ("'strawberry'.count('r')", "3"), ('"aaaa".count("aa")', "2"), ("'a b'.count('')", "4"), ("2*(3+(4-1))/6", "2.0"),
    ("2**3", None), ("1/0", None), ("1+", None), ("", None), (None, None), ("007", None), ("'a'.upper()", None), ("__import__('os').count('a')", None),
    ("open('f').count('a')", None), ("x.count('a')", None), ("'a'.count('a').count('a')", None), ("2;3", None), ("(" * 500 + "1" + ")" * 500, None), ("9" * 990, "9" * 990),
    ("*".join(["9" * 99] * 9), str(int("9" * 99) ** 9)), ("*".join(["9" * 199] * 5 + ["9" * 9]), None), ("1" * 1001, None), ("True.count('a')", None), ("1e5", None)])
def test_calculate(text, value):
    assert calculate(text) == value


def test_counts(spark):
    call = lambda e, out=None: [("python", e), *([("python_output", out)] if out is not None else [])]
    rows = [
        (1, [("user", "q", None), ("assistant", None, [("text", "x"), *call("1+1", "2"), *call("2*3", "7"), ("text", "y")])]),
        (2, [("assistant", None, call("1+1")), ("assistant", None, [("python_output", "2")])]),  # of another message: no answer
        (3, [("user", "q", call("1+1", "3"))]),  # not the assistant's
        (4, [("assistant", "plain", None)]), (5, []), (6, None),
        (7, [("assistant", None, call("2**2", "4") + call("1", "1") + call(None, "1")), (None, None, call("1", "2"))]),
        (8, [("assistant", None, [("python", "3"), ("text", "3"), ("python_output", "3"), (None, None), ("python", "4"), ("python_output", None)])])]
    d = spark.createDataFrame(rows, f"conv_id long, messages array<{MESSAGE}>")
    got = {r[0]: tuple(r)[1:] for r in verify_tool_outputs(d).drop("messages").collect()}
    none = (0, 0, 0, 0)
    assert got == {1: (2, 0, 0, 1), 2: (1, 0, 1, 0), 3: none, 4: none, 5: none, 6: none, 7: (3, 2, 0, 0), 8: (2, 0, 1, 1)}
    assert verify_tool_outputs(d.limit(0)).count() == 0
