"""Strict JSON: what a lenient parser lets pass is refused, at any depth.

A text is read token by token; a stack has the keys of each open object. So a key that
comes twice in one object is found wherever it is, also where one spelling is escaped, as
are NaN, infinities and numbers beyond the range of a double. Nothing is built from the
text, and work is linear in it.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""[\x20\t\n\r]*+(?:(?P<string>"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")"""
    r"""|(?P<number>-?(?:0|[1-9][0-9]*+)(?P<float>(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+))"""
    r"""|(?P<word>true|false|null)|(?P<mark>[\[\]{}:,])|(?P<bad>-?Infinity|NaN))"""
)
_BLANK = re.compile(r"[\x20\t\n\r]*")
# what may come next
VALUE, VALUE_OR_END, KEY, KEY_OR_END, COLON, MORE_OR_END, NOTHING = range(7)


def problem(text: str | None) -> str | None:
    """invalid_json, duplicate_key or non_finite_number, whichever comes first in the text; None for sound JSON. Null is invalid."""
    if text is None:
        return "invalid_json"
    stack: list[set[str] | None] = []
    expected, at = VALUE, 0
    while expected != NOTHING:
        token = _TOKEN.match(text, at)
        if token is None:
            return "invalid_json"
        at, kind = token.end(), token.lastgroup
        if kind == "float":
            kind = "number"
        mark = token["mark"]
        if expected in (VALUE, VALUE_OR_END) and mark not in (":", ",", "}") and not (mark == "]" and expected == VALUE):
            if mark == "]":
                stack.pop()
            elif mark is not None:
                stack.append(set() if mark == "{" else None)
                expected = KEY_OR_END if mark == "{" else VALUE_OR_END
                continue
            elif kind == "bad" or (kind == "number" and token["float"] and not math.isfinite(float(token["number"]))):
                return "non_finite_number"
        elif expected in (KEY, KEY_OR_END) and kind == "string":
            key = token["string"][1:-1]
            if "\\" in key:
                key = json.loads(token["string"])
            if key in stack[-1]:
                return "duplicate_key"
            stack[-1].add(key)
            expected = COLON
            continue
        elif expected == KEY_OR_END and mark == "}":
            stack.pop()
        elif expected == COLON and mark == ":":
            expected = VALUE
            continue
        elif expected == MORE_OR_END and mark == ",":
            expected = VALUE if stack[-1] is None else KEY
            continue
        elif expected == MORE_OR_END and mark == ("]" if stack[-1] is None else "}"):
            stack.pop()
        else:
            return "invalid_json"
        expected = MORE_OR_END if stack else NOTHING
    return None if _BLANK.fullmatch(text, at) else "invalid_json"


def _problems(texts: pd.Series) -> pd.Series:
    return texts.map(problem)


def json_problem(text: Column) -> Column:
    """problem() of each text, in Arrow batches."""
    return F.pandas_udf(_problems, "string")(text)
