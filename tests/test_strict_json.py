"""The token scan against the standard parser with hooks."""

from __future__ import annotations

import json
import math
import random
import time

import pytest

from tidemark.sources.strict_json import json_problem, problem


class _RefusedError(Exception):
    pass


def plain(text: str) -> bool:
    """Whether the standard parser, told to refuse repeated keys and numbers that are not finite, takes the text."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise _RefusedError
        return dict(items)

    def number(token):
        if not math.isfinite(float(token)):
            raise _RefusedError
        return float(token)

    def constant(token):
        raise _RefusedError

    try:
        json.loads(text, object_pairs_hook=pairs, parse_float=number, parse_constant=constant)
    except (ValueError, _RefusedError):
        return False
    return True


def test_agrees_with_the_standard_parser():
    rng = random.Random(12)
    pieces = ['{', '}', '[', ']', ',', ':', '"a"', '"b"', '"\\u0061"', '"é"', '""', "1", "-0", "01", "1.5", "1e5", "1e999", "-1E400", "NaN", "-Infinity", "null", "true", " ", "\n", '"\\x"', '"\t"', "tru", "-"]
    sound = 0
    for _ in range(60_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        assert (problem(text) is None) == plain(text), text
        sound += problem(text) is None

    def built(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(["1", '"x"', "null", "-2.5e3"])
        if kind < 0.6:
            return "[" + ",".join(built(depth - 1) for _ in range(rng.randint(0, 3))) + "]"
        return "{" + ", ".join(f'"{rng.choice("abcdefg")}": {built(depth - 1)}' for _ in range(rng.randint(0, 3))) + "}"

    found = [problem(text) for text in (built(5) for _ in range(3_000))]
    assert sound > 200 and found.count("duplicate_key") > 100 and found.count(None) > 100 and set(found) == {None, "duplicate_key"}


@pytest.mark.parametrize(("text", "reason"), [
    ('{"a":{"b":[{"c":1,"c":2}]}}', "duplicate_key"), ('{"k":1,"\\u006b":2}', "duplicate_key"), ('{"a":{"k":1},"b":{"k":1}}', None), ('{"a":1e999}', "non_finite_number"), ("[NaN]", "non_finite_number"),
    ("", "invalid_json"), (None, "invalid_json"), ("{} {}", "invalid_json"), ("1", None), ('{"a":1,}', "invalid_json"), ("[1,]", "invalid_json"), ("[}", "invalid_json"), (" [ ] ", None),
])
def test_reasons(spark, text, reason):
    assert problem(text) == reason
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(json_problem(F.col("t")).alias("p")).first().p == reason


def test_deep_and_long_texts_are_linear():
    began = time.perf_counter()
    assert problem("[" * 300_000 + "]" * 300_000) is None
    assert problem('{"a":' * 100_000 + "1" + "}" * 100_000) is None
    assert problem('"' + "x" * 3_000_000) == "invalid_json"
    assert time.perf_counter() - began < 10
