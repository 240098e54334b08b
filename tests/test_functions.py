"""Text and variant readers against Python's own behaviour."""

import json
import random

import pytest
from pyspark.sql import functions as F

from candrank.functions import text as T
from candrank.functions import variant as V


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strip_matches_python(spark):
    values = [" a ", "　x\x85", "\x1cab\x1f\t", "a​b ", "", " \n\t ", None, "a b"]
    assert column(spark, values, T.strip) == [v if v is None else v.strip() for v in values]


def test_strip_or_null(spark):
    assert column(spark, ["  ", None, " a "], T.strip_or_null) == [None, None, "a"]
    assert column(spark, ["  ", None, " a "], T.strip_or_empty) == ["", "", "a"]


@pytest.mark.parametrize("digits", [2, 3])
def test_fixed_matches_exact_rounding(spark, digits):
    draw = random.Random(3)
    values = [i / 10_000 for i in range(0, 100_001, 35)]
    values += [draw.random() * 10 for _ in range(2000)]
    values += [0.125, 0.0625, 0.5625, 0.0005, 0.0045, 8.1245, 2.5, 10.0, 0.0, 1e-9, 15.9999]
    got = column(spark, values, lambda c: T.fixed(c, digits), "double")
    assert got == [f"{v:.{digits}f}" for v in values]


def test_fixed_over_the_whole_range(spark):
    draw = random.Random(4)
    values = [16.0625, -0.0625, -0.0, -0.0001, 100.12345, -1.5, 999.9995, 0.9999, 1e6 + 0.0625, 2.0**53 + 2, 2.0**60]
    values += [s * draw.random() * 10**e for s in (1, -1) for e in range(1, 14) for _ in range(40)]
    values += [i + k / 16 for i in range(-20, 1000, 7) for k in range(16)]
    got = column(spark, values, lambda c: T.fixed(c, 3), "double")
    assert got == [f"{v:.3f}" for v in values]


def test_fences(spark):
    values = ['```json\n{"a":1}\n```', "```\nx\n```", "no fence", "a ```b``` c", " ```json {}\n``` "]
    assert column(spark, values, T.strip_fences) == ['{"a":1}', "x", "no fence", "a ```b``` c", "```json {}"]


def test_drop_invalid(spark):
    got = column(spark, [b"ab\xffc", "x�y".encode(), b"\xc3", b""], lambda c: T.drop_invalid(c.cast("string")), "binary")
    assert got == ["abc", "x�y", "", ""]


JSON_VALUES = [
    "8.5", '" 8.5 "', '"1e1"', '"+3"', '".5"', '"5."', "true", "false", '"9d"', '"nan"', '"inf"', "null",
    "10", "10.01", "-0.1", "0", "1", "2", "1.0", "0.0", '"on"', '"OFF"', '"yes"', '"N"', '"t"', '" true "',
    '"2"', "[]", "{}", '[1]', '""', '"x"', "1e1", "1e400", "123456789012345678901234567890",
]


def test_readers_agree_with_a_lax_validator(spark):
    pydantic = pytest.importorskip("pydantic")
    from typing import Annotated

    bounded = pydantic.TypeAdapter(Annotated[float, pydantic.Field(ge=0, le=10)])
    kinds = [
        (bounded, lambda v: F.when(V.number(v).between(0.0, 10.0), V.number(v))),
        (pydantic.TypeAdapter(bool), V.boolean),
        (pydantic.TypeAdapter(str), V.text),
    ]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(JSON_VALUES)], "i int, x string")
    for adapter, reader in kinds:
        expected = []
        for v in JSON_VALUES:
            try:
                expected.append(adapter.validate_python(json.loads(v)))
            except pydantic.ValidationError:
                expected.append(None)
        got = [r.y for r in V.with_json(rows, "v", F.col("x")).select("i", reader(F.col("v")).alias("y")).orderBy("i").collect()]
        assert got == expected


def test_truthy(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(JSON_VALUES)], "i int, x string")
    got = [r.y for r in V.with_json(rows, "v", F.col("x")).select("i", V.truthy(F.col("v")).alias("y")).orderBy("i").collect()]
    assert got == [bool(json.loads(v)) for v in JSON_VALUES]


def test_only_whole_json_texts_are_read(spark):
    values = ['{"a":1}', ' {"a":1}\n', '{"a":1} and more', "5 words", '{"a":1}]', "1,2", '1,"x"]', "", " ", "[", None, "null", '"x"', "1]]", '{"a":1}}']
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    got = [r.y for r in V.with_json(rows, "v", F.col("x")).select("i", F.col("v").isNotNull().alias("y")).orderBy("i").collect()]

    def reads(v):
        try:
            json.loads(v)
            return True
        except (TypeError, ValueError):
            return False

    assert got == [reads(v) for v in values]


def test_filters_do_not_copy_the_parse(spark):
    from candrank.operators.replies import parse_replies

    raw = spark.createDataFrame([("{}",)], "raw string")
    done = parse_replies(raw, "command").filter("payload is null and parse_error like 'x%'")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") <= 3
