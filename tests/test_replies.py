"""Answers by dialect, attempts, validation."""

import json

import pytest
from pyspark.sql import functions as F

from candrank.operators import replies, validate


def parsed(spark, dialect, raws, tool="t"):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    done = replies.parse_replies(rows, dialect, tool).select("i", F.to_json("payload").alias("p"), "parse_error")
    return [(r.p and json.loads(r.p), r.parse_error) for r in done.orderBy("i").collect()]


def test_tool_block(spark):
    text = {"type": "text", "text": "x"}
    call = {"type": "tool_use", "name": "t", "input": {"a": 1}}
    got = parsed(
        spark,
        "tool_block",
        [
            json.dumps({"content": [text, call, {**call, "input": {"a": 2}}]}),
            json.dumps({"content": [text, {**call, "name": "u"}, {"other": 1}]}),
            json.dumps({"content": []}),
            "{",
            json.dumps({"error": "x"}),
            None,
        ],
    )
    assert got[0] == ({"a": 1}, None)
    assert got[1] == (None, "no tool_use block named t; got types: text, tool_use, ?")
    assert got[2] == (None, "no tool_use block named t; got types: ")
    assert got[3] == (None, "answer is not JSON: {")
    assert got[4] == (None, "answer has no content blocks")
    assert got[5] == (None, "no answer")


def chat(content, finish="stop", **message):
    return json.dumps({"choices": [{"finish_reason": finish, "message": {"content": content, **message}}]})


def test_chat_completion(spark):
    got = parsed(
        spark,
        "chat_completion",
        [
            chat('{"a": 1}', refusal=None),
            chat(None, refusal="no thanks"),
            chat('{"a": 1}', "length", refusal="no"),
            chat("", refusal=""),
            chat('{"a": 1} trailing'),
            json.dumps({"choices": []}),
            chat("[1]"),
        ],
    )
    assert got == [
        ({"a": 1}, None),
        (None, "refused: no thanks"),
        (None, "answer cut by the token limit"),
        (None, "empty content without a refusal"),
        (None, 'content is not JSON: {"a": 1} trailing'),
        (None, "answer has no choice"),
        ([1], None),
    ]


def test_local_chat(spark):
    got = parsed(
        spark,
        "local_chat",
        [
            json.dumps({"message": {"content": '{"a": "é"}'}}),
            json.dumps({"message": {"content": ""}}),
            json.dumps({}),
            json.dumps({"message": {"content": "<think>"}}),
        ],
    )
    assert got[0] == ({"a": "é"}, None)
    assert [e for _, e in got[1:]] == ["empty content", "empty content", "content is not JSON: <think>"]


def test_command(spark):
    ok = {"type": "result", "subtype": "success"}
    payload = {"candidate_id": "c", "n": 1}
    cases = [
        ({**ok, "result": payload}, payload, None),
        ({**ok, "result": json.dumps(payload)}, payload, None),
        ({**ok, "result": f"```json\n{json.dumps(payload)}\n```"}, payload, None),
        (payload, payload, None),
        ({"n": 1}, None, "envelope has no result"),
        ({**ok, "is_error": True, "result": "log in"}, None, "command reported: log in"),
        ({**ok, "is_error": True, "result": "", "error": "late"}, None, "command reported: late"),
        ({"type": "result", "subtype": "error", "result": payload}, None, "command did not succeed"),
        ({**ok, "result": "prose"}, None, "content is not JSON: prose"),
        ({**ok, "result": [1]}, None, "result has an unexpected type: ARRAY"),
        ({**ok, "result": None, "candidate_id": None}, {**ok, "result": None, "candidate_id": None}, None),
        ("a JSON text", None, "envelope has no result"),
    ]
    raws = [json.dumps(c[0]) for c in cases]
    raws[0] = f"Warning: slow\n{raws[0]}  \n"
    for (p, error), (_, payload_, message) in zip(parsed(spark, "command", raws), cases, strict=True):
        if message is None:
            assert (p, error) == (payload_, None)
        else:
            assert p is None and error.startswith(message)
    assert parsed(spark, "command", ["plain words", "x {1", "{} tail"]) == [
        (None, "answer is not JSON: plain words"),
        (None, "answer is not JSON: x {1"),
        (None, "answer is not JSON: {} tail"),
    ]


def test_command_errors(spark):
    cases = [
        ("", "", "(no output on stdout or stderr)"),
        ("out", " err ", "err"),
        ("out", " \n", "out"),
        (json.dumps({"result": "not logged in"}), "", "not logged in"),
        (json.dumps({"result": "", "error": "e"}), "", "e"),
        (json.dumps({"x": 1}), "", '{"x":1}'),
        ("y" * 1500, "", "y" * 1000),
        ("[1, 2]", "", "[1, 2]"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, o string, e string, want string")
    got = replies.command_errors(df, F.col("o"), F.col("e")).orderBy("i").collect()
    assert [r.message for r in got] == [c[2] for c in cases]


def test_attempts(spark):
    rows = [
        ("a", 1, None, "e1"),
        ("a", 2, "p2", None),
        ("a", 3, "p3", None),
        ("b", 2, None, "e2"),
        ("b", 1, None, "e1"),
    ]
    df = spark.createDataFrame(rows, "k string, attempt int, payload string, error string")
    got = {r.k: r for r in replies.resolve_attempts(df, ["k"]).collect()}
    assert (got["a"].payload, got["a"].error) == ("p2", None)
    assert (got["b"].payload, got["b"].error) == (None, "failed after 2 attempts: e2")


BASE = {
    "candidate_id": "x",
    "criteria": [{"id": "a", "score": 5, "reasoning": ""}],
    "knockouts": [{"id": "k", "passed": True, "reasoning": ""}],
    "weighted_total": 5,
    "recommend": True,
    "summary": "s",
}


def check(spark, function, payloads, **options):
    rows = spark.createDataFrame([(i, "c", json.dumps(p)) for i, p in enumerate(payloads)], "i int, candidate_id string, p string")
    done = function(rows.withColumn("payload", F.parse_json("p")), **options)
    return done.select("i", "score", "invalid").orderBy("i").collect()


def without(key):
    return {k: v for k, v in BASE.items() if k != key}


@pytest.mark.parametrize("key", sorted(set(BASE) - {"candidate_id"}))
def test_every_field_is_required(spark, key):
    absent, null = check(spark, validate.validate_full, [without(key), {**BASE, key: None}])
    assert absent.invalid == null.invalid == f"invalid: {key}"
    assert absent.score is None


def test_full_validation(spark):
    failed = [{"id": "k", "passed": False, "reasoning": ""}]
    cases = [
        (BASE, None),
        (without("candidate_id"), None),
        ({**BASE, "candidate_id": None}, "candidate_id"),
        ({**BASE, "candidate_id": 5}, "candidate_id"),
        ({**BASE, "weighted_total": 10.01}, "weighted_total"),
        ({**BASE, "weighted_total": -0.1}, "weighted_total"),
        ({**BASE, "weighted_total": "10"}, None),
        ({**BASE, "criteria": [{"id": "a", "score": 11, "reasoning": ""}]}, "criteria"),
        ({**BASE, "criteria": [{"id": "a", "score": 1}]}, "criteria"),
        ({**BASE, "criteria": [5]}, "criteria"),
        ({**BASE, "criteria": {}}, "criteria"),
        ({**BASE, "criteria": [], "knockouts": []}, None),
        ({**BASE, "knockouts": failed}, None),
        ({**BASE, "recommend": "maybe", "summary": 1}, "recommend, summary"),
        ({**BASE, "more": 1}, None),
    ]
    got = check(spark, validate.validate_full, [c[0] for c in cases])
    assert [r.invalid for r in got] == [c[1] and f"invalid: {c[1]}" for c in cases]
    assert [r.score.candidate_id for r in got[:2]] == ["x", "c"]
    assert got[0].score.recommend is True
    assert got[12].score.recommend is False
    assert got[11].score.recommend is True
    for other in ([1], "x", 5, None):
        assert check(spark, validate.validate_full, [other])[0].invalid == "answer is not an object"


def test_strict_ids(spark):
    ids = {"criterion_ids": F.array(F.lit("a")), "knockout_ids": F.array(F.lit("k"), F.lit("k2"))}
    more = [*BASE["knockouts"], {"id": "k2", "passed": True, "reasoning": ""}]
    got = check(
        spark,
        validate.validate_full,
        [BASE, {**BASE, "knockouts": more}, {**BASE, "knockouts": more, "criteria": [{"id": "z", "score": 1, "reasoning": ""}]}],
        **ids,
    )
    assert [r.invalid for r in got] == ["invalid: knockout ids", None, "invalid: criteria ids"]


def test_knockout_validation(spark):
    def answer(*passed, claim):
        return {"knockouts": [{"id": "k", "passed": p, "reasoning": ""} for p in passed], "passed": claim}

    got = check(
        spark,
        validate.validate_knockout,
        [answer(True, False, claim=True), answer(True, claim=False), answer(claim=False), answer(2, claim=True), {"passed": True}],
    )
    assert [r.score and r.score.passed for r in got] == [False, True, True, None, None]
    assert [r.invalid for r in got[3:]] == ["invalid: knockouts"] * 2
