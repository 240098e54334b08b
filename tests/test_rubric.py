"""Rubric checks, rendering, the implied schema and requests."""

import json

import pytest
from pyspark.sql import functions as F

from candrank import constants as C
from candrank.operators import requests, rubric
from candrank.sources.rubrics import read_job_description, read_rubric, rubric_row


def make(weights=(0.5, 0.5), ids=None, knockouts=("k1", "k2")):
    ids = ids or [f"c{i}" for i in range(len(weights))]
    return {
        "role": "Engineer",
        "knockouts": [{"id": k, "description": f"about {k}"} for k in knockouts],
        "criteria": [
            {"id": i, "weight": w, "description": f"about {i}"} for i, w in zip(ids, weights, strict=True)
        ],
    }


def problems(spark, *rubrics):
    rows = None
    for n, r in enumerate(rubrics):
        row = rubric_row(spark, r, f"r{n}")
        rows = row if rows is None else rows.unionByName(row)
    found = rubric.violations(rubric.rubric_items(rows), rows).collect()
    return sorted((r.role, r.problem) for r in found)


def test_valid_rubrics(spark):
    assert problems(spark, make(), make((0.3333, 0.3333, 0.3334)), make((0.5, 0.4995)), make(knockouts=())) == []


def test_invalid_rubrics(spark):
    assert problems(
        spark,
        make((0.5, 0.4)),
        make((0.5, 0.5), ids=["c", "c"]),
        make(knockouts=("k", "k")),
        make((1.5, -0.5)),
        make((), ids=[], knockouts=()),
        make((0.5, 0.498)),
    ) == [
        ("r0", "weight_sum"),
        ("r1", "criterion_id_repeated"),
        ("r2", "knockout_id_repeated"),
        ("r3", "weight_out_of_range"),
        ("r4", "weight_sum"),
        ("r5", "weight_sum"),
    ]
    with pytest.raises(ValueError, match="weight_sum"):
        rubric.check(rubric_row(spark, make((0.5, 0.4))))


def test_yaml_and_job(spark, tmp_path):
    path = tmp_path / "r.yaml"
    path.write_text(
        "role: Engineer\nversion: 3\nknockouts:\n  - id: k1\n    description: must\n"
        "criteria:\n  - {id: a, weight: 1, description: all}\n",
        encoding="utf-8",
    )
    row = read_rubric(spark, str(path), "eng").first()
    assert (row.role, row.title, row.version, row.criteria[0].weight) == ("eng", "Engineer", 3, 1.0)
    job = tmp_path / "j.txt"
    job.write_text(" \n We hire.\nNow. \n", encoding="utf-8")
    assert read_job_description(spark, str(job), "eng").first().job_text == "We hire.\nNow."


def prefixes(spark, r=None):
    jobs = spark.createDataFrame([("eng", " The job. ")], "role string, job_text string")
    return requests.role_prefixes(rubric_row(spark, r or make((0.125, 0.875)), "eng"), jobs)


def test_prefix_text(spark):
    assert prefixes(spark).first().prefix == (
        "--- JOB DESCRIPTION ---\nThe job.\n\n--- RUBRIC ---\nROLE: Engineer\n\n"
        "KNOCKOUTS (any failure ⇒ recommend=false):\n  - k1: about k1\n  - k2: about k2\n\n"
        "CRITERIA (score each 0–10):\n  - c0 (weight 0.12): about c0\n  - c1 (weight 0.88): about c1\n"
    )


def test_schema(spark):
    row = prefixes(spark).select(
        F.to_json(rubric.answer_schema(F.col("criterion_ids"), F.col("knockout_ids"))).alias("full"),
        F.to_json(rubric.answer_schema(F.col("criterion_ids"), F.col("knockout_ids"), False)).alias("ko"),
    ).first()
    full, ko = json.loads(row.full), json.loads(row.ko)
    assert list(full["properties"]) == full["required"]
    criteria = full["properties"]["criteria"]
    assert (criteria["minItems"], criteria["maxItems"]) == (2, 2)
    assert criteria["items"]["properties"]["id"] == {"type": "string", "enum": ["c0", "c1"]}
    assert criteria["items"]["properties"]["score"] == {"type": "number", "minimum": 0, "maximum": 10}
    assert full["properties"]["weighted_total"] == {"type": "number", "minimum": 0, "maximum": 10}
    assert ko["required"] == ["candidate_id", "knockouts", "passed"]
    assert ko["properties"]["knockouts"]["items"]["properties"]["id"]["enum"] == ["k1", "k2"]


def blocks(spark):
    queued = spark.createDataFrame([("eng", "c1"), ("eng", "c2"), ("eng", "c3")], "role string, candidate_id string")
    texts = spark.createDataFrame([("eng", "c1", "T1"), ("eng", "c2", "T2")], "role string, candidate_id string, text string")
    metadata = spark.createDataFrame(
        [("eng", "c1", "Ann", "", " x "), ("eng", " c2", "Bo", "h", "y")],
        "role string, candidate_id string, name string, headline string, `extra.col` string",
    )
    return requests.candidate_blocks(queued, texts, metadata, ["candidate_id", "name", "headline", "extra.col"])


def test_blocks(spark):
    got = {r.candidate_id: r.block for r in blocks(spark).collect()}
    assert got["c1"] == (
        "CANDIDATE_ID: c1\n--- PROFILE METADATA ---\ncandidate_id: c1\nname: Ann\nextra.col:  x \n"
        "--- RESUME TEXT ---\nT1\n"
    )
    # A padded id finds no metadata; no text means no block.
    assert got["c2"] == "CANDIDATE_ID: c2\n--- PROFILE METADATA ---\n\n--- RESUME TEXT ---\nT2\n"
    assert got["c3"] is None


def test_request_layouts(spark):
    ready = requests.with_prefix(blocks(spark).filter("candidate_id = 'c1'"), prefixes(spark))
    row = ready.select(
        "prefix",
        "block",
        *[requests.request_json(n, "m").alias(n) for n in requests.LAYOUTS],
        requests.request_json("tool_block", "m", full=False).alias("ko"),
        requests.request_json("local_chat", "m", thinking=True).alias("thinking"),
    ).first()
    tool = json.loads(row.tool_block)
    assert tool["tool_choice"] == {"type": "tool", "name": C.FULL_TOOL}
    assert tool["messages"][0]["content"] == [
        {"type": "text", "text": row.prefix, "cache_control": {"type": "ephemeral"}},
        {"type": "text", "text": row.block},
    ]
    assert (tool["model"], tool["max_tokens"], tool["system"]) == ("m", 2048, C.SYSTEM_PROMPT)
    assert json.loads(row.ko)["tools"][0]["name"] == C.KNOCKOUT_TOOL
    chat = json.loads(row.chat_completion)
    assert chat["messages"][1] == {"role": "user", "content": f"{row.prefix}\n\n{row.block}"}
    assert chat["response_format"]["json_schema"]["strict"] is True
    assert chat["response_format"]["json_schema"]["schema"] == tool["tools"][0]["input_schema"]
    local = json.loads(row.local_chat)
    assert local["think"] is False and "think" not in json.loads(row.thinking)
    assert local["stream"] is False and local["options"] == {"temperature": 0.1}
    assert local["format"] == tool["tools"][0]["input_schema"]
    assert local["messages"][1]["content"].startswith(f"{row.prefix}\n\n--- CANDIDATE ---\n{row.block}\n\n--- TASK ---\n")
    command = json.loads(row.command)
    assert command["prompt"] == f"{row.prefix}\n\n--- CANDIDATE ---\n{row.block}\n\n{C.COMMAND_TASK}"
    with pytest.raises(ValueError):
        requests.request_json("other", "m")


def test_violations_dealt_to_bounded_tasks(spark, monkeypatch):
    items = spark.createDataFrame(
        [(f"r{i % 20}", "criterion" if i % 3 else "knockout", f"c{i % 7}", 0.4 if i % 3 else None) for i in range(200)]
        + [(None, "criterion", None, 2.0), ("r1", "criterion", "c1", None)],
        "role string, kind string, item_id string, weight double",
    )

    def found():
        return sorted(map(str, rubric.violations(items).collect()))

    together = found()
    monkeypatch.setattr(rubric, "TASK_ITEMS", 20)
    assert found() == together and len(together) > 20
    plan = rubric.violations(items)._jdf.queryExecution().executedPlan().toString()
    # Both groups take the tasks that the items were dealt to, and make no partitions of their own.
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan
