"""Calls, attempt rounds, scorers by name and outcomes."""

import json
import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candrank.operators import scoring

KEYS = "role string, candidate_id string"


def requests_of(spark, n):
    return spark.range(n).select(
        F.lit("r").alias("role"),
        F.concat(F.lit("c"), "id").alias("candidate_id"),
        F.concat(F.lit("q"), "id").alias("request"),
    )


@pytest.mark.parametrize("concurrency, threads", [(1, 1), (3, 1), (4, 2)])
def test_calls_in_flight_stay_bounded(spark, tmp_path, concurrency, threads):
    folder = str(tmp_path)

    def call(request):
        # Every call leaves a start and an end time, and a file of its own.
        start = time.time()
        time.sleep(0.02)
        with open(os.path.join(folder, request), "w") as f:
            f.write(f"{start} {time.time()}")
        return request

    tasks = scoring.tasks_for(concurrency, threads)
    done = scoring.call_scorer(
        requests_of(spark, 24).repartition(tasks, "role", "candidate_id"), call, 1, threads
    )
    rows = done.collect()
    assert sorted(r.raw for r in rows) == sorted(f"q{i}" for i in range(24))
    spans = [tuple(map(float, p.read_text().split())) for p in tmp_path.iterdir()]
    most = max(sum(a <= start < b for a, b in spans) for start, _ in spans)
    assert len(spans) == 24 and most <= concurrency


def test_bad_limits(spark):
    with pytest.raises(ValueError):
        scoring.tasks_for(0)
    assert scoring.tasks_for(8, 3) == 2 and scoring.tasks_for(4, 1, 0) == 0
    with pytest.raises(ValueError):
        scoring.Scorer("other", "m", str)


def test_rounds_repeat_failures_only(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)

    def call(request):
        n = int(request[1:])
        path = os.path.join(folder, request)
        seen = os.path.getsize(path) if os.path.exists(path) else 0
        with open(path, "a") as f:
            f.write("x")
        if n % 3 == 0 and seen < 1:
            raise RuntimeError(f"busy {n}")
        if n % 5 == 0:
            return json.dumps({"message": {"content": "not json"}})
        return json.dumps({"message": {"content": json.dumps({"n": n})}})

    waits, saved = [], []
    monkeypatch.setattr(scoring, "sleep", waits.append)

    def save(df, number):
        path = f"{folder}/_round{number}"
        df.write.parquet(path)
        saved.append(number)
        return spark.read.parquet(path)

    def build(keys):
        due = requests_of(spark, 15)
        return due if keys is None else due.join(keys, ["role", "candidate_id"], "left_semi")

    attempts = scoring.run_attempts(
        build, scoring.Scorer("local_chat", "m", call), True, save, delays=(2.0, 8.0)
    )
    assert waits == [2.0, 8.0] and saved == [1, 2, 3]
    got = {r.candidate_id: r for r in scoring.resolve(attempts).withColumn("payload", F.to_json("payload")).collect()}
    assert len(got) == 15
    for n in range(15):
        row, calls = got[f"c{n}"], os.path.getsize(os.path.join(folder, f"q{n}"))
        if n % 5 == 0:
            assert row.error == "failed after 3 attempts: content is not JSON: not json" and calls == 3
        else:
            assert json.loads(row.payload) == {"n": n} and calls == (2 if n % 3 == 0 else 1)


def test_scorers_by_name():
    scorers = scoring.Scorers()
    made = []

    def factory(kind, default):
        def make(model):
            made.append((kind, model or default))
            return scoring.Scorer("local_chat", model or default, str)

        return make

    scorers.register("alpha", factory("alpha", "big"), knockout_model="small")
    scorers.register("Beta", factory("beta", "mid"))
    full, knockout = scorers.choose("ALPHA")
    assert (full.model, knockout.model) == ("big", "small")
    assert [s.model for s in scorers.choose("alpha", "x", "beta")] == ["x", "mid"]
    assert [s.model for s in scorers.choose("beta", None, "alpha", "tiny")] == ["mid", "tiny"]
    with pytest.raises(ValueError, match="unknown"):
        scorers.choose("gamma")
    with pytest.raises(ValueError, match="unknown"):
        scorers.choose("alpha", knockout_name="gamma")


def result(spark, full, single, answers, texts):
    queued = spark.createDataFrame([("r", k, t is not None) for k, t in texts.items()], f"{KEYS}, ready boolean")
    rows = [("r", k, p, e) for k, (p, e) in answers.items()]
    resolved = spark.createDataFrame(rows, f"{KEYS}, p string, error string").select(
        "role",
        "candidate_id",
        F.try_parse_json("p").alias("payload"),
        "error",
        F.lit(None).cast("timestamp").alias("answered_at"),
    )
    return scoring.outcomes(queued, resolved, full, single)


def payload(passed, total=5):
    return json.dumps(
        {
            "criteria": [],
            "knockouts": [{"id": "k", "passed": passed, "reasoning": ""}],
            "weighted_total": total,
            "recommend": True,
            "summary": "",
            "passed": True,
        }
    )


def test_outcomes_by_mode(spark):
    texts = {"ok": "b", "out": "b", "down": "b", "range": "b", "list": "b", "none": None}
    answers = {
        "ok": (payload(True), None),
        "out": (payload(False), None),
        "down": (None, "failed after 4 attempts: busy"),
        "range": (payload(True, 11), None),
        "list": ("[1]", None),
    }
    expected = {"ok": "passed", "down": "failed", "range": "failed", "list": "failed", "none": "skipped"}

    def outcome(full, single):
        return {r.candidate_id: r.outcome for r in result(spark, full, single, answers, texts).collect()}

    assert outcome(True, True) == {**expected, "out": "knocked_out"}
    # In the full pass of the two-stage mode a failed knockout is scored all the same.
    assert outcome(True, False) == {**expected, "out": "passed"}
    assert outcome(False, False) == {**expected, "out": "knocked_out", "range": "passed"}
    single = result(spark, True, True, answers, texts)
    events = {r.candidate_id: (r.event, r.failure_status) for r in scoring.score_events(single, True, True).collect()}
    assert events == {
        "ok": ("single_scored", None),
        "out": ("stage1_knocked_out", None),
        "down": ("failed", "failed_score"),
        "range": ("failed", "failed_score"),
        "list": ("failed", "failed_score"),
    }
    summary = scoring.score_summary([("single", single)]).drop("role").first().asDict()
    assert summary == {"stage1_scored": 1, "stage2_scored": 1, "knocked_out": 1, "failed": 3, "skipped": 1}
    stored = scoring.with_document(single, True)
    docs = {r.candidate_id: json.loads(r.document) for r in stored.collect() if r.document}
    assert set(docs) == {"ok", "out"} and docs["out"]["recommend"] is False


def test_requests_stay_in_their_tasks(spark):
    """Prefix and schema are joined after the rows are spread, not before."""
    blocks = spark.createDataFrame([("r", f"c{i}", "b") for i in range(9)], f"{KEYS}, block string")
    prefixes = spark.createDataFrame(
        [("r", "p", ["a"], ["k"])], "role string, prefix string, criterion_ids array<string>, knockout_ids array<string>"
    )
    scorer = scoring.Scorer("command", "m", str)
    spread = scoring.build_requests(blocks, prefixes, scorer, True, 3)
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert plan.index("BroadcastHashJoin") < plan.index("REPARTITION_BY_NUM")
    assert spread.rdd.getNumPartitions() == 3 and spread.count() == 9
    in_place = scoring.build_requests(blocks, prefixes, scorer, True)
    assert "REPARTITION" not in in_place._jdf.queryExecution().executedPlan().toString()


def test_full_pass_replaces_the_knockout_document(spark):
    docs = spark.createDataFrame(
        [
            ("r", "a", "full", "new", "s1"),
            ("r", "a", "knockout", "old", "s1"),
            ("r", "b", "full", "x", "s1"),
            ("r", "b", "knockout", "y", "s2"),
            ("r", "b", "knockout", None, "s3"),
        ],
        f"{KEYS}, stage string, document string, run string",
    )
    assert {r.candidate_id: r.document for r in scoring.latest_documents(docs).collect()} == {"a": "new", "b": "y"}


def test_answers_leave_a_task_in_pieces():
    """A task holds the answers to two pieces of requests, however large its batch is."""
    given, held, most = [], 0, 0

    class Requests:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            given.append(run)

    def call(request):
        nonlocal held, most
        held += 1
        most = max(most, held)
        if request.endswith("7"):
            raise RuntimeError("busy")
        return request

    scoring.call_scorer(Requests(), call, 3, 2)
    texts = ["x" * 100_000 + str(i) for i in range(200)] + [None, "y" * 9_000_000]
    batch = pa.RecordBatch.from_pydict(
        {"role": ["eng"] * len(texts), "candidate_id": [str(i) for i in range(len(texts))], "request": texts}
    )
    rows = []
    for out in given[0](iter([batch, batch.slice(0, 0), batch.slice(3, 1)])):
        assert out.schema.names == ["role", "candidate_id", "attempt", "raw", "error", "answered_at"]
        held -= out.num_rows
        rows += out.to_pylist()
    each = scoring.PIECE_BYTES // 100_000 + 1
    assert held == 0 and most <= 2 * each + 2
    assert [int(r["candidate_id"]) for r in rows] == [*range(len(texts)), 3]
    assert all(r["attempt"] == 3 and r["answered_at"].tzinfo for r in rows)
    for r, text in zip(rows, [*texts, texts[3]], strict=True):
        failed = text is None or text.endswith("7")
        assert r["raw"] == (None if failed else text) and (r["error"] is None) == (not failed)
