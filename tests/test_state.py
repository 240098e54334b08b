"""Transitions, queues, retries and run metadata."""

import itertools

import pytest
from pyspark.sql import types as T

from candrank import constants as C
from candrank.operators import state

AS_OF = "2024-05-01 10:00:00"
LATER = "2024-05-02 11:00:00"
IN = (
    "role string, candidate_id string, source_url string, current_title string, "
    "current_company string, has_resume boolean, ingest_seq long"
)
EVENTS = "role string, candidate_id string, event string, failure_status string, error string"


def arrive(spark, before, rows, as_of=AS_OF, **options):
    data = [("r", key, url, title, None, has, seq) for seq, (key, url, title, has) in enumerate(rows)]
    return state.upsert(before, spark.createDataFrame(data, IN), as_of, **options)


def empty(spark):
    return state.empty_state(spark, T.LongType())


def apply(spark, before, rows, as_of=AS_OF):
    data = [("r", *(list(row) + [None] * (4 - len(row)))) for row in rows]
    return state.apply_events(before, spark.createDataFrame(data, EVENTS), as_of)


def ids(df):
    return sorted(r.candidate_id for r in df.collect())


def by_id(df):
    return {r.candidate_id: r for r in df.collect()}


def test_stage_progression(spark):
    now = arrive(spark, empty(spark), [("a", "u", "t", True)])
    assert ids(state.queue(now, "parse")) == ["a"]
    assert ids(state.queue(now, "profile")) == ids(state.queue(now, "resume")) == []
    now = apply(spark, now, [("a", "parsed")])
    assert ids(state.queue(now, "parse")) == [] and ids(state.queue(now, "stage1")) == ["a"]
    now = apply(spark, now, [("a", "stage1_passed")])
    assert ids(state.queue(now, "stage1")) == [] and ids(state.queue(now, "stage2")) == ["a"]
    now = apply(spark, now, [("a", "stage2_scored")])
    assert by_id(now)["a"].status == "scored"
    assert all(ids(state.queue(now, q)) == [] for q in state.QUEUES)


def test_knocked_out_leaves_the_queue(spark):
    now = apply(spark, arrive(spark, empty(spark), [("a", "", "", True)]), [("a", "stage1_knocked_out")])
    assert by_id(now)["a"].status == "knocked_out"
    assert ids(state.queue(now, "stage2")) == []


def test_no_resume_is_sticky_unless_asked(spark):
    first = arrive(spark, empty(spark), [("a", "", "", False)])
    assert by_id(first)["a"].status == "no_resume"
    assert ids(state.queue(first, "parse")) == []
    second = arrive(spark, first, [("a", "", "", True)], LATER)
    assert by_id(second)["a"].status == "no_resume"
    assert by_id(second)["a"].resume_downloaded_at is not None
    assert by_id(state.retry_reset(second, LATER))["a"].status == "no_resume"
    freed = arrive(spark, first, [("a", "", "", True)], LATER, sticky_no_resume=False)
    assert by_id(freed)["a"].status == "ok"


def test_ingesting_again(spark):
    first = arrive(spark, empty(spark), [("a", "u1", "t1", True), ("b", "u", "t", True), ("c", "u", "t", True)])
    scored = apply(spark, first, [("a", "failed", "failed_score", "boom"), ("b", "single_scored")])
    again = by_id(arrive(spark, scored, [("a", "u2", None, True), ("b", "u", "t", False), ("d", "u", "t", True)], LATER))
    # The error goes, the failed status stays; url and profile are refreshed.
    assert (again["a"].status, again["a"].last_error, again["a"].applicant_url) == ("failed_score", None, "u2")
    assert again["a"].current_title is None
    assert str(again["a"].created_at) == AS_OF and str(again["a"].updated_at) == LATER
    # A vanished resume takes a scored candidate out of the ranking.
    assert again["b"].status == "no_resume"
    assert str(again["c"].updated_at) == AS_OF
    assert again["d"].status == "ok" and len(again) == 4


def test_same_input_twice_changes_no_status(spark):
    rows = [("a", "u", "t", True), ("b", "u", "t", False)]
    first = arrive(spark, empty(spark), rows)
    second = arrive(spark, first, rows, LATER)
    assert {k: r.status for k, r in by_id(first).items()} == {k: r.status for k, r in by_id(second).items()}


def test_retry_keeps_stamps(spark):
    now = apply(spark, arrive(spark, empty(spark), [(k, "", "", True) for k in "abcd"]), [("a", "parsed"), ("b", "parsed")])
    now = apply(
        spark,
        now,
        [("a", "failed", "failed_score", "e"), ("b", "unparseable"), ("c", "failed", "failed_parse", "e")],
    )
    assert state.retry_count(now) == 3
    reset = by_id(state.retry_reset(now, LATER))
    assert [reset[k].status for k in "abcd"] == ["discovered", "discovered", "discovered", "ok"]
    assert reset["a"].last_error is None and reset["a"].resume_parsed_at is not None
    assert str(reset["d"].updated_at) == AS_OF


def test_errors_are_cut(spark):
    now = apply(spark, arrive(spark, empty(spark), [("a", "", "", True)]), [("a", "failed", "failed_score", "é" * 3000)])
    assert by_id(now)["a"].last_error == "é" * 2000


@pytest.mark.parametrize("row", [("a", "failed", "ok", "e"), ("a", "failed", None, "e"), ("a", "unknown")])
def test_bad_events_stop_the_job(spark, row):
    now = arrive(spark, empty(spark), [("a", "", "", True)])
    with pytest.raises(Exception, match="bad failure status|unknown event"):
        apply(spark, now, [row]).collect()


def test_queues_follow_their_rule_for_every_combination(spark):
    stamps = list(state.state_schema(T.LongType()).names)[5:10]
    data, expected = [], {q: [] for q in state.QUEUES}
    for n, (status, bits) in enumerate(itertools.product(C.STATUSES, itertools.product([0, 1], repeat=5))):
        key = f"c{n:04d}"
        data.append((key, status, *[AS_OF if b else None for b in bits]))
        profile, resume, parse, one, two = bits
        stopped = status in (*C.FAILURE_STATUSES, "no_resume")
        out = stopped or status == "knocked_out"
        for q, due in {
            "profile": not profile and not stopped,
            "resume": profile and not resume and not stopped,
            "parse": resume and not parse and not stopped,
            "stage1": parse and not one and not out,
            "stage2": one and not two and not out,
        }.items():
            if due:
                expected[q].append(key)
    df = spark.createDataFrame(data, "candidate_id string, status string, " + ", ".join(f"{s} string" for s in stamps))
    for q in state.QUEUES:
        assert ids(state.queue(df, q)) == expected[q]


def test_status_counts(spark):
    now = arrive(spark, empty(spark), [("a", "", "", True), ("b", "", "", False), ("c", "", "", True)])
    assert {r.status: r.n for r in state.status_counts(now).collect()} == {"ok": 2, "no_resume": 1}


def test_meta(spark):
    schema = "role string, key string, value string, seq long"
    none = spark.createDataFrame([], schema)
    first = state.upsert_meta(none, spark.createDataFrame([("r", "created_at", "t1", 1), ("r", "job_id", "j1", 1)], schema))
    second = state.upsert_meta(first, spark.createDataFrame([("r", "created_at", "t2", 2), ("r", "job_id", "j2", 2)], schema))
    assert {r.key: r.value for r in second.collect()} == {"created_at": "t1", "job_id": "j2"}
    blank = state.upsert_meta(none, spark.createDataFrame([("r", "created_at", "", 1), ("r", "created_at", "t", 2)], schema))
    assert blank.first().value == "t"
