"""Stages over a store: end to end, resuming, retries and both modes."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from candrank.operators import extract, ranking, requests, scoring, state
from candrank.operators.scoring import Scorer
from candrank.plans import run
from candrank.sources import resumes as resume_files
from candrank.sources.candidates import IngestError, read_candidates
from candrank.sources.resumes import ResumeScan, resume_contents
from candrank.sources.rubrics import rubric_row
from candrank.sources.store import Store

AS_OF = "2024-05-01 10:00:00"
RUBRIC = {
    "role": "Builder",
    "knockouts": [{"id": "k1", "description": "must build"}],
    "criteria": [
        {"id": "a", "weight": 0.6, "description": "alpha"},
        {"id": "b", "weight": 0.4, "description": "beta"},
    ],
}


def reader(content: bytes) -> list[str]:
    text = content.decode("utf-8")
    if text.startswith("BROKEN"):
        raise ValueError("cannot decode")
    return text.split("\f")


def answer(request: str) -> str:
    """Deterministic stand-in: the resume's first line says what to answer."""
    body = json.loads(request)
    block = body["messages"][1]["content"]
    text = block.split("--- RESUME TEXT ---\n")[1]
    word, number = text.split()[:2]
    if word == "ERROR":
        raise RuntimeError("endpoint down")
    knockouts = [{"id": "k1", "passed": word != "OUT", "reasoning": "r"}]
    if body["response_format"]["json_schema"]["name"] == "record_knockout_check":
        payload = {"knockouts": knockouts, "passed": True}
    else:
        payload = {
            "criteria": [
                {"id": "a", "score": 5, "reasoning": "r"},
                {"id": "b", "score": "6", "reasoning": "r"},
            ],
            "knockouts": knockouts,
            "weighted_total": 99 if word == "RANGE" else float(number),
            "recommend": True,
            "summary": f"{word} {number}",
        }
    return json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": json.dumps(payload)}}]})


@pytest.fixture(autouse=True)
def _interpreted(spark):
    """Many tiny jobs: compiling code for each would take most of the time."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")
    spark.conf.unset("spark.sql.codegen.factoryMode")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


SCORER = Scorer("chat_completion", "m", answer)


def write_inputs(folder, rows, resumes):
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / "in.csv", "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(["candidate_id", "name", "current_title", "profile_url", "referrer"])
        writer.writerows(rows)
    (folder / "pdf").mkdir(exist_ok=True)
    for key, text in resumes.items():
        (folder / "pdf" / f"{key}.pdf").write_text(text, encoding="utf-8")


def long(text):
    return text + " " + "x" * 250


def inputs(folder):
    write_inputs(
        folder,
        [
            ["c1", "One", " dev ", "u1", "x"],
            ["c2", "Two", "", "u2", ""],
            [" c1 ", "Again", "late", "u9", ""],
            ["", "Nobody", "", "", ""],
            ["c3", "Three", "t", "", ""],
            ["c4", "Four", "t", "", ""],
            ["c5", "Five", "t", "", ""],
            ["c6", "Six", "t", "", ""],
            ["c7", "Seven", "t", "", ""],
            ["c8", "Eight", "t", "", ""],
        ],
        {
            "c1": long("OK 3"),
            "c2": long("OK 9.5"),
            "c3": long("OUT 8"),
            "c4": long("ERROR 1"),
            "c5": "short",
            "c6": "BROKEN",
            "c8": long("RANGE 1"),
        },
    )


def start(spark, folder, store, notes=None, **more):
    settings = run.ScoreSettings(delays=(0.0,), **more)
    return run.run_all(
        store,
        str(folder / "out"),
        AS_OF,
        rubric_row(spark, RUBRIC, "eng"),
        spark.createDataFrame([("eng", "  the job ")], "role string, job_text string"),
        SCORER,
        read_candidates(spark, str(folder / "in.csv"), "eng"),
        resume_contents(spark, str(folder / "pdf"), "eng"),
        readers=[("plain", reader)],
        settings=settings,
        notes=notes,
    )


def statuses(store):
    return {r.candidate_id: r.status for r in store.read("state").collect()}


@pytest.mark.parametrize("buckets", [None, 4])
def test_single_mode_end_to_end(spark, tmp_path, buckets):
    inputs(tmp_path)
    store = Store(spark, str(tmp_path / "store"), buckets)
    summaries = start(spark, tmp_path, store)
    got = {k: [r.asDict() for r in df.drop("role").collect()] for k, df in summaries.items()}
    assert got["ingest"] == [
        {
            "ingested": 8,
            "with_resume": 7,
            "without_resume": 1,
            "duplicates_skipped": 1,
            "unknown_columns": "profile_url, referrer",
        }
    ]
    assert got["parse"] == [{"parsed": 5, "unparseable": 1, "failed": 1, "skipped": 0}]
    assert got["score"] == [
        {"stage1_scored": 2, "stage2_scored": 2, "knocked_out": 1, "failed": 2, "skipped": 0}
    ]
    assert got["rank"] == [{"ranked": 2, "top_n_written": 2, "resumes_copied": 2}]
    assert statuses(store) == {
        "c1": "scored",
        "c2": "scored",
        "c3": "knocked_out",
        "c4": "failed_score",
        "c5": "unparseable",
        "c6": "failed_parse",
        "c7": "no_resume",
        "c8": "failed_score",
    }
    errors = {r.candidate_id: r.last_error for r in store.read("state").collect()}
    assert errors["c4"] == "failed after 2 attempts: endpoint down"
    assert errors["c8"] == "invalid: weighted_total"
    assert errors["c6"] == "cannot decode"
    lines = (
        spark.read.text(str(tmp_path / "out/ranked"), wholetext=True).select("value").first()[0].splitlines()
    )
    assert lines == [
        "rank,candidate_id,name,headline,location,current_title,current_company,"
        "weighted_total,recommend,summary,profile_url",
        "1,c2,Two,,,,,9.500,true,OK 9.5,u2",
        "2,c1,One,,, dev ,,3.000,true,OK 3,u1",
    ]
    bundle = spark.read.parquet(str(tmp_path / "out/ranked_resumes")).orderBy("rank").collect()
    assert [b.file_name for b in bundle] == ["001_c2.pdf", "002_c1.pdf"]
    assert bytes(bundle[1].content).decode() == long("OK 3")


@pytest.mark.parametrize("buckets", [None, 4])
def test_audit_of_a_run(spark, tmp_path, buckets):
    inputs(tmp_path)
    store = Store(spark, str(tmp_path / "store"), buckets)
    start(spark, tmp_path, store)
    groups = spark.createDataFrame([("eng", "c1", "x"), ("eng", "c3", "x")], "role string, candidate_id string, g string")
    before = statuses(store)
    found = run.run_audit(store, rubric_row(spark, RUBRIC, "eng"), groups, top=1)
    totals = {r.candidate_id: (float(r.recomputed), float(r.claimed), r.verdict) for r in store.read("audit").collect()}
    assert totals == {"c1": (5.4, 3.0, "differs"), "c2": (5.4, 9.5, "differs")}
    summary = found["totals"].first()
    assert (summary.answers, summary.differs, float(summary.largest_difference)) == (2, 2, 4.1)
    shares = {r.g: (r.rows, r.selected, r.q_50, r.ks, r.impact_ratio) for r in found["groups"].collect()}
    assert shares == {"x": (1, 0, 3.0, 0.5, 0.0), None: (1, 1, 9.5, 0.5, 1.0)}
    assert run.run_audit(store, rubric_row(spark, RUBRIC, "eng"))["groups"].first().rows == 2
    assert statuses(store) == before


def test_bundle_as_files_and_header_only_rankings(spark, tmp_path):
    inputs(tmp_path)
    store = Store(spark, str(tmp_path / "store"), 4)
    start(spark, tmp_path, store)
    # A role of which nothing is ranked.
    raw = spark.createDataFrame([("idle", "x/1", 1)], "role string, candidate_id string, n int")
    run.run_ingest(store, raw.select("role", "candidate_id", _seq().alias("ingest_seq")), raw.limit(0), AS_OF)
    run.run_rank(store, str(tmp_path / "files"), bundle_files=True)
    folder = tmp_path / "files/ranked_files/role=eng"
    assert {f.name: f.read_bytes().decode() for f in folder.iterdir() if f.name[0] != "."} == {
        "001_c2.pdf": (tmp_path / "pdf/c2.pdf").read_text(),
        "002_c1.pdf": (tmp_path / "pdf/c1.pdf").read_text(),
    }
    for name in ("ranked", "ranked_full"):
        (bare,) = [f for f in (tmp_path / "files" / name / "role=idle").iterdir() if f.name[0] not in "._"]
        full = [f for f in (tmp_path / "files" / name / "role=eng").iterdir() if f.suffix == ".csv"]
        assert bare.read_text() == full[0].read_text().splitlines()[0] + "\n"


def _seq():
    return F.struct(F.lit("f").alias("file"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row"))


def test_scan_reads_changed_files_only(spark, tmp_path):
    folder, store = tmp_path / "pdf", Store(spark, str(tmp_path / "store"), 4)
    folder.mkdir()
    for name in "abcd":
        (folder / f"{name}.pdf").write_text(f"first {name}")
    raw = spark.createDataFrame([("eng", k, i) for i, k in enumerate("abcde")], "role string, candidate_id string, ingest_seq int")
    run.run_ingest_folder(store, raw, str(folder), "eng", AS_OF)
    (folder / "b.pdf").write_text("second b")
    os.utime(folder / "c.pdf", (1_000_000, 1_000_000))  # older than before, still another file
    (folder / "c.pdf").open("a").close()
    (folder / "d.pdf").unlink()
    (folder / "e.pdf").write_text("first e")
    scan = ResumeScan(store, str(folder), "eng")
    assert {r.candidate_id: r.change for r in scan.changes.collect()} == {"a": "same", "b": "changed", "c": "changed", "d": "gone", "e": "new"}
    assert {r.candidate_id for r in scan.resumes.filter("content is not null").collect()} == {"b", "c", "e"}
    # A scan that was not ended is made again.
    run.run_ingest_folder(store, raw, str(folder), "eng", AS_OF)
    assert {r.candidate_id: bytes(r.content).decode() for r in store.read("resumes").collect()} == {
        "a": "first a", "b": "second b", "c": "first c", "d": "first d", "e": "first e"
    }
    assert statuses(store) == {"a": "ok", "b": "ok", "c": "ok", "d": "no_resume", "e": "no_resume"}
    still = ResumeScan(store, str(folder), "eng")
    assert still.resumes.filter("content is not null").count() == 0 and still.resumes.count() == 4


def test_scan_lists_a_folder_once_in_few_tasks(spark, tmp_path, monkeypatch):
    folder, store, listed = tmp_path / "pdf", Store(spark, str(tmp_path / "store")), []
    folder.mkdir()
    for i in range(400):
        (folder / f"{i}.pdf").write_text(f"text {i}")
    found = resume_files._files
    monkeypatch.setattr(resume_files, "_files", lambda *a, **b: listed.append(a) or found(*a, **b))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    scan = ResumeScan(store, str(folder), "eng")
    assert len(listed) == 1 and spark.conf.get("spark.sql.files.openCostInBytes") == before
    # A task writes a file; small files come to as many tasks as there are cores, not to 32 each.
    assert len(scan._now.inputFiles()) <= spark.sparkContext.defaultParallelism
    texts = {r.candidate_id: bytes(r.content).decode() for r in scan.resumes.collect()}
    assert texts == {str(i): f"text {i}" for i in range(400)}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_bucketed_stages_move_no_rows(spark, tmp_path):
    inputs(tmp_path)
    store = Store(spark, str(tmp_path / "store"), 4)
    start(spark, tmp_path, store)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        now, results = store.read("state"), store.read("results")
        texts, metadata = extract.useful(store.read("texts")), store.read("metadata")
        queued = state.queue(now, "stage1")
        blocks = requests.candidate_blocks(queued, texts, metadata, ["candidate_id", "name"])
        reading = extract.parse_files(state.queue(now, "parse"), store.read("resumes"), [("p", reader)])
        after = state.apply_events(now, scoring.score_events(results, True, True), AS_OF)
        rows = ranking.scored_candidates(now, scoring.latest_documents(results), metadata)
        (attempt,) = (tmp_path / "store/attempts").glob("s00000002-*-single-1")
        answers = store.read(f"attempts/{attempt.name}")
        checked = scoring.outcomes(scoring.readiness(queued, texts), scoring.resolve(answers), True, True)
        # The latest answers are found and ranked without the documents.
        ordered = ranking.scored_order(now, scoring.latest_documents(results))
        for df in (rows, ordered):
            schemas = [x for x in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1:]]
            assert schemas and not any("document" in x.split(">")[0] for x in schemas)
        assert "summary" not in ordered._jdf.queryExecution().executedPlan().toString()
        for df in (blocks, reading, after, rows, ordered, checked, state.upsert(now, store.read("arrived"), AS_OF)):
            assert exchanges(df) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("concurrency, stays", [(2, True), (4, True), (3, False)])
def test_answers_are_stored_where_they_were_given(spark, tmp_path, monkeypatch, concurrency, stays):
    store, given = Store(spark, str(tmp_path / "store"), 4), []
    save = Store._save

    def seen(self, path, df, aligned, buckets):
        if "/attempts/" in path:
            given.append(aligned)
        save(self, path, df, aligned, buckets)

    monkeypatch.setattr(Store, "_save", seen)
    inputs(tmp_path)
    start(spark, tmp_path, store, concurrency=concurrency)
    assert set(given) == {stays}
    for name in store.names("attempts"):
        files = [f for f in os.listdir(tmp_path / "store" / "attempts" / name / "v=00000001") if f.endswith(".parquet")]
        # A bucket is one file either way.
        assert len(files) == len({f.partition("_")[2] for f in files})


def test_two_stage_and_retry(spark, tmp_path):
    inputs(tmp_path)
    store = Store(spark, str(tmp_path / "store"), 4)
    summaries = start(spark, tmp_path, store, mode="two-stage")
    score = summaries["score"].drop("role").first().asDict()
    assert score == {
        "stage1_scored": 3,
        "stage2_scored": 2,
        "knocked_out": 1,
        "failed": 2,
        "skipped": 0,
    }
    assert statuses(store)["c3"] == "knocked_out"
    # A retry puts all four failures back; c4 has no stage-1 stamp and c8 no stage-2 one.
    again = run.run_score(
        store,
        rubric_row(spark, RUBRIC, "eng"),
        spark.createDataFrame([("eng", "job")], "role string, job_text string"),
        Scorer("chat_completion", "m", lambda r: answer(r.replace("ERROR 1", "OK 7.25").replace("RANGE 1", "OK 2"))),
        AS_OF,
        settings=run.ScoreSettings(mode="two-stage", delays=(), retry_failed=True),
    )
    assert again.drop("role").first().asDict() == {
        "stage1_scored": 1,
        "stage2_scored": 2,
        "knocked_out": 0,
        "failed": 0,
        "skipped": 0,
    }
    after = statuses(store)
    assert after["c4"] == after["c8"] == "scored"
    assert after["c5"] == after["c6"] == "discovered"


def test_resume_changes_nothing_and_fresh_is_refused(spark, tmp_path):
    inputs(tmp_path)
    store = Store(spark, str(tmp_path / "store"))
    start(spark, tmp_path, store)
    before = statuses(store)
    again = run.run_all(
        store,
        str(tmp_path / "out2"),
        AS_OF,
        rubric_row(spark, RUBRIC, "eng"),
        spark.createDataFrame([("eng", "job")], "role string, job_text string"),
        Scorer("chat_completion", "m", lambda r: 1 / 0),
        readers=[("plain", reader)],
    )
    assert "ingest" not in again
    assert again["score"].count() == 0
    assert statuses(store) == before
    assert again["rank"].drop("role").first().asDict()["ranked"] == 2
    with pytest.raises(ValueError, match="new store"):
        run.run_all(store, "x", AS_OF, None, None, SCORER, fresh=True)


@pytest.mark.parametrize("changed", [None, "model", "rubric"])
def test_interrupted_stage_reuses_saved_answers(spark, tmp_path, changed):
    inputs(tmp_path)
    store = Store(spark, str(tmp_path / "store"))
    run.run_ingest(
        store,
        read_candidates(spark, str(tmp_path / "in.csv"), "eng"),
        resume_contents(spark, str(tmp_path / "pdf"), "eng"),
        AS_OF,
    )
    run.run_parse(store, AS_OF, [("plain", reader)])
    rubrics = rubric_row(spark, RUBRIC, "eng")
    jobs = spark.createDataFrame([("eng", "job")], "role string, job_text string")
    settings = run.ScoreSettings(delays=())
    original, calls = store.append, []

    def failing(table, *args):
        if table == "results" and not calls:
            calls.append(1)
            raise OSError("lost")
        return original(table, *args)

    store.append = failing
    with pytest.raises(OSError):
        run.run_score(store, rubrics, jobs, SCORER, AS_OF, settings=settings)
    assert statuses(store)["c1"] == "ok"
    answered = str(tmp_path / ("again" if changed else "same"))
    other = Scorer("chat_completion", "other" if changed == "model" else "m", counting(answered))
    if changed == "rubric":
        rubrics = rubric_row(spark, {**RUBRIC, "role": "Other"}, "eng")
    summary = run.run_score(store, rubrics, jobs, other, AS_OF, settings=settings)
    assert summary.first().stage2_scored == 2
    assert statuses(store)["c1"] == "scored"
    assert os.path.exists(answered) == bool(changed)


@pytest.mark.parametrize("buckets", [None, 4])
def test_waves_are_not_asked_again(spark, tmp_path, buckets):
    """Lost in the third wave: the waves before it make no call when the stage goes on."""
    count = 40
    words = {f"c{i}": long(f"{'ERROR' if i % 9 == 0 else 'OK'} {i % 10}") for i in range(count)}
    store = Store(spark, str(tmp_path / "store"), buckets)
    raw = spark.createDataFrame([("eng", k, i) for i, k in enumerate(words)], "role string, candidate_id string, ingest_seq int")
    run.run_ingest(store, raw, raw.select("role", "candidate_id"), AS_OF)
    readings = spark.createDataFrame(
        [("eng", k, t, "p", None) for k, t in words.items()],
        "role string, candidate_id string, text string, extractor string, error string",
    )
    run.run_parse(store, AS_OF, readings=readings)
    rubrics = rubric_row(spark, RUBRIC, "eng")
    jobs = spark.createDataFrame([("eng", "job")], "role string, job_text string")
    settings = run.ScoreSettings(delays=(0.0,), wave_rows=8)
    assert run.stage_progress(store) is None
    log, original = str(tmp_path / "calls"), store.once

    def lost(table, df):
        if "-single-2-" in table:
            raise OSError("lost")
        return original(table, df)

    store.once = lost
    with pytest.raises(OSError):
        run.run_score(store, rubrics, jobs, Scorer("chat_completion", "m", logging(log)), AS_OF, settings=settings)
    store.once = original
    first = asked(log)
    progress = {r.wave: r for r in run.stage_progress(store).collect()}
    assert sorted(progress) == list(range(5)) and sum(r.due for r in progress.values()) == count
    assert [progress[w].waiting for w in range(2)] == [0, 0]
    assert all(progress[w].waiting == progress[w].due for w in range(2, 5))
    assert sum(r.due for r in progress.values() if r.wave < 2) == len(set(first))

    # Other waves in the settings change nothing now.
    settings = run.ScoreSettings(delays=(0.0,), wave_rows=3)
    summary = run.run_score(store, rubrics, jobs, Scorer("chat_completion", "m", logging(log)), AS_OF, settings=settings)
    later = asked(log)[len(first) :]
    assert set(first).isdisjoint(later) and len(set(first) | set(later)) == count
    bad = sum(t.startswith("ERROR") for t in words.values())
    # Only failures are asked twice.
    assert len(first) + len(later) == count + bad
    assert summary.first().stage2_scored == count - bad and summary.first().failed == bad
    assert run.stage_progress(store) is None
    assert store.read("results").count() == count


def logging(path):
    def call(request):
        with open(path, "a") as out:
            out.write(json.loads(request)["messages"][1]["content"].split("CANDIDATE_ID: ")[-1].split("\n")[0] + "\n")
        return answer(request)

    return call


def asked(path):
    with open(path) as calls:
        return calls.read().splitlines()


def test_failed_parses_are_retried(spark, tmp_path):
    inputs(tmp_path)
    store = Store(spark, str(tmp_path / "store"), 4)
    run.run_ingest(
        store,
        read_candidates(spark, str(tmp_path / "in.csv"), "eng"),
        resume_contents(spark, str(tmp_path / "pdf"), "eng"),
        AS_OF,
    )
    broken = {k for k, v in _after_parse(store, AS_OF, reader).items() if v == "unparseable"}
    assert broken
    # Without the option nothing is due, with it the failures alone are.
    assert run.run_parse(store, AS_OF, [("plain", reader)]).count() == 0
    mended = _after_parse(store, AS_OF, lambda content: [long("OK 4")], retry_failed=True)
    assert all(mended[k] == "discovered" for k in broken)
    texts = extract.useful(store.read("texts")).filter("text like 'OK 4%'")
    assert {r.candidate_id for r in texts.collect()} >= broken
    stamped = store.read("state").filter("resume_parsed_at is not null")
    assert broken <= {r.candidate_id for r in stamped.collect()}


def _after_parse(store, as_of, how, **more):
    run.run_parse(store, as_of, [("plain", how)], **more)
    return statuses(store)


def test_run_metadata(spark, tmp_path):
    inputs(tmp_path)
    store = Store(spark, str(tmp_path / "store"), 4)
    first = start(spark, tmp_path, store, notes={"job_id": "j1", "source_url": "u"})

    def held(df):
        return {r.key: r.value for r in df.collect()}

    assert held(first["meta"]) == {"created_at": AS_OF, "role": "Builder", "job_id": "j1", "source_url": "u"}
    again = run.run_all(
        store,
        str(tmp_path / "out2"),
        "2024-06-01 00:00:00",
        rubric_row(spark, {**RUBRIC, "role": "Maker"}, "eng"),
        spark.createDataFrame([("eng", "job")], "role string, job_text string"),
        SCORER,
        readers=[("plain", reader)],
        notes={"job_id": "j2"},
    )
    assert held(again["meta"]) == {"created_at": AS_OF, "role": "Maker", "job_id": "j2", "source_url": "u"}


def counting(path):
    def call(request):
        open(path, "a").close()
        return answer(request)

    return call


def test_second_ingest_follows_the_folder(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 4)
    raw = spark.createDataFrame([("eng", "a", 1), ("eng", "b", 2), ("eng", "c", 3)], "role string, candidate_id string, ingest_seq int")

    def files(*rows):
        return spark.createDataFrame([("eng", k, bytearray(v, "utf-8")) for k, v in rows], "role string, candidate_id string, content binary")

    run.run_ingest(store, raw, files(("a", "old"), ("b", "kept"), ("b", "kep")), AS_OF)
    assert statuses(store) == {"a": "ok", "b": "ok", "c": "no_resume"}
    run.run_ingest(store, raw, files(("a", "new")), AS_OF)
    assert statuses(store) == {"a": "ok", "b": "no_resume", "c": "no_resume"}
    assert {r.candidate_id: bytes(r.content) for r in store.read("resumes").collect()} == {"a": b"new", "b": b"kept"}
    blank = spark.createDataFrame([(None, "x", 1)], raw.schema)
    with pytest.raises(IngestError):
        run.run_ingest(store, blank, files(), AS_OF)
    readings = spark.createDataFrame(
        [("eng", "a", None, None, "bad"), ("eng", "a", long("OK 3"), "p", None)],
        "role string, candidate_id string, text string, extractor string, error string",
    )
    run.run_parse(store, AS_OF, readings=readings)
    assert store.read("state").count() == 3


def test_mode_is_validated():
    with pytest.raises(ValueError):
        run.ScoreSettings(mode="three-stage")
