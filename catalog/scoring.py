"""The scoring stages: recorded answers, live calls, documents and the whole run."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.answers import quoted
from catalog.base import (
    AS_OF,
    JOBS,
    PEOPLE,
    PEOPLE_COLUMNS,
    duck,
    rubrics,
    select,
    table,
)
from candrank.operators import requests, scoring, state
from candrank.plans import run
from candrank.plans.joins import fits
from candrank.plans.scratch import new_path, written
from candrank.schemas import KEY
from candrank.sources.store import Store

# Every document's candidate has been parsed; one of eleven has no stored text.
_PARSED_STATE = """
SELECT role, candidate_id, source_url AS applicant_url, current_title, current_company,
       cast('2024-01-01' AS timestamp) AS profile_scraped_at,
       cast('2024-01-01' AS timestamp) AS resume_downloaded_at,
       cast('2024-01-02' AS timestamp) AS resume_parsed_at,
       cast(NULL AS timestamp) AS score_stage1_at, cast(NULL AS timestamp) AS score_stage2_at,
       'ok' AS status, cast(NULL AS string) AS last_error,
       cast('2024-01-01' AS timestamp) AS created_at, cast('2024-01-02' AS timestamp) AS updated_at,
       ingest_seq
FROM (PEOPLE)
""".replace("PEOPLE", PEOPLE)

_TEXTS = """
SELECT 'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id, text
FROM {documents} WHERE doc_id % 11 <> 0
"""

_ALL_TEXTS = """
SELECT 'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id, text FROM {documents}
"""


def _recorded(spark, sf, full: bool) -> DataFrame:
    """Recorded answers of all documents.

    toxic: the call failed. quality 0: the knockout failed. Documents without a label passed. Every
    13th total is out of range. The full pass fails the knockout of every 4th document as well.
    """
    docs = (
        table(spark, sf, "documents")
        .join(table(spark, sf, "labels"), "doc_id", "left")
        .na.fill({"quality": 1, "toxic": 0})
    )
    passed = F.col("quality") == 1
    if full:
        passed = passed & (F.col("doc_id") % 4 != 0)
    total = F.when(F.col("doc_id") % 13 == 0, F.lit(11.0)).otherwise(
        ((F.col("doc_id") * 37) % 101).cast("double") / 10
    )
    payload = F.concat(
        F.lit('{"criteria":[],"recommend":true,"passed":true,"knockouts":[{"id":"k","reasoning":"","passed":'),
        passed.cast("string"),
        F.lit('}],"weighted_total":'),
        total.cast("string"),
        F.lit(',"summary":'),
        quoted("text"),
        F.lit("}"),
    )
    raw = F.concat(
        F.lit('{"choices":[{"finish_reason":"stop","message":{"content":'), quoted(payload), F.lit("}}]}")
    )
    return docs.select(
        F.concat(F.lit("r"), F.col("doc_id") % 5).alias("role"),
        F.concat(F.lit("c"), "doc_id").alias("candidate_id"),
        F.lit(1).alias("attempt"),
        F.when(F.col("toxic") == 0, raw).alias("raw"),
        F.when(F.col("toxic") == 1, F.lit("call refused")).alias("error"),
        F.lit(AS_OF).cast("timestamp").alias("answered_at"),
    )


def _stage(spark, sf, before: DataFrame, queue: str, full: bool, single: bool):
    queued = scoring.readiness(state.queue(before, queue), select(spark, sf, _TEXTS))
    ready = queued.filter("ready").select(*KEY)
    answers = _recorded(spark, sf, full).join(ready, list(KEY), "left_semi")
    attempts = scoring.parsed_attempts(answers, "chat_completion", "")
    results = written(
        scoring.outcomes(queued, scoring.resolve(attempts), full, single), "results"
    )
    after = state.apply_events(before, scoring.score_events(results, full, single), AS_OF)
    return results, written(after, "state")


def _single(spark, sf):
    results, after = _stage(spark, sf, select(spark, sf, _PARSED_STATE), "stage1", True, True)
    return [("single", results)], after


def _two_stage(spark, sf):
    first, middle = _stage(spark, sf, select(spark, sf, _PARSED_STATE), "stage1", False, False)
    second, after = _stage(spark, sf, middle, "stage2", True, False)
    return [("knockout", first), ("full", second)], after


def outcome(mode, spark, sf):
    _, after = (_single if mode == "single" else _two_stage)(spark, sf)
    return after.select(
        *KEY,
        "status",
        "last_error",
        F.col("score_stage1_at").isNotNull().alias("stage1"),
        F.col("score_stage2_at").isNotNull().alias("stage2"),
    )


def summary(mode, spark, sf):
    results, _ = (_single if mode == "single" else _two_stage)(spark, sf)
    return scoring.score_summary(results)


def documents_written(spark, sf):
    """The stored JSON of valid answers: total, forced recommendation and whole summary."""
    (_, results), *_ = _single(spark, sf)[0]
    doc = F.parse_json("document")
    return scoring.with_document(results, True).filter("document is not null").select(
        *KEY,
        F.variant_get(doc, "$.weighted_total", "double").alias("weighted_total"),
        F.variant_get(doc, "$.recommend", "boolean").alias("recommend"),
        F.md5(F.variant_get(doc, "$.summary", "string")).alias("digest"),
    )


def latest_documents(spark, sf):
    """Events as documents: a user is a candidate, an event a run, purchases the full pass."""
    docs = table(spark, sf, "events").select(
        F.lit("r").alias("role"),
        F.concat(F.lit("u"), "user_id").alias("candidate_id"),
        F.when(F.col("event_type") == "purchase", "full").otherwise("knockout").alias("stage"),
        F.concat("props", F.col("event_id").cast("string")).alias("document"),
        F.col("event_id").alias("run"),
    )
    return scoring.latest_documents(docs)


def _scorer() -> scoring.Scorer:
    # A local function travels to the workers by value, so they need no import of this file.
    def call(request: str) -> str:
        """Answer from the candidate's text alone: its length decides."""
        import json

        user = json.loads(request)["messages"][1]["content"]
        text = user.split("--- RESUME TEXT ---\n", 1)[1][:-1]
        if len(text) % 7 == 0:
            raise RuntimeError("busy")
        payload = {
            "criteria": [],
            "knockouts": [{"id": "k", "passed": len(text) % 5 != 0, "reasoning": ""}],
            "weighted_total": (len(text) % 101) / 10,
            "recommend": True,
            "summary": text,
            "passed": True,
        }
        message = {"content": json.dumps(payload)}
        return json.dumps({"choices": [{"finish_reason": "stop", "message": message}]})

    return scoring.Scorer("chat_completion", "m1", call)


def scorer_rounds(spark, sf):
    """Live calls in two rounds over every document's request, resolved per candidate."""
    people = select(spark, sf, PEOPLE)
    texts = table(spark, sf, "documents").select(
        F.concat(F.lit("r"), F.col("doc_id") % 5).alias("role"),
        F.concat(F.lit("c"), "doc_id").alias("candidate_id"),
        "text",
    )
    blocks = requests.candidate_blocks(people, texts, people, PEOPLE_COLUMNS)
    prefixes = requests.role_prefixes(rubrics(spark, sf), select(spark, sf, JOBS))
    scorer = _scorer()

    def build(keys):
        due = blocks if keys is None else blocks.join(keys, list(KEY), "left_semi")
        return scoring.build_requests(due, prefixes, scorer, True, scoring.tasks_for(8))

    attempts = scoring.run_attempts(
        build,
        scorer,
        True,
        lambda answers, number: written(answers, f"attempts-{number}"),
        delays=(0.0,),
    )
    resolved = scoring.resolve(attempts)
    return resolved.select(
        *KEY,
        "error",
        F.variant_get("payload", "$.weighted_total", "double").alias("weighted_total"),
        F.md5(F.variant_get("payload", "$.summary", "string")).alias("digest"),
    )


def _waves(spark, sf):
    """Live calls over every document's request in waves, the third one lost at first."""
    people = select(spark, sf, PEOPLE)
    texts = select(spark, sf, _ALL_TEXTS)
    blocks = requests.candidate_blocks(people, texts, people, PEOPLE_COLUMNS)
    prefixes = requests.role_prefixes(rubrics(spark, sf), select(spark, sf, JOBS))
    scorer, store, small = _scorer(), Store(spark, new_path(spark, "waves")), fits(prefixes)
    waves = 4
    due = store.once_by("due", scoring.with_waves(blocks, waves), "wave")

    def save(stop, answers, wave, number):
        if wave == stop:
            raise InterruptedError
        return store.once(f"attempts/{wave}-{number}", answers.withColumn("asked_in", F.lit("first" if stop else "second")))

    def ask(stop=None):
        return scoring.run_waves(
            due,
            waves,
            lambda rows: scoring.build_requests(rows, prefixes, scorer, True, scoring.tasks_for(8), small=small),
            scorer,
            True,
            partial(save, stop),
            delays=(0.0,),
        )

    try:
        ask(stop=2)
    except InterruptedError:
        pass
    return due, waves, ask()


def scorer_waves(spark, sf):
    """Answers of a stage that was lost in its third wave, and in which run each was asked for.

    Every wave before the third was answered by the first run, every other by the second.
    """
    due, _, attempts = _waves(spark, sf)
    asked = attempts.groupBy(*KEY).agg(F.max("asked_in").alias("asked_in"), F.max("attempt").alias("tries"))
    once = due.select(*KEY, F.when(F.col("wave") < 2, "first").otherwise("second").alias("expected"))
    resolved = scoring.resolve(attempts.drop("asked_in"))
    return resolved.join(asked, list(KEY)).join(once, list(KEY)).select(
        *KEY,
        "error",
        "tries",
        F.variant_get("payload", "$.weighted_total", "double").alias("weighted_total"),
        (F.col("asked_in") == F.col("expected")).alias("asked_once"),
    )


def wave_progress(spark, sf):
    """How far a stage's waves are, per role."""
    due, _, attempts = _waves(spark, sf)
    return (
        scoring.wave_progress(due, attempts)
        .groupBy("role")
        .agg(*[F.sum(c).alias(c) for c in ("due", "answered", "failed", "waiting")])
    )


def end_to_end(mode, spark, sf):
    """Ingest, parse, score and rank over a new store; the full ranking."""
    store = Store(spark, new_path(spark, "store"), buckets=8)
    readings = spark.sql(
        """SELECT 'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id, text,
                  'table' AS extractor, cast(NULL AS string) AS error FROM {documents}""",
        documents=table(spark, sf, "documents"),
    )
    run.run_all(
        store,
        new_path(spark, "ranked"),
        AS_OF,
        rubrics(spark, sf),
        select(spark, sf, JOBS),
        _scorer(),
        select(spark, sf, PEOPLE),
        select(spark, sf, _TEXTS).select(*KEY),
        readings=readings,
        settings=run.ScoreSettings(mode=mode, concurrency=8, delays=()),
    )
    return store.read("ranked").drop("profile_url").withColumn("summary", F.md5("summary"))


_DUCK_TWO = duck(f"""
WITH l AS (SELECT doc_id, text, coalesce(quality, 1) AS quality, coalesce(toxic, 0) AS toxic,
                  'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id
           FROM documents LEFT JOIN labels USING (doc_id)),
stages AS (
  SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'skipped' WHEN toxic = 1 THEN 'call'
                 WHEN quality = 0 THEN 'out' WHEN doc_id % 13 = 0 THEN 'range' ELSE 'ok' END AS two,
            CASE WHEN doc_id % 11 = 0 THEN 'skipped' WHEN toxic = 1 THEN 'call'
                 WHEN doc_id % 13 = 0 THEN 'range' WHEN quality = 0 OR doc_id % 4 = 0 THEN 'out' ELSE 'ok' END AS one
  FROM l)
""")
_ERROR = "CASE {0} WHEN 'call' THEN 'failed after 1 attempts: call refused' WHEN 'range' THEN 'invalid: weighted_total' END"
_STATUS = "CASE {0} WHEN 'skipped' THEN 'ok' WHEN 'out' THEN 'knocked_out' WHEN 'ok' THEN 'scored' ELSE 'failed_score' END"

_RUN_SQL = """
WITH d AS (
  SELECT doc_id, 'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id, lang, source, text,
         length(text) AS n
  FROM documents WHERE doc_id % 11 <> 0),
s AS (SELECT * FROM d WHERE n >= 200 AND n % 7 <> 0 AND n % 5 <> 0)
SELECT role, row_number() OVER (PARTITION BY role ORDER BY n % 101 DESC, doc_id) AS rank, candidate_id,
       'Name ' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS headline,
       CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'city ' || (doc_id % 17) END AS location,
       source AS current_title, lang AS current_company,
       cast(n % 101 AS double) / 10 AS weighted_total, true AS recommend, md5(text) AS summary
FROM s"""

QUERIES = {
    "single_stage_outcome": (
        partial(outcome, "single"),
        f"""{_DUCK_TWO} SELECT role, candidate_id, {_STATUS.format('one')} AS status,
        {_ERROR.format('one')} AS last_error, one IN ('ok', 'out') AS stage1, one = 'ok' AS stage2
        FROM stages""",
    ),
    "two_stage_outcome": (
        partial(outcome, "two-stage"),
        f"""{_DUCK_TWO} SELECT role, candidate_id, {_STATUS.format('two')} AS status,
        {_ERROR.format('two')} AS last_error, two IN ('ok', 'out', 'range') AS stage1, two = 'ok' AS stage2
        FROM stages""",
    ),
    "single_stage_summary": (
        partial(summary, "single"),
        f"""{_DUCK_TWO} SELECT role, count(*) FILTER (one = 'ok') AS stage1_scored,
        count(*) FILTER (one = 'ok') AS stage2_scored, count(*) FILTER (one = 'out') AS knocked_out,
        count(*) FILTER (one IN ('call', 'range')) AS failed, count(*) FILTER (one = 'skipped') AS skipped
        FROM stages GROUP BY role""",
    ),
    "two_stage_summary": (
        partial(summary, "two-stage"),
        f"""{_DUCK_TWO} SELECT role, count(*) FILTER (two IN ('ok', 'range')) AS stage1_scored,
        count(*) FILTER (two = 'ok') AS stage2_scored, count(*) FILTER (two = 'out') AS knocked_out,
        count(*) FILTER (two IN ('call', 'range')) AS failed, count(*) FILTER (two = 'skipped') AS skipped
        FROM stages GROUP BY role""",
    ),
    "documents_written": (
        documents_written,
        f"""{_DUCK_TWO} SELECT role, candidate_id, cast((doc_id * 37) % 101 AS double) / 10 AS weighted_total,
        one = 'ok' AS recommend, md5(text) AS digest FROM stages WHERE one IN ('ok', 'out')""",
    ),
    "latest_documents": (
        latest_documents,
        """SELECT 'r' AS role, 'u' || user_id AS candidate_id, arg_max(props || event_id, event_id) AS document
           FROM events GROUP BY user_id""",
    ),
    "scorer_rounds": (
        scorer_rounds,
        """SELECT 'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id,
           CASE WHEN length(text) % 7 = 0 THEN 'failed after 2 attempts: busy' END AS error,
           CASE WHEN length(text) % 7 <> 0 THEN cast(length(text) % 101 AS double) / 10 END AS weighted_total,
           CASE WHEN length(text) % 7 <> 0 THEN md5(text) END AS digest FROM documents""",
    ),
    "scorer_waves": (
        scorer_waves,
        """SELECT 'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id,
           CASE WHEN length(text) % 7 = 0 THEN 'failed after 2 attempts: busy' END AS error,
           CASE WHEN length(text) % 7 = 0 THEN 2 ELSE 1 END AS tries,
           CASE WHEN length(text) % 7 <> 0 THEN cast(length(text) % 101 AS double) / 10 END AS weighted_total,
           true AS asked_once FROM documents""",
    ),
    "wave_progress": (
        wave_progress,
        """SELECT 'r' || (doc_id % 5) AS role, count(*) AS due, count(*) FILTER (length(text) % 7 <> 0) AS answered,
           count(*) FILTER (length(text) % 7 = 0) AS failed, 0 AS waiting FROM documents GROUP BY 1""",
    ),
    "end_to_end_single": (partial(end_to_end, "single"), _RUN_SQL),
    "end_to_end_two_stage": (partial(end_to_end, "two-stage"), _RUN_SQL),
}
