"""Upsert, transitions, queues and counts of the candidate state."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from catalog.base import (
    AS_OF,
    STATE,
    duck,
    duck_shown_state,
    select,
    shown_state,
    table,
)
from candrank.operators import state

# Every second id is known already, odd ones are untouched, ids past the documents are new.
_INCOMING = """
SELECT 'r' || ((2 * c_custkey) % 5) AS role, 'c' || (2 * c_custkey) AS candidate_id,
       'https://new.example.org/' || c_custkey AS source_url,
       c_mktsegment AS current_title, cast(NULL AS {text}) AS current_company,
       c_acctbal >= 0 AND c_custkey % 3 <> 0 AS has_resume, 1000000 + c_custkey AS ingest_seq
FROM {customer}
"""

_EVENTS = """
SELECT 'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id,
       CASE WHEN toxic = 1 THEN 'failed'
            WHEN quality = 0 THEN 'stage1_knocked_out'
            WHEN doc_id % 6 = 0 THEN 'parsed' WHEN doc_id % 6 = 1 THEN 'unparseable'
            WHEN doc_id % 6 = 2 THEN 'stage1_passed' WHEN doc_id % 6 = 3 THEN 'stage2_scored'
            ELSE 'single_scored' END AS event,
       CASE WHEN toxic = 1 THEN 'failed_score' END AS failure_status,
       CASE WHEN toxic = 1 THEN text END AS error
FROM {labels} JOIN {documents} USING (doc_id)
"""


def _state(spark, sf):
    return select(spark, sf, STATE)


def _spark_incoming(spark, sf):
    return spark.sql(
        _INCOMING.replace("{text}", "string"), customer=table(spark, sf, "customer")
    )


def state_upsert(spark, sf, sticky=True):
    return shown_state(state.upsert(_state(spark, sf), _spark_incoming(spark, sf), AS_OF, sticky))


def state_transitions(spark, sf):
    return shown_state(state.apply_events(_state(spark, sf), select(spark, sf, _EVENTS), AS_OF))


def retry_reset(spark, sf):
    return shown_state(state.retry_reset(_state(spark, sf), AS_OF))


def queue(stage, spark, sf):
    return shown_state(state.queue(_state(spark, sf), stage))


def status_counts(spark, sf):
    return state.status_counts(_state(spark, sf))


def meta_upsert(spark, sf):
    """Every user is a run, every event one write; empty values come from clicks."""
    writes = table(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id").alias("role"),
        F.when(F.col("event_id") % 2 == 0, "created_at").otherwise(F.col("event_type")).alias("key"),
        F.when(F.col("event_type") == "click", "").otherwise(F.col("props")).alias("value"),
        F.struct("ts", "event_id").alias("seq"),
    )
    # The second half of the writes meets what the first half left.
    early, late = (writes.filter(F.col("seq.event_id") % 4 < 2), writes.filter(F.col("seq.event_id") % 4 >= 2))
    held = state.upsert_meta(writes.limit(0), early)
    return state.upsert_meta(held, late).select(
        "role", "key", "value", F.col("seq.event_id").alias("event_id")
    )


def _upsert_sql(sticky: bool) -> str:
    stuck = (
        ""
        if sticky
        else "WHEN coalesce(s.status, 'discovered') = 'no_resume' THEN 'ok'"
    )
    return duck(f"""WITH state AS ({STATE}), incoming AS ({_INCOMING.replace('{text}', 'varchar')}),
    new AS (
    SELECT coalesce(s.role, i.role) AS role, coalesce(s.candidate_id, i.candidate_id) AS candidate_id,
      CASE WHEN i.role IS NOT NULL THEN i.source_url ELSE s.applicant_url END AS applicant_url,
      CASE WHEN i.role IS NOT NULL THEN i.current_title ELSE s.current_title END AS current_title,
      CASE WHEN i.role IS NOT NULL THEN i.current_company ELSE s.current_company END AS current_company,
      CASE WHEN i.role IS NOT NULL THEN timestamp '{AS_OF}' ELSE s.profile_scraped_at END AS profile_scraped_at,
      CASE WHEN i.has_resume THEN timestamp '{AS_OF}' ELSE s.resume_downloaded_at END AS resume_downloaded_at,
      s.resume_parsed_at, s.score_stage1_at, s.score_stage2_at,
      CASE WHEN i.role IS NULL THEN s.status WHEN NOT i.has_resume THEN 'no_resume'
           WHEN coalesce(s.status, 'discovered') IN ('discovered', 'failed_scrape') THEN 'ok'
           {stuck}
           ELSE s.status END AS status,
      CASE WHEN i.role IS NULL THEN s.last_error END AS last_error,
      coalesce(s.created_at, timestamp '{AS_OF}') AS created_at,
      CASE WHEN i.role IS NOT NULL THEN timestamp '{AS_OF}' ELSE s.updated_at END AS updated_at,
      coalesce(s.ingest_seq, i.ingest_seq) AS ingest_seq
    FROM state s FULL JOIN incoming i ON s.role = i.role AND s.candidate_id = i.candidate_id)
    {duck_shown_state('new')}""")


_TRANSITIONS = duck(f"""WITH state AS ({STATE}), ev AS ({_EVENTS}),
new AS (
  SELECT s.* REPLACE (
    CASE WHEN event = 'parsed' THEN timestamp '{AS_OF}' ELSE resume_parsed_at END AS resume_parsed_at,
    CASE WHEN event IN ('stage1_passed', 'stage1_knocked_out', 'single_scored') THEN timestamp '{AS_OF}'
         ELSE score_stage1_at END AS score_stage1_at,
    CASE WHEN event IN ('stage2_scored', 'single_scored') THEN timestamp '{AS_OF}'
         ELSE score_stage2_at END AS score_stage2_at,
    CASE WHEN event = 'unparseable' THEN 'unparseable' WHEN event = 'stage1_knocked_out' THEN 'knocked_out'
         WHEN event IN ('stage2_scored', 'single_scored') THEN 'scored'
         WHEN event = 'failed' THEN 'failed_score' ELSE status END AS status,
    CASE WHEN event = 'failed' THEN left(error, 2000) ELSE last_error END AS last_error,
    CASE WHEN event IS NOT NULL THEN timestamp '{AS_OF}' ELSE updated_at END AS updated_at)
  FROM state s LEFT JOIN ev USING (role, candidate_id))
{duck_shown_state('new')}""")

_FAILED = "'failed_scrape', 'failed_parse', 'failed_score', 'unparseable'"


def _queue_sql(condition: str) -> str:
    return duck(
        f"WITH state AS ({STATE}), due AS (SELECT * FROM state WHERE {condition}) {duck_shown_state('due')}"
    )


_OPEN = f"status NOT IN ({_FAILED}, 'no_resume')"
_CONDITIONS = {
    "profile": f"profile_scraped_at IS NULL AND {_OPEN}",
    "resume": f"profile_scraped_at IS NOT NULL AND resume_downloaded_at IS NULL AND {_OPEN}",
    "parse": f"resume_downloaded_at IS NOT NULL AND resume_parsed_at IS NULL AND {_OPEN}",
    "stage1": f"resume_parsed_at IS NOT NULL AND score_stage1_at IS NULL AND {_OPEN} AND status <> 'knocked_out'",
    "stage2": f"score_stage1_at IS NOT NULL AND score_stage2_at IS NULL AND {_OPEN} AND status <> 'knocked_out'",
}

QUERIES = {
    "state_upsert": (state_upsert, _upsert_sql(True)),
    "state_upsert_late_resume": (partial(state_upsert, sticky=False), _upsert_sql(False)),
    "state_transitions": (state_transitions, _TRANSITIONS),
    "retry_reset": (
        retry_reset,
        duck(f"""WITH state AS ({STATE}), new AS (
        SELECT * REPLACE (
          CASE WHEN status IN ({_FAILED}) THEN 'discovered' ELSE status END AS status,
          CASE WHEN status IN ({_FAILED}) THEN NULL ELSE last_error END AS last_error,
          CASE WHEN status IN ({_FAILED}) THEN timestamp '{AS_OF}' ELSE updated_at END AS updated_at)
        FROM state) {duck_shown_state('new')}"""),
    ),
    **{
        f"queue_{stage}": (partial(queue, stage), _queue_sql(condition))
        for stage, condition in _CONDITIONS.items()
    },
    "status_counts": (
        status_counts,
        duck(f"WITH state AS ({STATE}) SELECT role, status, count(*) AS n FROM state GROUP BY ALL"),
    ),
    "meta_upsert": (
        meta_upsert,
        """WITH w AS (
          SELECT 'u' || user_id AS role,
                 CASE WHEN event_id % 2 = 0 THEN 'created_at' ELSE event_type END AS key,
                 CASE WHEN event_type = 'click' THEN '' ELSE props END AS value, ts, event_id
          FROM events),
        r AS (
          SELECT *, row_number() OVER (PARTITION BY role, key ORDER BY ts DESC, event_id DESC) AS newest,
                 row_number() OVER (PARTITION BY role, key ORDER BY value = '', ts, event_id) AS oldest,
                 bool_and(value = '') OVER (PARTITION BY role, key) AS none
          FROM w)
        SELECT role, key, value, event_id FROM r
        WHERE CASE WHEN key = 'created_at' AND NOT none THEN oldest = 1 ELSE newest = 1 END""",
    ),
}
