"""The keyed candidate state: upsert, transitions, work queues and counts.

State changes are functions ``(state, incoming, as_of) -> state``. Both sides hold one row
per key, so the join on the key has no hot groups, and between bucketed tables it needs
no exchange.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candrank import constants as C
from candrank.functions.text import head
from candrank.schemas import KEY, STATE_COLUMNS, state_schema

STOPPED = (*C.FAILURE_STATUSES, "no_resume")

# Events a batch can carry for a key, one per key and batch.
EVENTS = (
    "parsed",
    "unparseable",
    "stage1_passed",
    "stage1_knocked_out",
    "stage2_scored",
    "single_scored",
    "failed",
)


def instant(as_of: datetime | str | Column) -> Column:
    """A timestamp cut to whole seconds."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    return F.date_trunc("second", at)


def empty_state(spark, seq_type) -> DataFrame:
    return spark.createDataFrame([], state_schema(seq_type))


def upsert(state: DataFrame, candidates: DataFrame, as_of, sticky_no_resume: bool = True) -> DataFrame:
    """Discovered, then profile, then resume presence, in this order for every candidate.

    ``candidates``: one row per key with source_url, current_title, current_company,
    has_resume and ingest_seq. With ``sticky_no_resume=False`` a resume that arrives later
    takes a candidate out of ``no_resume``.
    """
    now = instant(as_of)
    new = candidates.select(
        *KEY,
        *[
            F.col(c).alias(f"_{c}")
            for c in ("source_url", "current_title", "current_company", "has_resume", "ingest_seq")
        ],
        F.lit(True).alias("_seen"),
    )
    both = state.join(new, list(KEY), "full")
    seen = F.col("_seen").isNotNull()
    has_resume = F.col("_has_resume")

    def refreshed(value, old: str) -> Column:
        return F.when(seen, value).otherwise(F.col(old)).alias(old)

    known = F.coalesce("status", F.lit("discovered"))
    profiled = F.when(known.isin("discovered", "failed_scrape"), F.lit("ok")).otherwise(known)
    if not sticky_no_resume:
        profiled = F.when((known == "no_resume") & has_resume, F.lit("ok")).otherwise(profiled)
    status = F.when(has_resume, profiled).otherwise(F.lit("no_resume"))
    return both.select(
        *KEY,
        refreshed(F.col("_source_url"), "applicant_url"),
        refreshed(F.col("_current_title"), "current_title"),
        refreshed(F.col("_current_company"), "current_company"),
        refreshed(now, "profile_scraped_at"),
        F.when(seen & has_resume, now)
        .otherwise(F.col("resume_downloaded_at"))
        .alias("resume_downloaded_at"),
        "resume_parsed_at",
        "score_stage1_at",
        "score_stage2_at",
        refreshed(status, "status"),
        refreshed(F.lit(None).cast("string"), "last_error"),
        F.coalesce("created_at", now).alias("created_at"),
        refreshed(now, "updated_at"),
        F.coalesce("ingest_seq", "_ingest_seq").alias("ingest_seq"),
    )


ARRIVAL = ("source_url", "current_title", "current_company", "has_resume", "ingest_seq")


def arrivals(candidates: DataFrame, as_of, number: int, sticky_no_resume: bool = True) -> DataFrame:
    """The candidates of one ingest as rows that can be kept and applied later, in order of ``number``."""
    return candidates.select(
        *KEY,
        *ARRIVAL,
        F.lit(number).cast("long").alias("number"),
        instant(as_of).alias("at"),
        F.lit(sticky_no_resume).alias("sticky"),
    )


def upsert_arrivals(state: DataFrame, arrived: DataFrame) -> DataFrame:
    """What :func:`upsert` gives for one ingest after the other, from all their rows at once.

    ``arrived``: rows of :func:`arrivals`, one per key and number; the rows of a key are reduced
    to one, so any number of ingests costs one join. The setting of a key's last ingest holds.
    """
    order, has = F.col("number"), F.col("has_resume")
    shown = F.struct("source_url", "current_title", "current_company", "has_resume", "at", "sticky")
    each = arrived.groupBy(*KEY).agg(
        F.max_by(shown, order).alias("_last"),
        F.min_by(F.struct("ingest_seq", "at"), order).alias("_first"),
        F.max(F.when(has, F.struct("number", "at"))).alias("_found"),
        F.max(~has).alias("_missed"),
    )
    both = state.join(each, list(KEY), "full")
    seen, last = F.col("_last").isNotNull(), F.col("_last")
    known = F.coalesce("status", F.lit("discovered"))
    profiled = F.when(known.isin("discovered", "failed_scrape"), F.lit("ok")).otherwise(known)
    # Without a resume once, a candidate stays so, or is taken up again by a last ingest with one.
    kept = F.when(F.col("_missed"), F.lit("no_resume")).otherwise(profiled)
    renewed = F.when(F.col("_missed") | (known == "no_resume"), F.lit("ok")).otherwise(profiled)
    status = F.when(last["sticky"], kept).when(last["has_resume"], renewed).otherwise(F.lit("no_resume"))
    changed = {
        "applicant_url": last["source_url"],
        "current_title": last["current_title"],
        "current_company": last["current_company"],
        "profile_scraped_at": last["at"],
        "resume_downloaded_at": F.coalesce(F.col("_found")["at"], F.col("resume_downloaded_at")),
        "status": status,
        "last_error": F.lit(None).cast("string"),
        "updated_at": last["at"],
    }
    rows = {name: F.when(seen, value).otherwise(F.col(name)) for name, value in changed.items()}
    rows["created_at"] = F.coalesce("created_at", F.col("_first")["at"])
    rows["ingest_seq"] = F.coalesce("ingest_seq", F.col("_first")["ingest_seq"])
    return both.select(*KEY, *[rows.get(c, F.col(c)).alias(c) for c in STATE_COLUMNS if c not in KEY])


def apply_events(state: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """Apply one event per key.

    ``events``: role, candidate_id, event (one of EVENTS), failure_status and error (for
    ``failed``), at (optional timestamp; ``as_of`` where NULL). An unknown event or a
    failure status outside the failure set stops the job.
    """
    at = F.col("at") if "at" in events.columns else F.lit(None).cast("timestamp")
    incoming = events.select(
        *KEY,
        F.col("event").alias("_event"),
        F.col("failure_status").alias("_failure"),
        F.col("error").alias("_error"),
        instant(F.coalesce(at, instant(as_of))).alias("_at"),
    )
    both = state.join(incoming, list(KEY), "left")
    event, at, failure = F.col("_event"), F.col("_at"), F.col("_failure")
    hit = event.isNotNull()

    def stamp(column: str, *names: str) -> Column:
        return F.when(event.isin(*names), at).otherwise(F.col(column)).alias(column)

    bad = (event == "failed") & ~F.coalesce(failure.isin(*C.FAILURE_STATUSES), F.lit(False))
    status = (
        F.when(~hit, F.col("status"))
        .when(~event.isin(*EVENTS), F.raise_error(F.concat(F.lit("unknown event "), event)).cast("string"))
        .when(bad, F.raise_error(F.concat(F.lit("bad failure status "), F.coalesce(failure, F.lit("NULL")))).cast("string"))
        .when(event == "unparseable", F.lit("unparseable"))
        .when(event == "stage1_knocked_out", F.lit("knocked_out"))
        .when(event.isin("stage2_scored", "single_scored"), F.lit("scored"))
        .when(event == "failed", failure)
        .otherwise(F.col("status"))
    )
    changed = {
        "resume_parsed_at": stamp("resume_parsed_at", "parsed"),
        "score_stage1_at": stamp(
            "score_stage1_at", "stage1_passed", "stage1_knocked_out", "single_scored"
        ),
        "score_stage2_at": stamp("score_stage2_at", "stage2_scored", "single_scored"),
        "status": status.alias("status"),
        "last_error": F.when(event == "failed", head(F.col("_error"), C.MAX_ERROR_CHARS))
        .otherwise(F.col("last_error"))
        .alias("last_error"),
        "updated_at": F.when(hit, at).otherwise(F.col("updated_at")).alias("updated_at"),
    }
    return both.select(*[changed.get(c, F.col(c)) for c in STATE_COLUMNS])


def is_failure() -> Column:
    return F.col("status").isin(*C.FAILURE_STATUSES)


def retry_reset(state: DataFrame, as_of) -> DataFrame:
    """Put failures back to ``discovered``; stage stamps stay. ``retry_count`` counts them."""
    failed = is_failure()
    return state.withColumns(
        {
            "status": F.when(failed, F.lit("discovered")).otherwise(F.col("status")),
            "last_error": F.when(~failed, F.col("last_error")),
            "updated_at": F.when(failed, instant(as_of)).otherwise(F.col("updated_at")),
        }
    )


def retry_count(state: DataFrame) -> int:
    return state.filter(is_failure()).count()


# stage -> (stamps that must be set, stamps that must be missing, stopped statuses)
QUEUES = {
    "profile": ((), "profile_scraped_at", STOPPED),
    "resume": (("profile_scraped_at",), "resume_downloaded_at", STOPPED),
    "parse": (("resume_downloaded_at",), "resume_parsed_at", STOPPED),
    "stage1": (("resume_parsed_at",), "score_stage1_at", (*STOPPED, "knocked_out")),
    "stage2": (("score_stage1_at",), "score_stage2_at", (*STOPPED, "knocked_out")),
}


def queue(state: DataFrame, stage: str) -> DataFrame:
    """Rows a stage still has to process; every predicate reaches the Parquet scan."""
    needed, missing, stopped = QUEUES[stage]
    ready = F.col(missing).isNull() & ~F.col("status").isin(*stopped)
    for stamp in needed:
        ready = F.col(stamp).isNotNull() & ready
    return state.filter(ready)


def status_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("role", "status").agg(F.count(F.lit(1)).alias("n"))


def upsert_meta(meta: DataFrame, updates: DataFrame, write_once=("created_at",)) -> DataFrame:
    """Run metadata (role, key, value, seq): latest value wins, write-once keys keep the first.

    An empty value counts as not yet written. ``seq`` orders the writes.
    """
    both = meta.unionByName(updates)
    once = F.col("key").isin(*write_once)
    filled = F.col("value") != ""
    return (
        both.groupBy("role", "key")
        .agg(
            F.max_by(F.struct("value", "seq"), "seq").alias("_latest"),
            F.min_by(
                F.when(filled, F.struct("value", "seq")), F.when(filled, F.col("seq"))
            ).alias("_first"),
        )
        .select(
            "role",
            "key",
            F.when(once, F.coalesce("_first", "_latest")).otherwise(F.col("_latest")).alias("_v"),
        )
        .select("role", "key", "_v.value", "_v.seq")
    )
