"""Cleansing, duplicates, presence, the file source and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import AS_OF, BLANKS, PRESENT, RAW, duck, select
from candrank.operators import ingest
from candrank.plans.run import current_state, run_ingest
from candrank.plans.scratch import new_path
from candrank.sources.candidates import read_candidates
from candrank.sources.store import Store
from candrank.streaming.drops import candidate_stream, ingest_stream

_KEYED = """
SELECT 'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id, doc_id, source, lang FROM {documents}
"""

_CLEAN = duck(f"""
raw AS ({RAW}),
clean AS (
  SELECT role, coalesce(trim(candidate_id, {BLANKS}), '') AS candidate_id,
         coalesce(trim(source_url, {BLANKS}), '') AS source_url,
         nullif(trim(current_title, {BLANKS}), '') AS current_title,
         nullif(trim(current_company, {BLANKS}), '') AS current_company, ingest_seq
  FROM raw),
present AS ({PRESENT}),
firsts AS (
  SELECT * EXCLUDE (n), n - 1 AS duplicates FROM (
    SELECT *, row_number() OVER (PARTITION BY role, candidate_id ORDER BY ingest_seq) AS rn,
           count(*) OVER (PARTITION BY role, candidate_id) AS n
    FROM clean WHERE candidate_id <> '')
  WHERE rn = 1),
arrived AS (
  SELECT f.* EXCLUDE (rn), p.candidate_id IS NOT NULL AS has_resume
  FROM firsts f LEFT JOIN present p USING (role, candidate_id))
""")


def blank_normalise(spark, sf):
    return ingest.normalise(select(spark, sf, RAW))


def ingest_keep_first(spark, sf):
    return ingest.keep_first(ingest.normalise(select(spark, sf, RAW)))


def metadata_keep_last(spark, sf):
    return ingest.metadata_keep_last(select(spark, sf, RAW))


def metadata_keep_first(spark, sf):
    return ingest.metadata_keep_first(select(spark, sf, RAW)).select(
        "role", "candidate_id", "name", "current_title", "ingest_seq"
    )


def _arrived(spark, sf):
    return ingest.resume_presence(ingest_keep_first(spark, sf), select(spark, sf, PRESENT))


def resume_presence(spark, sf):
    return _arrived(spark, sf)


def ingest_summary(spark, sf):
    return ingest.ingest_summary(_arrived(spark, sf))


def candidate_csv(spark, sf):
    """Write candidate files with texts as a column, quotes and line breaks included, and scan them."""
    from catalog.base import table

    path = new_path(spark, "candidate-csv")
    rows = table(spark, sf, "documents").select(
        F.concat(F.lit("c"), "doc_id").alias("candidate_id"),
        F.lit("").alias("name"),
        F.concat(F.lit('say "'), "text", F.lit('", twice')).alias("notes"),
    )
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_candidates(spark, path, "r0").select(
        "role", "candidate_id", "name", F.length("notes").cast("long").alias("chars"), F.md5("notes").alias("digest")
    )


def incremental_ingest(spark, sf):
    """The same rows arriving as files, ingested as a stream; the state that results."""
    raw = select(spark, sf, RAW)
    drop = new_path(spark, "drop")
    columns = [c for c in raw.columns if c not in ("role", "ingest_seq")]
    (
        raw.repartition(1, "role")
        .sortWithinPartitions("role", "ingest_seq")
        .select("role", *columns)
        .write.partitionBy("role")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(drop)
    )
    store = Store(spark, new_path(spark, "stream-store"))
    query = ingest_stream(
        candidate_stream(spark, drop, columns),
        lambda: select(spark, sf, PRESENT),
        store,
        lambda n: AS_OF,
        new_path(spark, "stream-checkpoint"),
    )
    query.awaitTermination()
    return current_state(store).select(
        "role", "candidate_id", "applicant_url", "current_title", "current_company", "status"
    )


def store_reopened(spark, sf):
    """Written with 8 buckets, reopened with 16, appended to and joined on the key."""
    rows = select(spark, sf, _KEYED)
    root = new_path(spark, "reopened")
    Store(spark, root, 8).write("left", rows.filter("doc_id % 3 > 0").select("role", "candidate_id", "source"))
    store = Store(spark, root, 16)
    left = store.append("left", rows.filter("doc_id % 3 = 0").select("role", "candidate_id", "source"))
    right = store.write("right", rows.select("role", "candidate_id", "lang"))
    return left.join(right.hint("merge"), ["role", "candidate_id"])


def store_partial_append(spark, sf):
    """An append whose commit was cut off is not seen, and is repeated in full."""
    rows = select(spark, sf, _KEYED).select("role", "candidate_id", "source")
    store = Store(spark, new_path(spark, "torn"))
    store.write("runs", rows.filter("role < 'r3'").withColumn("run", F.lit("first")))
    torn = rows.filter("role = 'r3'").withColumn("run", F.lit("second"))
    torn.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", False).partitionBy("role").parquet(
        f"{store.root}/runs/v=00000001-000001"
    )
    store.append_run("runs", rows.filter("role >= 'r3'"), "second")
    return store.read("runs")


def reingest_state(spark, sf):
    """Two ingests: some resume files vanish, the others change; states and kept contents."""
    raw = select(spark, sf, RAW)
    store = Store(spark, new_path(spark, "reingest"), 8)
    present = select(spark, sf, PRESENT)
    still = present.filter("cast(substr(candidate_id, 2) AS bigint) % 2 = 0")
    for label, files in (("first", present), ("second", still)):
        run_ingest(store, raw, files.withColumn("content", F.lit(label).cast("binary")), AS_OF)
    contents = store.read("resumes").select("role", "candidate_id", F.col("content").cast("string").alias("resume"))
    state = store.read("state").select("role", "candidate_id", "status")
    return state.join(contents, ["role", "candidate_id"], "left")


def run_summary(spark, sf):
    """The summary of the whole ingest stage, with the columns it does not know."""
    store = Store(spark, new_path(spark, "summary"), 8)
    return run_ingest(store, select(spark, sf, RAW), select(spark, sf, PRESENT), AS_OF)


def input_retained(spark, sf):
    """All rows ingested, then two of the roles again: their raw rows are replaced, the others stay."""
    raw, present = select(spark, sf, RAW), select(spark, sf, PRESENT)
    store = Store(spark, new_path(spark, "retained"))
    run_ingest(store, raw, present, AS_OF)
    again = raw.filter("role < 'r2'").withColumn("notes", F.lit("second"))
    run_ingest(store, again, present, AS_OF)
    return store.read("candidates").select("role", "ingest_seq", "candidate_id", "notes")


QUERIES = {
    "run_summary": (
        run_summary,
        f"""WITH {_CLEAN}
        SELECT role, count(*) AS ingested, count(*) FILTER (has_resume) AS with_resume,
               count(*) FILTER (NOT has_resume) AS without_resume,
               cast(sum(duplicates) AS bigint) AS duplicates_skipped,
               'notes, profile_url' AS unknown_columns
        FROM arrived GROUP BY role""",
    ),
    "input_retained": (
        input_retained,
        duck(f"""SELECT role, ingest_seq, candidate_id, CASE WHEN role < 'r2' THEN 'second' ELSE notes END AS notes
        FROM ({RAW})"""),
    ),
    "blank_normalise": (
        blank_normalise,
        f"WITH {_CLEAN} SELECT * FROM clean WHERE candidate_id <> ''",
    ),
    "ingest_keep_first": (
        ingest_keep_first,
        f"WITH {_CLEAN} SELECT * EXCLUDE (rn) FROM firsts",
    ),
    "metadata_keep_last": (
        metadata_keep_last,
        duck(f"""WITH raw AS ({RAW})
        SELECT * EXCLUDE (rn) FROM (
          SELECT *, row_number() OVER (PARTITION BY role, candidate_id ORDER BY ingest_seq DESC) AS rn
          FROM raw WHERE candidate_id <> '') WHERE rn = 1"""),
    ),
    "metadata_keep_first": (
        metadata_keep_first,
        duck(f"""WITH raw AS ({RAW})
        SELECT role, id AS candidate_id, name, current_title, ingest_seq FROM (
          SELECT *, trim(candidate_id, {BLANKS}) AS id,
                 row_number() OVER (PARTITION BY role, trim(candidate_id, {BLANKS}) ORDER BY ingest_seq) AS rn
          FROM raw WHERE trim(candidate_id, {BLANKS}) <> '') WHERE rn = 1"""),
    ),
    "resume_presence": (resume_presence, f"WITH {_CLEAN} SELECT * FROM arrived"),
    "ingest_summary": (
        ingest_summary,
        f"""WITH {_CLEAN}
        SELECT role, count(*) AS ingested, count(*) FILTER (has_resume) AS with_resume,
               count(*) FILTER (NOT has_resume) AS without_resume,
               cast(sum(duplicates) AS bigint) AS duplicates_skipped
        FROM arrived GROUP BY role""",
    ),
    "candidate_csv": (
        candidate_csv,
        """SELECT 'r0' AS role, 'c' || doc_id AS candidate_id, cast(NULL AS varchar) AS name,
                  length(text) + 13 AS chars, md5('say "' || text || '", twice') AS digest
           FROM documents""",
    ),
    "incremental_ingest": (
        incremental_ingest,
        f"""WITH {_CLEAN}
        SELECT role, candidate_id, source_url AS applicant_url, current_title, current_company,
               CASE WHEN has_resume THEN 'ok' ELSE 'no_resume' END AS status
        FROM arrived""",
    ),
    "store_reopened": (store_reopened, duck(f"SELECT role, candidate_id, source, lang FROM ({_KEYED})")),
    "store_partial_append": (
        store_partial_append,
        duck(f"""SELECT role, candidate_id, source, CASE WHEN role < 'r3' THEN 'first' ELSE 'second' END AS run
        FROM ({_KEYED})"""),
    ),
    "reingest_state": (
        reingest_state,
        f"""WITH {_CLEAN}
        SELECT role, candidate_id,
               CASE WHEN has_resume AND even THEN 'ok' ELSE 'no_resume' END AS status,
               CASE WHEN has_resume AND even THEN 'second' WHEN has_resume THEN 'first' END AS resume
        FROM (SELECT *, cast(substr(candidate_id, 2) AS bigint) % 2 = 0 AS even FROM arrived)""",
    ),
}
