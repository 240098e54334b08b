"""Ranking: order, numbering, top-N, stored documents, file names and file output."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from catalog.base import duck, select, table
from candrank.operators import ranking
from candrank.plans.scratch import new_path, written
from candrank.schemas import KEY, RANKED_SCHEMA
from candrank.sources.documents import document_view
from candrank.sources.rankings import write_ranked

# Three quarters of the candidates are scored, many on the same day; every other one has
# a stage-2 stamp.
_STATE = """
SELECT 'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id,
       CASE WHEN doc_id % 12 = 3 THEN 'knocked_out' WHEN doc_id % 12 = 7 THEN 'failed_score'
            WHEN doc_id % 12 = 11 THEN 'ok' ELSE 'scored' END AS status,
       CASE WHEN doc_id % 3 <> 0 THEN cast('2024-03-0' || (1 + doc_id % 4) AS timestamp) END AS score_stage1_at,
       CASE WHEN doc_id % 2 = 0 THEN cast('2024-04-0' || (1 + doc_id % 3) AS timestamp) END AS score_stage2_at,
       cast('2024-01-01' AS timestamp) AS created_at, doc_id AS ingest_seq
FROM {documents}
"""

# Totals in tenths give ties; every seventh document lacks a total, every ninth is not
# readable, every tenth names another id, and odd ones have four decimals.
_FIELDS = """
SELECT doc_id, 'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id, lang, source, text,
       CASE WHEN doc_id % 7 = 0 THEN 0.0E0
            WHEN doc_id % 2 = 0 THEN cast((doc_id * 37) % 101 AS double) / 10
            ELSE cast((doc_id * 7919) % 100001 AS double) / 10000 END AS total,
       doc_id % 7 = 0 AS no_total, doc_id % 9 = 0 AS broken,
       CASE WHEN doc_id % 10 = 0 THEN 'other' || doc_id ELSE 'c' || doc_id END AS reply_id
FROM {documents}
"""


def _documents(spark, sf):
    fields = select(spark, sf, _FIELDS)
    whole = F.to_json(
        F.struct(
            F.col("reply_id").alias("candidate_id"),
            F.when(~F.col("no_total"), F.col("total")).alias("weighted_total"),
            (F.col("doc_id") % 4 == 0).alias("recommend"),
            F.col("text").alias("summary"),
        )
    )
    document = F.when(F.col("broken"), F.concat(F.lit("{"), "text")).otherwise(whole)
    return fields.select(*KEY, document.alias("document"))


def stored_documents(spark, sf):
    return document_view(_documents(spark, sf)).withColumn("summary", F.md5("summary"))


def ranked_rows(spark, sf):
    people = table(spark, sf, "documents").select(
        F.concat(F.lit("r"), F.col("doc_id") % 5).alias("role"),
        F.concat(F.lit("c"), "doc_id").alias("candidate_id"),
        F.col("lang").alias("headline"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("current_title"),
        F.concat(F.lit("u"), "doc_id").alias("profile_url"),
    ).join(table(spark, sf, "labels").select(F.concat(F.lit("c"), "doc_id").alias("candidate_id")), "candidate_id")
    return ranking.scored_candidates(
        select(spark, sf, _STATE), document_view(_documents(spark, sf)), people
    )


def _shown(ranked):
    return ranking.projected(ranked).withColumn("summary", F.md5("summary"))


def rank_full(spark, sf, runs=None):
    return _shown(ranking.rank_all(ranked_rows(spark, sf), runs=runs))


def rank_top(n, spark, sf):
    return _shown(ranking.top_n(ranked_rows(spark, sf), n))


def rank_formatted(spark, sf):
    return ranking.formatted(ranking.rank_all(ranked_rows(spark, sf))).withColumn("summary", F.md5("summary"))


_RESUMES = """
SELECT 'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id, cast(text AS binary) AS content
FROM {documents} JOIN {labels} USING (doc_id)
"""


def _bundle(spark, sf, ranked):
    from candrank.sources.resumes import ranked_bundle

    return ranked_bundle(ranked, select(spark, sf, _RESUMES))


def rank_bundle(spark, sf):
    """Resumes of the top 50 under their names; a missing resume is left out."""
    top = written(ranking.projected(ranking.top_n(ranked_rows(spark, sf))), "top")
    return _bundle(spark, sf, top).select(
        "role", "rank", "file_name", F.md5("content").alias("digest")
    )


def rank_bundle_names(spark, sf):
    ranked = written(ranking.projected(ranking.rank_all(ranked_rows(spark, sf))), "ranked")
    return ranking.with_bundle_names(ranked).select("role", "rank", "file_name")


def rank_summary(spark, sf):
    ranked = written(ranking.projected(ranking.rank_all(ranked_rows(spark, sf))), "ranked")
    top = ranked.filter(F.col("rank") <= 50)
    return ranking.rank_summary(ranked, top, _bundle(spark, sf, top))


def ranked_files(spark, sf):
    """Write the full ranking as CSV, line breaks and quotes included, and read it back."""
    path = new_path(spark, "ranked-csv")
    write_ranked(ranking.rank_all(ranked_rows(spark, sf)), path)
    back = (
        spark.read.schema(RANKED_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
        .na.fill("")
    )
    return back.withColumn("summary", F.md5("summary"))


ROWS_SQL = duck(f"""
WITH state AS ({_STATE}), f AS ({_FIELDS}), lab AS (SELECT doc_id, true AS known FROM labels),
r AS (
  SELECT f.role, f.reply_id AS candidate_id, '' AS name,
         CASE WHEN known THEN lang ELSE '' END AS headline, '' AS location,
         CASE WHEN known AND f.doc_id % 5 <> 0 THEN source ELSE '' END AS current_title,
         '' AS current_company, total AS weighted_total, f.doc_id % 4 = 0 AS recommend,
         md5(text) AS summary, CASE WHEN known THEN 'u' || f.doc_id ELSE '' END AS profile_url,
         row_number() OVER (PARTITION BY f.role ORDER BY total DESC,
            coalesce(score_stage2_at, score_stage1_at) ASC NULLS FIRST, f.doc_id) AS rank,
         count(*) OVER (PARTITION BY f.role) AS size, text
  FROM f JOIN state s ON f.role = s.role AND f.candidate_id = s.candidate_id
  LEFT JOIN lab ON lab.doc_id = f.doc_id
  WHERE s.status = 'scored' AND NOT broken)
""")
_COLUMNS = (
    "role, rank, candidate_id, name, headline, location, current_title, current_company, "
    "weighted_total, recommend, summary, profile_url"
)
_TEXT = f"""SELECT {_COLUMNS} FROM (SELECT * REPLACE (cast(rank AS varchar) AS rank,
    printf('%.3f', weighted_total) AS weighted_total, cast(recommend AS varchar) AS recommend) FROM r)"""
_FILES = "(SELECT 'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id, text FROM documents JOIN labels USING (doc_id))"

QUERIES = {
    "stored_documents": (
        stored_documents,
        duck(f"""WITH f AS ({_FIELDS}) SELECT role, candidate_id, reply_id, total AS weighted_total,
        doc_id % 4 = 0 AS recommend, md5(text) AS summary FROM f WHERE NOT broken"""),
    ),
    "rank_full": (rank_full, f"{ROWS_SQL} SELECT {_COLUMNS} FROM r"),
    "rank_full_by_runs": (partial(rank_full, runs=48), f"{ROWS_SQL} SELECT {_COLUMNS} FROM r"),
    "rank_top_n": (partial(rank_top, 50), f"{ROWS_SQL} SELECT {_COLUMNS} FROM r WHERE rank <= 50"),
    "rank_per_role": (partial(rank_top, 3), f"{ROWS_SQL} SELECT {_COLUMNS} FROM r WHERE rank <= 3"),
    "rank_formatted": (rank_formatted, f"{ROWS_SQL} {_TEXT}"),
    "rank_bundle_names": (
        rank_bundle_names,
        f"""{ROWS_SQL} SELECT role, rank,
        lpad(cast(rank AS varchar), cast(greatest(3, length(cast(size AS varchar))) AS integer), '0') || '_' || candidate_id || '.pdf' AS file_name
        FROM r""",
    ),
    "rank_bundle": (
        rank_bundle,
        f"""{ROWS_SQL} SELECT r.role, rank,
        lpad(cast(rank AS varchar), 3, '0') || '_' || candidate_id || '.pdf' AS file_name, md5(p.text) AS digest
        FROM r JOIN {_FILES} p USING (role, candidate_id) WHERE rank <= 50""",
    ),
    "rank_summary": (
        rank_summary,
        f"""{ROWS_SQL} SELECT r.role, count(*) AS ranked, count(*) FILTER (rank <= 50) AS top_n_written,
        count(*) FILTER (rank <= 50 AND p.role IS NOT NULL) AS resumes_copied
        FROM r LEFT JOIN {_FILES} p USING (role, candidate_id) GROUP BY r.role""",
    ),
    "rank_large_n": (partial(rank_top, 200_000), f"{ROWS_SQL} SELECT {_COLUMNS} FROM r WHERE rank <= 200000"),
    "ranked_files": (ranked_files, f"{ROWS_SQL} {_TEXT}"),
}
