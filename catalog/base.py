"""Inputs derived from the given tables.

An input is one SELECT that Spark and DuckDB both understand, so both sides start from the
same rows; the operators under check run on Spark only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-06-01 12:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def select(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """Run an input SELECT; {name} stands for a table."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf, n) for n in names})


def duck(sql: str) -> str:
    """The same text for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def stamp(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def duck_stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


BLANKS = "chr(9) || chr(10) || ' ' || chr(160)"

# Candidate rows as a file would bring them: three rows per id, padded and blank ids,
# blank and missing titles, two unknown columns.
RAW = """
SELECT 'r' || (cast(floor(doc_id / 3) AS bigint) % 5) AS role,
       doc_id AS ingest_seq,
       CASE WHEN doc_id % 50 = 0 THEN '  '
            ELSE (CASE doc_id % 4 WHEN 1 THEN ' ' WHEN 2 THEN chr(9) ELSE '' END)
                 || 'c' || cast(floor(doc_id / 3) AS bigint)
                 || (CASE doc_id % 4 WHEN 3 THEN ' ' || chr(160) ELSE '' END) END AS candidate_id,
       'Name ' || doc_id AS name,
       lang AS headline,
       CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'city ' || (doc_id % 17) END AS location,
       CASE WHEN doc_id % 7 = 0 THEN '   ' WHEN doc_id % 11 = 0 THEN NULL
            ELSE '  ' || source || chr(10) END AS current_title,
       CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS current_company,
       ' https://example.org/' || doc_id || ' ' AS source_url,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS notes,
       'https://profile.example.org/' || doc_id AS profile_url
FROM {documents}
"""

# Keys of the labelled documents' candidates stand for resume files.
PRESENT = """
SELECT DISTINCT 'r' || (cast(floor(doc_id / 3) AS bigint) % 5) AS role,
       'c' || cast(floor(doc_id / 3) AS bigint) AS candidate_id
FROM {labels}
"""

# One candidate per document, every status, stages cut off at every point.
STATE = """
SELECT 'r' || (doc_id % 5) AS role,
       'c' || doc_id AS candidate_id,
       'https://example.org/' || doc_id AS applicant_url,
       source AS current_title,
       lang AS current_company,
       CASE WHEN doc_id % 10 >= 1 THEN cast('2024-01-0' || (1 + doc_id % 4) || ' 00:00:00' AS timestamp) END AS profile_scraped_at,
       CASE WHEN doc_id % 10 >= 3 THEN cast('2024-02-0' || (1 + doc_id % 4) || ' 00:00:00' AS timestamp) END AS resume_downloaded_at,
       CASE WHEN doc_id % 10 >= 5 THEN cast('2024-03-0' || (1 + doc_id % 4) || ' 00:00:00' AS timestamp) END AS resume_parsed_at,
       CASE WHEN doc_id % 10 >= 7 THEN cast('2024-04-0' || (1 + doc_id % 4) || ' 00:00:00' AS timestamp) END AS score_stage1_at,
       CASE WHEN doc_id % 10 >= 9 THEN cast('2024-05-0' || (1 + doc_id % 4) || ' 00:00:00' AS timestamp) END AS score_stage2_at,
       CASE doc_id % 17 WHEN 0 THEN 'discovered' WHEN 1 THEN 'no_resume' WHEN 2 THEN 'knocked_out'
            WHEN 3 THEN 'scored' WHEN 4 THEN 'failed_scrape' WHEN 5 THEN 'failed_parse'
            WHEN 6 THEN 'failed_score' WHEN 7 THEN 'unparseable' ELSE 'ok' END AS status,
       CASE WHEN doc_id % 17 BETWEEN 4 AND 7 THEN 'problem ' || doc_id END AS last_error,
       cast('2024-01-01 00:00:00' AS timestamp) AS created_at,
       cast('2024-05-05 00:00:00' AS timestamp) AS updated_at,
       doc_id AS ingest_seq
FROM {documents}
"""

TIMES = (
    "profile_scraped_at",
    "resume_downloaded_at",
    "resume_parsed_at",
    "score_stage1_at",
    "score_stage2_at",
    "created_at",
    "updated_at",
)


def shown_state(state: DataFrame) -> DataFrame:
    return state.withColumns({c: stamp(c) for c in TIMES})


def duck_shown_state(source: str) -> str:
    times = ", ".join(f"{duck_stamp(c)} AS {c}" for c in TIMES)
    return f"SELECT * REPLACE ({times}) FROM {source}"


# Five roles: a region is a role, its nations are the criteria, equally weighted, and
# the first two of them the knockouts.
RUBRIC_ITEMS = """
SELECT 'r' || n_regionkey AS role, n_nationkey AS pos, n_name AS id,
       1.0 / count(*) OVER (PARTITION BY n_regionkey) AS weight,
       row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nth
FROM {nation}
"""


def rubrics(spark: SparkSession, sf: str) -> DataFrame:
    items = select(spark, sf, RUBRIC_ITEMS).select(
        "role", "nth", "id", F.col("weight").cast("double").alias("weight")
    )
    about = F.concat(F.lit("about "), F.lower("id"))
    lists = items.groupBy("role").agg(
        F.sort_array(F.collect_list(F.struct("nth", "id", "weight", about.alias("description")))).alias("all")
    )
    titles = table(spark, sf, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("role"), F.col("r_name").alias("title")
    )
    return lists.join(titles, "role").select(
        "role",
        "title",
        F.lit(1).alias("version"),
        F.transform(
            F.filter("all", lambda i: i["nth"] <= 2),
            lambda i: F.struct(i["id"].alias("id"), i["description"].alias("description")),
        ).alias("knockouts"),
        F.transform(
            "all",
            lambda i: F.struct(
                i["id"].alias("id"), i["weight"].alias("weight"), i["description"].alias("description")
            ),
        ).alias("criteria"),
    )


JOBS = """
SELECT 'r' || r_regionkey AS role, '  We hire in ' || r_name || '.' || chr(10) AS job_text
FROM {region}
"""

# The prefix of a request per role, for DuckDB.
DUCK_PREFIX = duck(f"""
items AS ({RUBRIC_ITEMS}),
prefixes AS (
  SELECT 'r' || r_regionkey AS role,
         '--- JOB DESCRIPTION ---' || chr(10) || 'We hire in ' || r_name || '.' || chr(10) || chr(10)
         || '--- RUBRIC ---' || chr(10)
         || 'ROLE: ' || r_name || chr(10) || chr(10)
         || 'KNOCKOUTS (any failure ⇒ recommend=false):' || chr(10)
         || (SELECT string_agg('  - ' || id || ': about ' || lower(id), chr(10) ORDER BY nth)
             FROM items WHERE items.role = 'r' || r_regionkey AND nth <= 2)
         || chr(10) || chr(10) || 'CRITERIA (score each 0–10):' || chr(10)
         || (SELECT string_agg('  - ' || id || ' (weight ' || printf('%.2f', weight) || '): about ' || lower(id),
                               chr(10) ORDER BY nth)
             FROM items WHERE items.role = 'r' || r_regionkey)
         || chr(10) AS prefix
  FROM region)
""")

# One candidate per document, with clean ids, for the stages after ingest.
PEOPLE = """
SELECT 'r' || (doc_id % 5) AS role, doc_id AS ingest_seq, 'c' || doc_id AS candidate_id,
       'Name ' || doc_id AS name,
       CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS headline,
       CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'city ' || (doc_id % 17) END AS location,
       source AS current_title, lang AS current_company,
       'https://example.org/' || doc_id AS source_url
FROM {documents}
"""
PEOPLE_COLUMNS = (
    "candidate_id",
    "name",
    "headline",
    "location",
    "current_title",
    "current_company",
    "source_url",
)
DUCK_BLOCK_META = "concat_ws(chr(10), " + ", ".join(
    f"CASE WHEN p.{c} <> '' THEN '{c}: ' || p.{c} END" for c in PEOPLE_COLUMNS
) + ")"
