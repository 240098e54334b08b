"""Audits of answers: recomputed totals, score distributions by group."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import RUBRIC_ITEMS, duck, rubrics, select, table
from catalog.ranking import ROWS_SQL, ranked_rows
from candrank.operators import audit
from candrank.schemas import KEY
from candrank.sources.documents import criteria_view

# Every criterion of the role is scored in tenths; some answers lack the first one, name another
# one or give the second one twice.
_SCORES = f"""
SELECT doc_id, i.nth, i.id, cast((doc_id * (i.nth + 2)) % 101 AS double) / 10 AS score
FROM {{documents}} d JOIN ({RUBRIC_ITEMS}) i ON i.role = 'r' || (doc_id % 5)
WHERE NOT (doc_id % 7 = 0 AND i.nth = 1)
UNION ALL
SELECT doc_id, 98 AS nth, i.id, cast(7 AS double) AS score
FROM {{documents}} d JOIN ({RUBRIC_ITEMS}) i ON i.role = 'r' || (doc_id % 5) AND i.nth = 2
WHERE doc_id % 13 = 0
UNION ALL
SELECT doc_id, 99 AS nth, 'EXTRA' AS id, cast(5 AS double) AS score FROM {{documents}} WHERE doc_id % 9 = 0
"""

# Even answers claim the right total of all criteria, others any; some claim none.
_CLAIMS = f"""
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL
                    WHEN doc_id % 2 = 0 THEN sum(cast((doc_id * (i.nth + 2)) % 101 AS double)) / 50
                    ELSE cast((doc_id * 37) % 101 AS double) / 10 END AS claimed
FROM {{documents}} d JOIN ({RUBRIC_ITEMS}) i ON i.role = 'r' || (doc_id % 5)
GROUP BY doc_id
"""


def _totals(spark, sf):
    criteria = select(spark, sf, _SCORES).groupBy("doc_id").agg(
        F.collect_list(F.struct("id", "score")).alias("criteria")
    )
    answers = table(spark, sf, "documents").join(select(spark, sf, _CLAIMS), "doc_id").join(criteria, "doc_id")
    document = F.to_json(
        F.struct("criteria", F.col("claimed").alias("weighted_total"), F.col("text").alias("summary"))
    )
    documents = answers.select(
        F.concat(F.lit("r"), F.col("doc_id") % 5).alias("role"),
        F.concat(F.lit("c"), "doc_id").alias("candidate_id"),
        document.alias("document"),
    )
    return audit.recomputed_totals(criteria_view(documents), rubrics(spark, sf))


def weighted_recompute(spark, sf):
    listed = [F.array_join(f"{c}_ids", ",").alias(f"{c}_ids") for c in ("missing", "unknown", "repeated")]
    numbers = [F.col(c).cast("double").alias(c) for c in ("claimed", "recomputed", "difference")]
    return _totals(spark, sf).select(*KEY, *numbers, *listed, "verdict")


def weighted_audit_summary(spark, sf):
    found = audit.audit_summary(_totals(spark, sf))
    return found.withColumn("largest_difference", F.col("largest_difference").cast("double"))


def _bins(spark, sf):
    """Sketches of two runs over the rows to rank: one of odd arrivals, one of even ones."""
    rows = ranked_rows(spark, sf)
    runs = [
        audit.score_bins(rows.filter(F.col("ingest_seq") % 2 == odd), ["headline"], F.col("recommend"))
        for odd in (0, 1)
    ]
    return audit.merged_bins(runs[0].unionByName(runs[1]), ["headline"])


def score_by_group(spark, sf):
    return audit.distributions(_bins(spark, sf), ["headline"])


_TOTALS_SQL = duck(f"""
WITH items AS ({RUBRIC_ITEMS}), given AS ({_SCORES}), claims AS ({_CLAIMS}),
sums AS (
  SELECT g.doc_id, sum(coalesce(cast(i.weight AS decimal(16,8)), 0) * cast(g.score AS decimal(10,6))) AS total,
         string_agg(DISTINCT g.id, ',' ORDER BY g.id) FILTER (i.id IS NULL) AS unknown
  FROM given g LEFT JOIN items i ON i.role = 'r' || (g.doc_id % 5) AND i.id = g.id GROUP BY g.doc_id),
twice AS (
  SELECT doc_id, string_agg(id, ',' ORDER BY id) AS repeated
  FROM (SELECT doc_id, id FROM given GROUP BY doc_id, id HAVING count(*) > 1) GROUP BY doc_id),
absent AS (
  SELECT c.doc_id, string_agg(i.id, ',' ORDER BY i.id) AS missing
  FROM claims c JOIN items i ON i.role = 'r' || (c.doc_id % 5)
  WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.doc_id = c.doc_id AND g.id = i.id) GROUP BY c.doc_id),
t AS (
  SELECT 'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id, cast(cast(claimed AS decimal(16,8)) AS double) AS claimed,
         cast(total AS double) AS recomputed, cast(abs(total - cast(claimed AS decimal(16,8))) AS double) AS difference,
         coalesce(missing, '') AS missing_ids, coalesce(unknown, '') AS unknown_ids, coalesce(repeated, '') AS repeated_ids,
         CASE WHEN coalesce(missing, unknown, repeated) IS NOT NULL THEN 'ids differ'
              WHEN claimed IS NULL THEN 'no total'
              WHEN abs(total - cast(claimed AS decimal(16,8))) <= 0.05 THEN 'agrees' ELSE 'differs' END AS verdict
  FROM claims JOIN sums USING (doc_id) LEFT JOIN twice USING (doc_id) LEFT JOIN absent USING (doc_id))
""")

_GROUPS_SQL = """, b AS (
  SELECT role, headline, recommend, cast(floor(weighted_total * 1000 + 0.5) AS bigint) AS bin FROM r),
q AS (
  SELECT role, headline, count(*) AS rows, count(*) FILTER (recommend) AS selected, count(*) AS scored,
         sum(bin) / count(*) / 1000 AS mean, QUANTILES FROM b GROUP BY role, headline),
g AS (SELECT role, headline, bin, count(*) AS n FROM b GROUP BY role, headline, bin),
places AS (SELECT DISTINCT p.role, q.headline, p.bin FROM b p JOIN q ON q.role = p.role),
filled AS (SELECT p.role, p.headline, p.bin, coalesce(n, 0) AS n FROM places p LEFT JOIN g USING (role, headline, bin)),
stairs AS (
  SELECT role, headline, sum(n) OVER (PARTITION BY role, headline ORDER BY bin) AS mine,
         sum(n) OVER (PARTITION BY role, headline) AS mine_all,
         sum(n) OVER (PARTITION BY role ORDER BY bin RANGE UNBOUNDED PRECEDING) AS every,
         sum(n) OVER (PARTITION BY role) AS every_all FROM filled),
k AS (
  SELECT role, headline, cast(max(abs(mine * every_all - every * mine_all)) AS bigint) / cast(max(mine_all) * max(every_all) AS bigint) AS ks
  FROM stairs GROUP BY role, headline)
SELECT q.*, selected / rows AS selection_rate, ks,
       CASE WHEN max(selected / rows) OVER (PARTITION BY role) > 0
            THEN (selected / rows) / max(selected / rows) OVER (PARTITION BY role) END AS impact_ratio
FROM q JOIN k USING (role, headline)""".replace(
    "QUANTILES",
    ", ".join(f"cast(quantile_disc(bin, {q}) AS double) / 1000 AS q_{q * 100:g}" for q in audit.QUANTILES),
)


QUERIES = {
    "weighted_recompute": (weighted_recompute, f"{_TOTALS_SQL} SELECT * FROM t"),
    "weighted_audit_summary": (
        weighted_audit_summary,
        f"""{_TOTALS_SQL} SELECT role, count(*) AS answers,
        count(*) FILTER (verdict = 'agrees') AS agrees, count(*) FILTER (verdict = 'differs') AS differs,
        count(*) FILTER (verdict = 'ids differ') AS ids_differ, cast(0 AS bigint) AS no_criteria,
        count(*) FILTER (verdict = 'no total') AS no_total, cast(0 AS bigint) AS no_rubric,
        max(difference) FILTER (verdict IN ('agrees', 'differs')) AS largest_difference FROM t GROUP BY role""",
    ),
    "score_by_group": (score_by_group, f"{ROWS_SQL}{_GROUPS_SQL}"),
}
